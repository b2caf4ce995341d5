"""Sharding by a k-d tree over metadata, balanced by bytes.

The tree starts with all rows and as many leaves as shards. Each node is split along
the metadata dimension that is widest in it, at the weighted median of the row sizes,
until its leaves reach the target bytes. Medians are found for all nodes of a level at
once: histograms of bytes by key range narrow the range that holds the median until it
has few rows, and these are put in order exactly. Within a dimension's value rows are
ordered by text and then by a hash of the key, so that copies stay together unless a
median falls among them. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetair.llm.common import written

#: Ranges of a histogram, and the rows that are put in order exactly.
BUCKETS = 1 << 14
EXACT_ROWS = 20_000
#: Rows of a shard that are numbered in one task, about.
ROWS_PER_CHUNK = 50_000
MIN_CHUNKS = 8


@dataclass
class _Node:
    """A subtree: its leaves, and how it is split."""

    first: int
    leaves: int
    dim: int = 0
    target: float = 0.0  # bytes that go left
    below: int = 0  # bytes known to lie left of the range
    second: bool = False  # the range is of second keys, under one first key
    lo: int = 0
    hi: int = 0
    at: int = 0  # the first key when ``second``
    exact: bool = False
    cut: tuple[int, int, bool] | None = None

    @property
    def left(self) -> int:
        return self.leaves // 2


def _beside(rows: DataFrame, nodes: list[_Node], **values) -> DataFrame:
    """Rows of the nodes given, each with its node's values in columns of these names.

    A node's values are a row of a small table, of as many rows as a level has nodes, at most as many
    as there are shards; every executor gets it. Rows of other nodes are left out.
    """
    kinds = {int: "long", float: "double", bool: "boolean"}
    first = {c: f(nodes[0]) for c, f in values.items()}
    schema = "_kd_node int, " + ", ".join(f"_kd_{c} {kinds[type(v)]}" for c, v in first.items())
    table = rows.sparkSession.createDataFrame([(x.first, *(f(x) for f in values.values())) for x in nodes], schema)
    return rows.join(F.broadcast(table), "_kd_node")


class _Tree:
    def __init__(self, n_shards: int, dimensions: list[str]):
        self.n = n_shards
        self.dimensions = dimensions
        self.levels: list[list[_Node]] = []

    def place(self, rows: DataFrame) -> DataFrame:
        """Add ``_kd_node``, the leaf that each row belongs to."""
        out = rows.withColumn("_kd_node", F.lit(0))
        for nodes in self.levels:
            out = self.step(self.keyed(out, nodes), nodes)
        return out

    def step(self, keyed: DataFrame, nodes: list[_Node]) -> DataFrame:
        """Move every row of a split node to the node's left or right child."""
        split = _beside(
            keyed, self.whole(nodes), a=lambda x: int(x.cut[0] if x.cut else 0), b=lambda x: int(x.cut[1] if x.cut else 0),
            also=lambda x: bool(x.cut and x.cut[2]), right=lambda x: x.left if x.cut else 0)
        goes_left = (F.col("_kd_first") < F.col("_kd_a")) | ((F.col("_kd_first") == F.col("_kd_a")) & (
            (F.col("_kd_second") < F.col("_kd_b")) | ((F.col("_kd_second") == F.col("_kd_b")) & F.col("_kd_also"))))
        moved = F.when(goes_left, F.col("_kd_node")).otherwise(F.col("_kd_node") + F.col("_kd_right")).cast("int")
        return split.withColumn("_kd_node", moved).drop("_kd_first", "_kd_a", "_kd_b", "_kd_also", "_kd_right")

    def whole(self, nodes: list[_Node]) -> list[_Node]:
        """The nodes of a level and the leaves that are done, which stay where they are."""
        there = {x.first for x in nodes}
        return [*nodes, *(_Node(i, 1) for i in range(self.n) if i not in there)]

    def keyed(self, rows: DataFrame, nodes: list[_Node]) -> DataFrame:
        """Add ``_kd_first``, the key along each row's node's dimension."""
        value = F.lit(0).cast("long")
        for i, name in enumerate(self.dimensions):
            value = F.when(F.col("_kd_dim") == i, F.col(name).cast("long")).otherwise(value)
        return _beside(rows, self.whole(nodes), dim=lambda x: x.dim).withColumn(
            "_kd_first", F.shiftleft(value, 32).bitwiseOR(F.col("_kd_crc"))).drop("_kd_dim")


def _dimensions(docs: DataFrame, key: str, text: str, by: Sequence[str]) -> DataFrame:
    """Integer metadata below 2**31, the size in bytes and the two ordering keys."""
    raw = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(raw) + 1).cast("long")
    lines = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit(""))) + 1

    def code(name: str) -> Column:
        return F.shiftright(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), 1)

    return docs.withColumns({
        "_kd_bytes": size, "_kd_crc": F.crc32(raw.cast("binary")),
        "_kd_second": F.shiftrightunsigned(F.xxhash64(F.col(key)), 1),
        "_kd_dim0": F.floor(F.log2(size) * 1_000_000).cast("long"),
        "_kd_dim1": F.floor(size / (F.length(raw) + 1) * 100_000_000).cast("long"),
        "_kd_dim2": F.floor(F.log2(lines) * 1_000_000).cast("long"),
        **{f"_kd_dim{i}": code(c) for i, c in enumerate(by, 3)},
    })


def _narrow(rows: DataFrame, nodes: list[_Node]) -> None:
    """One histogram round: move each node's range to the bucket that holds its median."""
    value = F.when(F.col("_kd_in_second"), F.col("_kd_second")).otherwise(F.col("_kd_first"))
    ranged = _beside(
        rows, nodes, in_second=lambda x: x.second, lo=lambda x: int(x.lo), hi=lambda x: int(x.hi), at=lambda x: int(x.at),
        width=lambda x: max(1, -(-(int(x.hi) - int(x.lo) + 1) // BUCKETS)))
    inside = (
        ranged.withColumn("_v", value).where(F.col("_v").between(F.col("_kd_lo"), F.col("_kd_hi")))
        .where(~F.col("_kd_in_second") | (F.col("_kd_first") == F.col("_kd_at")))
    )
    histogram = inside.groupBy("_kd_node", F.floor((F.col("_v") - F.col("_kd_lo")) / F.col("_kd_width")).alias("b")).agg(
        F.sum("_kd_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    upto = Window.partitionBy("_kd_node").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = _crossing(histogram, nodes, F.sum("bytes").over(upto))
    by_first = {x.first: x for x in nodes}
    for r in crossing.collect():  # one row per node
        x = by_first[r["_kd_node"]]
        x.below += r["total"] - r["bytes"]
        x.exact = r["n"] <= EXACT_ROWS
        if not x.exact and r["lo"] == r["hi"]:
            if x.second:  # one row, repeated: it cannot be divided
                x.cut = (x.at, r["hi"], True)
            else:
                x.second, x.at, x.lo, x.hi = True, r["lo"], 0, (1 << 63) - 1
        else:
            x.lo, x.hi = r["lo"], r["hi"]


def _crossing(sums: DataFrame, nodes: list[_Node], total: Column) -> DataFrame:
    """The row of each node at which its running total reaches the bytes that go left."""
    summed = _beside(sums.withColumn("total", total), nodes, need=lambda x: float(x.target - x.below))
    return summed.where((F.col("total") >= F.col("_kd_need")) & (F.col("total") - F.col("bytes") < F.col("_kd_need")))


def _finish(rows: DataFrame, nodes: list[_Node]) -> None:
    """Put the few rows around each median in order and cut where bytes are closest."""
    value = F.when(F.col("_kd_in_second"), F.col("_kd_second")).otherwise(F.col("_kd_first"))
    ranged = _beside(rows, nodes, in_second=lambda x: x.second, lo=lambda x: int(x.lo), hi=lambda x: int(x.hi), at=lambda x: int(x.at))
    few = (
        ranged.where(value.between(F.col("_kd_lo"), F.col("_kd_hi")) & (~F.col("_kd_in_second") | (F.col("_kd_first") == F.col("_kd_at"))))
        .groupBy("_kd_node", "_kd_first", "_kd_second").agg(F.sum("_kd_bytes").alias("bytes"))
    )
    upto = Window.partitionBy("_kd_node").orderBy("_kd_first", "_kd_second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = _crossing(few, nodes, F.sum("bytes").over(upto))
    by_first = {x.first: x for x in nodes}
    for r in at.collect():  # one row per node
        x = by_first[r["_kd_node"]]
        over = x.below + r["total"] - x.target
        x.cut = (r["_kd_first"], r["_kd_second"], over <= r["bytes"] - over)


def _grow(rows: DataFrame, tree: _Tree) -> None:
    """Split every node until each leaf has its share of the bytes.

    The rows' few numbers are written once per level with the node they have reached.
    """
    dims = tree.dimensions
    open_, placed = [_Node(0, tree.n)], rows.withColumn("_kd_node", F.lit(0))
    while open_ := [x for x in open_ if x.leaves > 1]:
        spans = [f(c).alias(f"{c}{i}") for c in dims for i, f in enumerate((F.min, F.max))]
        stats = {r["_kd_node"]: r for r in placed.groupBy("_kd_node").agg(F.sum("_kd_bytes").alias("bytes"), *spans).collect()}
        if not tree.levels:
            whole = [max(1, stats[0][f"{c}1"] - stats[0][f"{c}0"]) for c in dims]
        nodes = [x for x in open_ if x.first in stats]
        for x in nodes:
            r = stats[x.first]
            x.dim = max(range(len(dims)), key=lambda i: (r[f"{dims[i]}1"] - r[f"{dims[i]}0"]) / whole[i])
            x.lo = r[f"{dims[x.dim]}0"] << 32
            x.hi = (r[f"{dims[x.dim]}1"] << 32) | 0xFFFFFFFF
            x.target = r["bytes"] * x.left / x.leaves
        keyed = written(tree.keyed(placed, nodes), "level")
        while todo := [x for x in nodes if not x.exact and not x.cut]:
            _narrow(keyed, todo)
        if todo := [x for x in nodes if not x.cut]:
            _finish(keyed, todo)
        tree.levels.append(nodes)
        placed = tree.step(keyed, nodes)
        open_ = [y for x in nodes for y in (_Node(x.first, x.left), _Node(x.first + x.left, x.leaves - x.left))]


def shard(
    docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
    key: str = "doc_id", text: str = "text", by: Sequence[str] = (),
) -> DataFrame:
    """Every column and row of ``docs``, with ``shard``, ``slot``, ``size`` and
    ``text_crc32`` added.

    Give the number of shards or the bytes a shard should have. The dimensions are a
    text's bytes, bytes per character and lines; ``by`` adds metadata columns. Equal
    texts agree in the first three, so copies share a shard unless a cut falls among them. A row's size is the
    UTF-8 bytes of its text plus one (NULL text: one). Shards differ in bytes by about
    one row. ``slot`` counts the rows of a shard from 0 without gaps. Columns of ``docs``
    with these names are replaced. NULL metadata count as empty. Rows with
    the same key and text are not separated; an empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot", "size", "text_crc32")
    tagged = _dimensions(docs, key, text, by)
    dims = [f"_kd_dim{i}" for i in range(3 + len(by))]
    hidden = ["_kd_bytes", "_kd_crc", "_kd_second", *dims]
    rows = written(tagged.select(*hidden), "metadata")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_kd_bytes").alias("bytes")).first()
    if n_shards is None:
        n_shards = max(1, math.ceil((totals["bytes"] or 0) / target_bytes))
    tree = _Tree(n_shards, dims)
    if totals["n"]:
        _grow(rows, tree)

    # Slots: number the rows of each chunk of a shard, after the rows of the chunks before.
    chunks = max(MIN_CHUNKS, math.ceil(totals["n"] / n_shards / ROWS_PER_CHUNK))
    chunk = F.pmod(F.xxhash64("_kd_second", "_kd_crc"), F.lit(chunks)).cast("int")
    order = Window.partitionBy("shard", "_kd_chunk").orderBy("_kd_second", "_kd_crc")
    before = Window.partitionBy("shard").orderBy("_kd_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sharded = lambda df: tree.place(df).withColumnRenamed("_kd_node", "shard").withColumn("_kd_chunk", chunk)
    start = (
        sharded(rows).groupBy("shard", "_kd_chunk").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "_kd_chunk", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_kd_start"))
    )
    numbered = sharded(tagged).withColumn("_kd_row", F.row_number().over(order) - 1)
    return numbered.join(start, ["shard", "_kd_chunk"]).select(
        *docs.columns, "shard", (F.col("_kd_start") + F.col("_kd_row")).alias("slot"), F.col("_kd_bytes").alias("size"),
        F.col("_kd_crc").alias("text_crc32"))
