"""Alignment of two tokenizers' tokens over the same bytes.

A token and the bytes it covers are a row of an incidence matrix in compressed rows.
With A and B for the two tokenizers, the rows of A times B transposed, put together by
Gustavson's algorithm, are the overlap links of each A token. Offsets where tokens of
both end cut the bytes into groups, and the products of token-group incidence are the
links within groups.

Both tokenizers cut before a space that stands between two other characters, whatever
is around it. A text is therefore encoded as the units between such places, each
distinct unit of a block of documents once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetair.llm import blocks as bl
from fleetair.llm.blocks import block_ids, give_back, in_order, numbering

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units after which a block is full; a longer text is a block of its own.
BLOCK_UNITS = 3 << 17
#: Units aligned at a time, units encoded as one text, and products of matrix entries made at a time.
ALIGNED, TOGETHER, PRODUCTS = 1 << 13, 1 << 10, 1 << 20

_UNIT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Odd, so that multiplying spreads pairs and can be undone.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GATHER = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Rows:
    """A matrix in compressed rows: the columns of row i lie from ``first[i]`` to ``first[i + 1]``.

    ``value`` is 1 everywhere where it is None.
    """

    first: np.ndarray
    column: np.ndarray
    width: int
    value: np.ndarray | None = None

    def values(self) -> np.ndarray:
        return np.ones(len(self.column), np.int64) if self.value is None else self.value

    def transposed(self) -> Rows:
        order = np.argsort(self.column, kind="stable")
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        first = np.append(0, np.cumsum(np.bincount(self.column, minlength=self.width)))
        return Rows(first, row[order], len(self.first) - 1, self.values()[order])


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Of each row of ``a`` how many products its row of ``a`` times ``b`` adds up."""
    sums = np.append(0, np.cumsum(np.diff(b.first)[a.column]))
    return sums[a.first[1:]] - sums[a.first[:-1]]


def product(a: Rows, b: Rows) -> Rows:
    """``a`` times ``b`` by rows: a row is the sum of the rows of ``b`` that its entries
    name. Rows are taken together until they have ``PRODUCTS`` products."""
    sizes, columns, values, counts = product_sizes(a, b), [], [], [np.empty(0, np.int64)]
    cuts, at = [0], 0
    upto = np.cumsum(sizes)
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PRODUCTS, "right")))
        cuts.append(at)
    widths = np.diff(b.first)
    for lo, hi in zip(cuts, cuts[1:]):
        entries = slice(a.first[lo], a.first[hi])
        of = a.column[entries]
        n = widths[of]
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.first[lo : hi + 1])), n)
        where = np.repeat(b.first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = row * b.width + b.column[where]
        distinct, which = np.unique(key, return_inverse=True)
        columns.append(distinct % b.width)
        values.append(np.bincount(which, weights=np.repeat(a.values()[entries], n) * b.values()[where], minlength=len(distinct)).astype(np.int64))
        counts.append(np.bincount(distinct // b.width - lo, minlength=hi - lo))
    join = lambda x: np.concatenate([np.empty(0, np.int64), *x])
    return Rows(np.append(0, np.cumsum(np.concatenate(counts))), join(columns), b.width, join(values))


def byte_incidence(sizes: np.ndarray) -> Rows:
    """Tokens of so many bytes, one after the other, by the bytes they cover."""
    first = np.append(0, np.cumsum(sizes))
    return Rows(first, np.arange(first[-1]), int(first[-1]))


def group_incidence(sizes: np.ndarray, cuts: np.ndarray) -> Rows:
    """Tokens by the group they lie in; groups end at ``cuts``."""
    starts = np.cumsum(sizes) - sizes
    return Rows(np.arange(len(sizes) + 1), np.searchsorted(cuts, starts, "right"), len(cuts))


def byte_level_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it
    is visible Latin, else the next free one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Coders:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        names, vocabulary = byte_level_names(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(names[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece spans a space, so texts cannot be encoded by units")
        single = [_BYTE_PIECE.fullmatch(p) for p in pieces]
        self.bytes_b = [
            bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(single, pieces, strict=True)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text by A, after a space, and by B; None where the bytes differ."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        raw = (" " + text).encode()
        # A has a token for every byte and gives any text back; its tokens' sizes tell if it ever does not.
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if self.size_a[a].sum() != len(raw):
            return None
        return a, b

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units by A and by B, and how many of each a unit has; none where
        the bytes differ.

        Units that begin and end with other characters than spaces are encoded as one
        text, in which spaces stand between them.
        """
        out: list[list[np.ndarray]] = [[], []]
        n = np.zeros((2, len(units)), np.int64)

        def put(first: int, some: list[str], found) -> None:
            ends = np.cumsum([1 + len(u.encode()) for u in some])
            for side, (ids, size) in enumerate(zip(found, (self.size_a, self.size_b), strict=True)):
                upto = np.searchsorted(np.cumsum(size[ids]), ends, "right")
                n[side, first : first + len(some)] = np.diff(upto, prepend=0)
                out[side].append(ids)

        at = 0
        while at < len(units):
            end = at
            while end < len(units) and end - at < TOGETHER and units[end] and not (units[end][0].isspace() or units[end][-1].isspace()):
                end += 1
            some = units[at : max(end, at + 1)]
            found = self._ids(" ".join(some))
            if found is not None:
                put(at, some, found)
            elif len(some) > 1:
                for i, unit in enumerate(some):
                    one = self._ids(unit)
                    if one is not None:
                        put(at + i, [unit], one)
            at += len(some)
        empty = np.empty(0, np.int64)
        return *(np.concatenate([empty, *o]) for o in out), n[0], n[1]


@dataclass
class Aligned:
    """Units one after the other: numbers of each, and its links as A and B ids."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_shared: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    groups: list[str]


def _within(per_item: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``n`` items."""
    sums = np.append(0, np.cumsum(per_item))
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n]


def align_units(coders: Coders, units: list[str]) -> Aligned:
    """Aligns every unit; they are laid one after the other and no token leaves its unit."""
    parts = [_aligned(coders, units[k : k + ALIGNED]) for k in range(0, max(1, len(units)), ALIGNED)]
    arrays = [np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Aligned)[:-1]]
    return Aligned(*arrays, [g for p in parts for g in p.groups])


def _aligned(coders: Coders, units: list[str]) -> Aligned:
    ids_a, ids_b, n_a, n_b = coders.encode(units)
    size_a, size_b = coders.size_a[ids_a], coders.size_b[ids_b]
    a, b = byte_incidence(size_a), byte_incidence(size_b)
    overlaps = product(a, b.transposed())
    cuts = np.intersect1d(a.first[1:], b.first[1:], assume_unique=True)
    in_a, in_b = group_incidence(size_a, cuts), group_incidence(size_b, cuts)
    shared = product_sizes(in_a, in_b.transposed())  # a token is in one group, so none is added twice
    per_token = np.diff(overlaps.first)
    # The groups of each unit, and the tokens of each group.
    ends = np.append(0, np.cumsum(_within(size_a, n_a)))
    n_groups = np.diff(np.searchsorted(cuts, ends, "right"))
    in_group = [np.bincount(m.column, minlength=len(cuts)) for m in (in_a, in_b)]
    names = [[coders.names[i] for i in ids.tolist()] for ids in (ids_a, ids_b)]
    ends_a, ends_b = (np.cumsum(n).tolist() for n in in_group)
    spelled, a0, b0 = [], 0, 0
    for a1, b1 in zip(ends_a, ends_b):
        # Most groups have one token of each.
        spelled.append((names[0][a0] if a1 == a0 + 1 else ",".join(names[0][a0:a1])) + "|" + (names[1][b0] if b1 == b0 + 1 else ",".join(names[1][b0:b1])))
        a0, b0 = a1, b1
    upto = np.append(0, np.cumsum(n_groups)).tolist()
    return Aligned(
        n_a, n_b, n_groups, _within(shared, n_a), _within(per_token, n_a),
        np.repeat(ids_a, per_token), ids_b[overlaps.column], [";".join(spelled[s:e]) for s, e in zip(upto, upto[1:])])


@dataclass
class _Block:
    """Documents on their way into a row of the table of blocks."""

    numbers: dict = field(default_factory=numbering)
    units: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    size: int = 0

    def add(self, key, text: str | None) -> None:
        units = _UNIT.split(text) if text else []
        self.units.append(np.fromiter(map(self.numbers.__getitem__, units), np.int32, len(units)))
        self.keys.append(key)
        self.size += len(units) + 1

    def row(self, block: int, coders: Coders, schema: pa.Schema, digest: bool) -> pa.RecordBatch:
        found = align_units(coders, list(self.numbers))
        # A text with a unit that the tokenizers do not give back has no tokens.
        units = [u if (found.n_a[u] > 0).all() else u[:0] for u in self.units]
        lengths = np.array([len(u) for u in units], np.int64)
        used = np.concatenate(units)
        sums = [_within(x[used], lengths) for x in (found.n_a, found.n_b, found.n_groups, found.n_shared, found.n_links)]
        texts = (";".join([found.groups[i] for i in u.tolist()]) for u in units)
        groups = [hashlib.sha256(t.encode()).hexdigest() if digest and t else t for t in texts]
        # The commonest units get the smallest numbers, which pack well.
        order = np.argsort(-np.bincount(used, minlength=len(found.n_a)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        pairs, link = np.unique(_pair_keys(found.link_a, found.link_b), return_inverse=True)
        starts = np.cumsum(found.n_links) - found.n_links
        n = found.n_links[order]
        moved = np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        values = [block, False, self.keys, *sums, groups, lengths, rank[used], n, link[moved], _b_ids(pairs), pairs.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b.astype(np.uint64) << np.uint64(32) | a.astype(np.uint64)) * _SPREAD


def _b_ids(keys: np.ndarray) -> np.ndarray:
    return ((keys * _GATHER) >> np.uint64(32)).astype(np.int64)


def _linked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct id pairs and how many links hold each."""
    units, per_unit, links, pairs = (row[c].values.to_numpy() for c in ("units", "per_unit", "links", "pairs"))
    n = np.bincount(units, minlength=len(per_unit))
    return pairs.view(np.uint64), np.bincount(links, weights=np.repeat(n, per_unit), minlength=len(pairs))


def _highest(keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest total among the pairs of each B id."""
    ids, which = np.unique(_b_ids(keys), return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, which, total)
    return ids, most


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, digest: bool = False
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups`` of every row.

    ``n_links`` is the number of overlap links, ``n_shared`` of links within groups.
    ``count_sum`` adds up, over the overlap links, how many links of the corpus have the same ids, and
    ``n_best`` tells how many links have the pair that their B id has most often.
    ``groups`` spells the groups, A ids before B ids; with ``digest`` it is the SHA-256 of that in
    hexadecimal, which spares moving several bytes for each byte of text. A NULL or empty text, and one whose
    bytes a tokenizer does not give back, has zeros and an empty string. Repeated rows count as
    often as they stand there. ``folder`` holds the vocabulary files, which the driver
    reads. What grows with a text is a number for each unit; a text without spaces is one unit.
    """
    with open(os.path.join(folder, BYTE_BPE), encoding="utf-8") as a, open(os.path.join(folder, PIECE_BPE), "rb") as b:
        byte_bpe, piece_bpe = json.dumps(json.load(a)), b.read()
    key_type = docs.schema[key].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_shared", "n_links"]
    columns = {
        "block": "long", "deleted": "boolean", "keys": f"array<{key_type}>", **dict.fromkeys(numbers, "array<long>"),
        "groups": "array<string>", **dict.fromkeys(("lengths", "units", "per_unit", "links", "b_ids"), "array<int>"), "pairs": "array<long>"}

    def pack(batches):
        coders, ids, block, arrow = Coders(byte_bpe, piece_bpe), block_ids(), _Block(), None
        for batch in batches:
            if arrow is None:
                kinds = [batch.schema.field("key").type, *[pa.int64()] * 5, pa.string(), *[pa.int32()] * 5, pa.int64()]
                arrow = pa.schema(zip(columns, [pa.int64(), pa.bool_(), *map(pa.list_, kinds)], strict=True))
            for key_, text_ in zip(batch.column("key"), batch.column("text"), strict=True):
                block.add(key_.as_py(), text_.as_py())
                if block.size >= BLOCK_UNITS:
                    yield block.row(next(ids), coders, arrow, digest)
                    block = _Block()
                    give_back()
        if block.size:
            yield block.row(next(ids), coders, arrow, digest)
        block = coders = None
        give_back()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = bl.stored(rows.mapInArrow(pack, ", ".join(map(" ".join, columns.items()))), "blocks", bl.TEXTS_AT_ONCE, bl.BLOCKS_AT_ONCE)
    entries = blocks.agg(F.sum(F.size("pairs"))).first()[0] or 0
    buckets = max(1, -(-entries // bl.BUCKET_ENTRIES))
    sent = blocks.select("block", "deleted", "units", "per_unit", "links", "pairs")
    counts = bl.stored(bl.totals(sent, _linked, buckets, _highest), "counts")
    # One row per B id, as many as the vocabulary has.
    highest = counts.select(F.inline(F.arrays_zip("ids", "vals"))).groupBy("ids").agg(F.max("vals").alias("most")).toArrow()
    most = np.zeros(1 + max(highest["ids"].to_pylist(), default=0), np.int64)
    most[highest["ids"].to_numpy()] = highest["most"].to_numpy()

    def counted(block: pa.Table, count: pa.Table) -> pa.Table:
        row = {c: block[c][0].values for c in block.schema.names if c != "block"}
        lengths, units, per_unit, links, b_ids = (row[c].to_numpy() for c in ("lengths", "units", "per_unit", "links", "b_ids"))
        total = in_order(count, "total") if count.num_rows else np.empty(0, np.int64)
        best = (total == most[b_ids]).astype(np.int64)
        sums = [_within(_within(x[links], per_unit)[units], lengths) for x in (best, total)]
        found = {**{c: row[c] for c in numbers}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table([row["keys"], *(found[c] for c in names[1:-1]), row["groups"]], names=names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups"]
    out = f"key {key_type}, {', '.join(f'{c} long' for c in names[1:-1])}, groups string"
    return (
        blocks.drop("deleted", "pairs").groupBy("block").cogroup(counts.select("block", "bucket", "total").groupBy("block"))
        .applyInArrow(counted, out).withColumnRenamed("key", key)
    )
