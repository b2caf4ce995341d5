"""SimHash near-duplicates through an inverted index on positional bytes.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of
their eight bytes, and so in at least four of the first seven. The index has one
posting list for every choice of four of these seven positions and their values.
Fingerprints that meet in a list are tallied: pairs that agree in five or more
positional bytes are kept and then verified bit by bit. Equal fingerprints are one
vertex; long lists are cut into tiles, and a tile gives a spanning forest of its
links instead of all pairs, which leaves the components unchanged.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm.common import free_name, sent, text_bytes, written
from fleetair.llm.components import connected

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Eight bytes, of which at most MAX_BITS can hold a differing bit.
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Leaving one position out of the index still leaves this many shared in it.
KEY_BYTES = MIN_SHARED_BYTES - 1
KEY_POSITIONS = list(itertools.combinations(range(7), KEY_BYTES))
#: Fingerprints of a long posting list that one tile holds, about.
TILE = 512
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 22

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\v\f\r"


def _word_pieces(data: bytes):
    """The words in lists; each list after the first starts with the last two words
    of the one before, so that every shingle lies in one list."""
    at, carry = 0, []
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        words = carry + data[at:end].split()
        if end < len(data) and len(words) < SHINGLE_WORDS:
            carry = words
        else:
            yield words
            carry = words[1 - SHINGLE_WORDS :]
        at = end


def simhash(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 if it has no word."""
    ones, total, few = np.zeros(64, dtype=np.int64), 0, []
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    for words in _word_pieces(data):
        if len(words) < SHINGLE_WORDS:
            few = words
            continue
        few = []
        line = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.append(0, end[:-1] + 1)
        spans = zip(start[: 1 - SHINGLE_WORDS].tolist(), end[SHINGLE_WORDS - 1 :].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(line[a:b], SEED) for a, b in spans])
        h = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    if not total and few:
        ones += np.unpackbits(np.frombuffer(xxhash.xxh64_digest(b" ".join(few), SEED), np.uint8))
        total = 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long, whose bits are the fingerprint's."""
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        found = np.array([simhash(x.as_py()) for x in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return prints(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (7 - position)).bitwiseAND(F.lit(255))


def index_keys(fp: Column) -> Column:
    """The posting lists of a fingerprint: which positions, then their bytes."""
    keys = []
    for number, positions in enumerate(KEY_POSITIONS):
        key = F.lit(number).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        keys.append(key)
    return F.array(*keys)


def _shared_bytes(a: Column, b: Column) -> Column:
    tally = F.lit(0)
    for p in range(8):
        tally = tally + (_byte(a, p) == _byte(b, p)).cast("int")
    return tally


def _linked(a: Column, b: Column) -> Column:
    """Enough shared positional bytes, then at most MAX_BITS differing bits."""
    return (_shared_bytes(a, b) >= MIN_SHARED_BYTES) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth first."""
    code = fps.view(np.uint64)
    bytes_ = fps.view(np.uint8).reshape(-1, 8)
    open_ = np.ones(len(fps), dtype=bool)
    left, right = [], []
    for first in range(len(fps)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                return left, right
            shared = (bytes_[rest] == bytes_[at]).sum(axis=1)
            rest = rest[shared >= MIN_SHARED_BYTES]
            near = rest[np.bitwise_count(code[rest] ^ code[at]) <= MAX_BITS]
            open_[near] = False
            left += [int(fps[at])] * len(near)
            right += fps[near].tolist()
            queue += near.tolist()
    return left, right


def links(fps: DataFrame) -> DataFrame:
    """Linked pairs ``u, v`` of distinct fingerprints ``fp``, enough to connect all
    that linked pairs connect."""
    postings = fps.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    lists = written(
        postings.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1"), "postings")
    twos = lists.where("n = 2").where(_linked(F.col("u"), F.col("v"))).select("u", "v")

    # Longer lists: every fingerprint meets every tile of its list.
    longer = lists.where("n > 2").select("key", F.ceil(F.col("n") / TILE).alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    tiled = (
        postings.join(longer, "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
                "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )

    def connect(batches):
        def edges(cols, last):
            key, a, b, fp = cols
            cut = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            bounds = [0, *cut.tolist()] + ([len(fp)] if last else [])
            left, right = [], []
            for s, e in itertools.pairwise(bounds):
                x, y = forest(fp[s:e])
                left += x
                right += y
            rest = [c[bounds[-1] :] for c in cols] if not last else None
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"]), rest

        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "a", "b", "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            out, held = edges(cols, last=False)
            yield out
        if held is not None and len(held[0]):
            yield edges(held, last=True)[0]

    forests = (
        tiled.repartition("tile").sortWithinPartitions("tile", "key", "a", "b")
        .select("key", "a", "b", "fp").mapInArrow(connect, "u long, v long")
    )
    return twos.union(forests).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id`` for every row.

    ``component_id`` is the smallest key that linked fingerprints lead to. NULL and
    empty texts have fingerprint 0 and link like any other; a repeated row gets its
    component each time, and a NULL key its own row with the component of its text.
    """
    prints = written(
        docs.select(F.col(key).alias("_key"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    roots = _roots(prints, F.min("_key"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    component = roots.join(least, "root").select("fp", "component_id")
    return prints.join(component, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def _roots(prints: DataFrame, first: Column) -> DataFrame:
    """``fp, first, root``: one row per fingerprint; those without links are their own root."""
    firsts = prints.groupBy("fp").agg(first.alias("first"))
    linked = connected(links(firsts.select("fp"))).select(F.col("vertex").alias("fp"), "root")
    return firsts.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near-duplicates: the smallest key, NULL last.

    Of rows that share this key in a group the one with the smallest hash of its text
    stays, of rows with the same key and text any one. A key with different texts
    has a row in every group of which it is the smallest.

    Who goes is decided on keys and hashes alone. Texts are not moved while the list of
    those that go, keys and hashes, has at most ``common.MAX_SENT_BYTES``, which is measured.
    """
    of = F.xxhash64(F.col(text))
    prints = written(
        docs.select(F.col(key).alias("_key"), of.alias("_of"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    roots = _roots(prints, F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_of")))
    stay = roots.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first._key").alias("_stay"), F.col("first._of").alias("_stay_of"), F.lit(True).alias("_stays"))
    rows = prints.groupBy("_key", "_of").agg(F.count(F.lit(1)).alias("_n"))
    chosen = rows["_key"].eqNullSafe(stay["_stay"]) & (rows["_of"] == stay["_stay_of"])
    listed = written(
        rows.join(stay, chosen, "left").where("_stays IS NULL OR _n > 1")
        .select("_key", "_of", F.col("_stays").isNotNull().alias("_again")), "goes")
    n, again = listed.agg(F.count(F.lit(1)), F.max("_again")).first()
    if not n:
        return docs
    width = 24 + text_bytes(F.col("_key"))
    of_name = free_name(docs, "_near_of")
    marked = docs.withColumn(of_name, of)
    goes = sent(listed, width)
    same = marked[key].eqNullSafe(goes["_key"]) & (marked[of_name] == goes["_of"])
    kept = marked.join(goes, same, "left_anti").drop(of_name)
    if not again:
        return kept
    # Repeated rows are brought together; only they are moved.
    often = sent(listed.where("_again"), width)
    same = marked[key].eqNullSafe(often["_key"]) & (marked[of_name] == often["_of"])
    return kept.union(marked.join(often, same, "left_semi").dropDuplicates([key, of_name]).drop(of_name))

