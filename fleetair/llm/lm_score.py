"""Language-model scores by deleted interpolation of word bigrams.

The probability of a token after another mixes maximum-likelihood estimates: the
bigram's, the word's, and an equal share for each word of the vocabulary and one that
is unseen. The bigram's weight depends on how often its first word was seen, in
powers of two. One training document in ten is deleted from the counts, and
expectation-maximisation finds the weights that make the deleted tokens likeliest, first
the word's weight and then the bigrams'; the scores then use these weights with
the counts of all training documents.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm import blocks as bl
from fleetair.llm.blocks import block_ids, give_back, halves, in_order, joined, numbering, word_lists
from fleetair.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens after which a block is full; a longer text is a block of its own.
BLOCK_TOKENS = 1 << 19
#: One training document in this many is deleted from the counts that weights are learned with.
DELETED = 10
#: Change of a weight by a step at which it is settled.
SETTLED = 1e-9
#: Deleted bigrams are put together by the logarithm of how much likelier the bigram's estimate is
#: than the word's, in this many parts of a unit; the mean of each part stands for it.
PARTS = 64
#: Powers of two that a count can have.
LEVELS = 63

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words are not empty and hold no space, so these two names are free.
_END, _START = b"", b" "
_ONE, _MIX, _STIR = np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Weights:
    """Weight of the bigram by power of two of its first word's count, and of the word."""

    bigram: tuple[float, ...] = (0.5,) * LEVELS
    word: float = 0.5


@dataclass
class _Block:
    """Documents on their way into a row of the table of blocks."""

    numbers: dict = field(default_factory=numbering)
    tokens: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    training: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    size: int = 0

    def add(self, key, text: bytes | None, training: bool) -> None:
        length = 1
        for words in word_lists((text or b"").translate(_LOWER)):
            self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            length += len(words)
        self.tokens.append(np.array([self.numbers[_END]], np.int32))
        self.keys.append(key)
        self.training.append(training)
        self.lengths.append(length)
        self.size += length

    def row(self, block: int, deleted: bool, schema: pa.Schema) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        # The commonest words get the smallest numbers, which pack well.
        order = np.argsort(-np.bincount(tokens), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        names = np.array([xxhash.xxh64_intdigest(w) for w in self.numbers], np.uint64)[order]
        learned = int(np.array(self.lengths)[np.array(self.training, bool)].sum())
        values = [block, deleted, learned, self.keys, self.training, self.lengths, *halves(rank[tokens]), names.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


def _packed(docs: DataFrame, training: Column, key: str, text: str) -> DataFrame:
    """The table of blocks. Deleted documents are in blocks of their own."""
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    rows = rows.withColumn("deleted", F.col("training") & (F.pmod(F.xxhash64(F.lit("deleted"), "key"), F.lit(DELETED)) == 0))
    names = ("block", "deleted", "learned", "keys", "training", "lengths", "low", "high", "names")
    kinds = ("long", "boolean", "long", f"array<{key_type}>", "array<boolean>", "array<int>", "array<short>", "array<short>", "array<long>")

    def pack(batches):
        arrow, ids, open_ = None, block_ids(), {False: _Block(), True: _Block()}
        for batch in batches:
            if arrow is None:
                lists = (pa.list_(t) for t in (batch.schema.field("key").type, pa.bool_(), pa.int32(), pa.int16(), pa.int16(), pa.int64()))
                arrow = pa.schema(zip(names, (pa.int64(), pa.bool_(), pa.int64(), *lists), strict=True))
            for key_, text_, training_, deleted in zip(*(batch.column(c) for c in ("key", "text", "training", "deleted")), strict=True):
                deleted = deleted.as_py()
                open_[deleted].add(key_.as_py(), text_.as_py(), training_.as_py())
                if open_[deleted].size >= BLOCK_TOKENS:
                    yield open_[deleted].row(next(ids), deleted, arrow)
                    open_[deleted] = _Block()
                    give_back()
        for deleted, block in open_.items():
            if block.size:
                yield block.row(next(ids), deleted, arrow)
        block = None
        open_.clear()
        give_back()

    return bl.stored(rows.mapInArrow(pack, ", ".join(map(" ".join, zip(names, kinds, strict=True)))), "blocks", bl.TEXTS_AT_ONCE, bl.BLOCKS_AT_ONCE)


@dataclass(frozen=True)
class _Grams:
    """Words and bigrams of a block: ``keys`` ascending, and where each stands in them."""

    tokens: np.ndarray
    lengths: np.ndarray
    training: np.ndarray
    keys: np.ndarray
    words: np.ndarray  # of each distinct word
    pairs: np.ndarray  # of each token with the one before
    starts: np.ndarray
    end: int  # the number of the token that ends a text


def _grams(row: dict) -> _Grams:
    low, high, lengths, names = (row[c].values.to_numpy() for c in ("low", "high", "lengths", "names"))
    tokens = joined(low, high)
    training = row["training"].values.to_numpy(zero_copy_only=False)
    names = names.view(np.uint64)
    starts = np.append(0, np.cumsum(lengths[:-1], dtype=np.int64))
    own = names[tokens]
    before = np.append(np.uint64(0), own[:-1])
    before[starts] = np.uint64(xxhash.xxh64_intdigest(_START))
    pair = before * _MIX + own
    pair = (pair ^ (pair >> np.uint64(32))) * _STIR
    # Words have odd keys, bigrams even ones.
    keys, where = np.unique(np.concatenate([names | _ONE, (pair ^ (pair >> np.uint64(29))) & ~_ONE]), return_inverse=True)
    return _Grams(tokens, lengths, training, keys, where[: len(names)], where[len(names) :], starts, int(tokens[-1]))


def _counted(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct words and bigrams with their training counts."""
    g = _grams(row)
    learned = np.repeat(g.training, g.lengths).astype(float)
    n = np.bincount(g.pairs, weights=learned, minlength=len(g.keys))
    per_word = np.bincount(g.tokens, weights=learned, minlength=len(g.words))
    return g.keys, n + np.bincount(g.words, weights=per_word, minlength=len(g.keys))


def _vocabulary(keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.array([0]), np.array([int(((keys & _ONE).astype(bool) & (total > 0)).sum())])


def _looked_up(g: _Grams, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the counts of its bigram, of the token before and of itself.

    A text's start was seen as often as its end.
    """
    of_word = count[g.words]
    own = of_word[g.tokens]
    before = np.append(0, own[:-1])
    before[g.starts] = of_word[g.end]
    return count[g.pairs], before, own


def _level(count: np.ndarray) -> np.ndarray:
    """The power of two at or below a count; -1 for 0."""
    return np.frexp(count.astype(float))[1] - 1


def _row(table: pa.Table) -> dict:
    return {c: table[c][0] for c in table.schema.names}


def mixture_weight(ratio: np.ndarray, n: np.ndarray) -> float:
    """Expectation-maximisation for the weight of one estimate against another, from how
    many times as likely as the other it finds ``n`` tokens.

    As if one more token had been half of it, so that no weight is 0 or 1.
    """
    weight, whole = 0.5, n.sum()
    while True:
        part = float((n * weight * ratio / (weight * ratio + 1 - weight)).sum())
        before, weight = weight, (part + 0.5) / (whole + 1)
        if abs(weight - before) <= SETTLED:
            return weight


def learn(events: DataFrame, n_tokens: int, vocabulary: int) -> Weights:
    """Weights from ``level, pair, before, own, n``: deleted bigrams with their counts elsewhere.

    The driver gets a row per distinct count of a word, of which there are at most as many as the
    root of twice the tokens, and one per level and part of the ratios.
    """
    n_tokens, unseen = max(1, n_tokens), 1.0 / (vocabulary + 1)
    per_count = events.groupBy("own").agg(F.sum("n").alias("n")).toArrow()
    if not per_count.num_rows:
        return Weights()
    own, n = (per_count[c].to_numpy().astype(float) for c in ("own", "n"))
    word = mixture_weight(own / n_tokens / unseen, n)
    single = F.lit(word / n_tokens) * F.col("own") + F.lit((1 - word) * unseen)
    ratio = F.log(F.col("pair") / F.col("before") / single)
    seen = events.where("before > 0").select("level", "n", F.when(F.col("pair") > 0, ratio).alias("r"))
    parts = seen.groupBy("level", F.floor(F.col("r") * PARTS).alias("part")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("r")).toArrow().to_pandas()
    parts["ratio"] = np.exp(parts["r"] / parts["n"]).where(parts["part"].notna(), 0.0)
    parts = parts.sort_values(["level", "ratio"])
    pooled = mixture_weight(parts["ratio"].to_numpy(), parts["n"].to_numpy().astype(float))
    of = {level: mixture_weight(p["ratio"].to_numpy(), p["n"].to_numpy().astype(float)) for level, p in parts.groupby("level")}
    return Weights(tuple(of.get(b, pooled) for b in range(LEVELS)), word)


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, training, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``training`` tells the rows to learn from; NULL is no. Tokens are the words of the whole text,
    A-Z lower-cased, and one end. ``base_score`` is the log10 probability under word
    counts plus a half, ``score`` under the interpolated model. NULL and empty texts are
    one end; repeated rows count and are scored as often as they stand there. Without
    training rows every token has an equal share of the unseen. Words are told apart by
    64 bits of hash. An empty table gives an empty one.
    """
    blocks = _packed(docs, training, key, text)
    size = blocks.agg(
        F.sum("learned").alias("learned"), F.sum(F.when(F.col("deleted"), F.col("learned"))).alias("deleted"),
        F.sum(F.size("low")).alias("tokens")).first()
    n_tokens, n_deleted = size["learned"] or 0, size["deleted"] or 0
    buckets = max(1, -(-(size["tokens"] or 0) // bl.BUCKET_ENTRIES))
    counts = bl.stored(bl.totals(blocks, _counted, buckets, _vocabulary), "counts")
    vocabulary = counts.agg(F.sum(F.get("vals", F.lit(0)))).first()[0] or 0

    def deleted_bigrams(block: pa.Table, count: pa.Table) -> pa.Table:
        g = _grams(_row(block))
        pair, before, own = _looked_up(g, in_order(count, "kept"))
        found = pd.DataFrame({"level": _level(before), "pair": pair, "before": before, "own": own})
        found = found.groupby(list(found.columns), sort=False).size().reset_index(name="n")
        return pa.Table.from_pandas(found, preserve_index=False).cast(pa.schema([(c, pa.int64()) for c in found.columns]))

    events = (
        blocks.where("deleted").groupBy("block").cogroup(counts.where("kept IS NOT NULL").select("block", "bucket", "kept").groupBy("block"))
        .applyInArrow(deleted_bigrams, "level long, pair long, before long, own long, n long")
        .groupBy("level", "pair", "before", "own").agg(F.sum("n").alias("n"))
    )
    weights = learn(written(events, "deleted"), n_tokens - n_deleted, vocabulary)
    bigram, word = np.array(weights.bigram), weights.word

    def scored(block: pa.Table, count: pa.Table) -> pa.Table:
        row = _row(block)
        g = _grams(row)
        pair, before, own = _looked_up(g, in_order(count, "total"))
        lam = np.where(before > 0, bigram[np.maximum(_level(before), 0)], 0.0)
        single = word * own / max(1, n_tokens) + (1 - word if n_tokens else 1.0) / (vocabulary + 1)
        p = lam * pair / np.maximum(before, 1) + (1 - lam) * single
        base = np.log10((own + 0.5) / (n_tokens + 0.5 * (vocabulary + 1)))
        return pa.table([
            row["keys"].values, pa.array(g.training), pa.array(g.lengths.astype(np.int64)),
            pa.array(np.add.reduceat((own > 0).astype(np.int64), g.starts)),
            pa.array(np.full(len(g.lengths), n_tokens)),
            pa.array(np.add.reduceat(base, g.starts)), pa.array(np.add.reduceat(np.log10(p), g.starts)),
        ], names=names)

    names = ("key", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (docs.schema[key].dataType.simpleString(), "boolean", "long", "long", "long", "double", "double")
    return (
        blocks.groupBy("block").cogroup(counts.select("block", "bucket", "total").groupBy("block"))
        .applyInArrow(scored, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
        .withColumnRenamed("key", key)
    )
