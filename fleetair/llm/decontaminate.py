"""Benchmark decontamination by winnowing.

Both sides are cut into words. The k-grams of words are hashed, and of every run of
so many consecutive k-grams as 13 words have the smallest hash is a fingerprint. Any 13 words
that both sides share hold such a run, whose smallest hash is chosen on both sides,
so no shared span of 13 words is missed. Items of fewer words are winnowed in classes of their
lengths, with smaller grams and runs that fit the shortest of the class. Where fingerprints
meet, the hit is extended: every window around it is compared with the benchmark's
windows as text. Every text is cut into words once, for its fingerprints and for the
number of its words; only texts with hits are read again. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm.common import ascii_lower, sent, text_bytes, written

SPAN_WORDS = 13
#: Classes of window lengths that are winnowed alike, shortest and longest.
CLASSES = ((13, 13), (7, 12), (4, 6), (2, 3), (1, 1))
#: A fingerprint is a hash of 33 bits with its position in 30 bits below it.
POSITION_BITS = 30
#: The class of rows that hold a text's number of words in place of a position.
COUNT = -1

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER_BEYOND_ASCII = r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^\x00-\x7F]]"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; NULL has none."""
    # lower() is many times faster than translate() and the same where only A-Z changes.
    low = F.when(text.rlike(_UPPER_BEYOND_ASCII), ascii_lower(text)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def text_hash(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def _gram_hash(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(size)])


@dataclass(frozen=True)
class Class:
    """Windows of the lengths ``lens``, of which ``span`` is the shortest, and how they are winnowed."""

    lens: tuple[int, ...]

    @property
    def span(self) -> int:
        return self.lens[0]

    @property
    def gram(self) -> int:
        """Words of a gram: about half of the shortest window."""
        return max(1, self.span // 2)

    @property
    def run(self) -> int:
        """Grams of a run, which are those of the shortest window."""
        return self.span - self.gram + 1


def with_word_hashes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``h``, an array with the hash of every word."""
    cut = df.select(*keep, words(F.col(text)).alias("w"))
    return cut.select(*keep, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def winnowed(hashed: DataFrame, classes: Sequence[Class], *keep: str, count: Column | None = None) -> DataFrame:
    """A row per fingerprint: the distinct minima, ``cls``, ``hash`` and ``pos``, over runs of
    the grams of each class. Fewer words than the shortest window give none. With ``count``, a
    hash of the row's key, each row gives one of the class ``COUNT`` besides: ``pos`` is its
    number of words and ``hash`` a part of ``count``, which spreads these rows in a join.

    Every step is a column of its own: an array that a lambda looks into must be
    there already, or it would be computed again for each element.
    """
    h, low = F.col("h"), F.lit((1 << 33) - 1)

    def grams(c: Class) -> Column:
        return F.transform("h", lambda _, i: F.shiftleft(
            _gram_hash(h, i, c.gram).bitwiseAND(low), POSITION_BITS).bitwiseOR(i.cast("long")))

    numbers = range(len(classes))
    rows = hashed.select(*keep, F.size("h").alias("n"), *[grams(c).alias(f"v{k}") for k, c in enumerate(classes)])
    width = 1
    # Minima over twice as many grams, as long as these fit into a run.
    while any(2 * width <= c.run for c in classes):
        def twice(k: int, width: int = width) -> Column:
            v = F.col(f"v{k}")
            return F.transform(v, lambda x, i: F.least(x, F.get(v, i + width))).alias(f"v{k}") if 2 * width <= classes[k].run else v
        rows = rows.select(*keep, "n", *[twice(k) for k in numbers])
        width *= 2

    def minima(k: int) -> Column:
        """Two minima that overlap make one over the whole run; only whole windows count."""
        c, v = classes[k], F.col(f"v{k}")
        rest = c.run - (1 << (c.run.bit_length() - 1))
        whole = F.transform(v, lambda x, i: F.least(x, F.get(v, i + rest))) if rest else v
        return F.array_distinct(F.slice(whole, F.lit(1), F.greatest(F.lit(0), F.col("n") - (c.span - 1))))

    rows = rows.select(*keep, "n", *[minima(k).alias(f"v{k}") for k in numbers])
    # (A parameter more would make Spark pass the index to it.)
    def named(k: int) -> Column:
        return F.transform(f"v{k}", lambda f: F.struct(F.lit(k).alias("cls"), f.alias("f")))

    every = [named(k) for k in numbers]
    if count is not None:
        counted = F.shiftleft(count.bitwiseAND(low), POSITION_BITS).bitwiseOR(F.col("n").cast("long"))
        every.append(F.array(F.struct(F.lit(COUNT).alias("cls"), counted.alias("f"))))
    return rows.select(*keep, F.inline(F.concat(*every))).select(*keep, "cls", _hash_part(F.col("f")).alias("hash"), _position_part(F.col("f")).alias("pos"))


def _hash_part(fingerprint: Column) -> Column:
    return F.shiftrightunsigned(fingerprint, POSITION_BITS)


def _position_part(fingerprint: Column) -> Column:
    return fingerprint.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """``item, window, len``: 13 consecutive words, or a shorter item as a whole."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - SPAN_WORDS))
    return (
        benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.least(F.size("w"), F.lit(SPAN_WORDS)).alias("len"),
                F.explode(F.transform(starts, lambda s: F.slice(w, s + 1, SPAN_WORDS))).alias("words"))
        .select("item", "len", F.array_join("words", " ").alias("window"),
                F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"))
        .distinct()
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document row: ``key, text_hash, n_words, n_hit, n_items, item_ids,
    contaminated``; ``text_hash`` is Spark's xxhash64 of the text, 0 for NULL.

    A word inside any occurrence of a benchmark window is hit. ``item_ids`` are the
    items with occurring windows, as sorted strings (a NULL id is the empty string).
    A document is contaminated if at least one word in twenty is hit. Documents
    without words, an empty benchmark and NULL texts have no hits; repeated rows each
    get their result.
    """
    base = docs.select(F.col(key).alias("_key"), text_hash(F.col(text)).alias("_of"), F.col(text).alias("_text"))
    same = ["_key", "_of"]

    windows = written(_item_windows(benchmark, item, item_text), "windows")
    there = sorted(r[0] for r in windows.select("len").distinct().collect())  # thirteen numbers at most
    lengths = [tuple(n for n in there if lo <= n <= hi) for lo, hi in CLASSES]
    classes = [Class(x) for x in lengths if x]
    if not classes:
        classes = [Class((SPAN_WORDS,))]

    # Fingerprints that both sides have, where they are in the documents. An item of a class of
    # short windows is a window itself.
    of_len = reduce(lambda c, k: F.when(F.col("len").isin(*classes[k].lens), k).otherwise(c), range(len(classes)), F.lit(-1))
    item_prints = sent(written(
        winnowed(windows.select(of_len.alias("own"), F.col("hashes").alias("h")), classes, "own")
        .where("own = cls").select("cls", "hash").distinct().withColumn("shared", F.lit(True)), "prints"), F.lit(24))
    prints = winnowed(with_word_hashes(base, "_text", *same), classes, *same, count=F.xxhash64(*same))
    met = prints.join(item_prints, ["cls", "hash"], "left").where((F.col("cls") == COUNT) | F.col("shared"))
    read = written(met.select(*same, "pos", "cls"), "read")
    touched = _touched(base, read.where(F.col("cls") != COUNT), same)

    # Extend: the text of every window around a hit, compared with the items' windows.
    w, n = F.col("w"), F.size("w")

    def around(x: Column) -> Column:
        def spans(c: Class, size: int) -> Column:
            starts = F.filter(F.sequence(x["pos"] - (size - c.gram), x["pos"]), lambda s: (s >= 0) & (s <= n - size))
            return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("len")))

        def windows_of(c: Class) -> Column:
            return F.flatten(F.array(*[spans(c, size) for size in c.lens]))

        none = F.array().cast("array<struct<start: int, len: int>>")
        return reduce(lambda out, k: F.when(x["cls"] == k, windows_of(classes[k])).otherwise(out), range(len(classes)), none)

    near = F.array_distinct(F.flatten(F.transform("hits", around)))
    candidates = (
        touched.select(*same, words(F.col("_text")).alias("w"), "hits").select(*same, "w", near.alias("near"))
        .select(*same, F.inline(F.transform("near", lambda c: F.struct(
            c["start"].alias("start"), (c["start"] + c["len"]).alias("end"),
            F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ").alias("window")))))
    )
    # Windows with the same set of items share a number, so that a window of many
    # items is not spelled out at each of its occurrences.
    sets = written(
        windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("set", F.sha2(F.to_json("items"), 256)), "windowsets")
    found = written(
        candidates.join(sent(sets.select("window", "set"), F.octet_length("window") + 96), "window")
        .groupBy(*same, "set").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")

    covered = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n")),
    )["n"]
    hit_words = found.groupBy(*same).agg(covered.alias("n_hit"))
    items = (
        found.select(*same, "set").join(sets.select("set", "items").dropDuplicates(["set"]), "set")
        .select(*same, F.explode("items").alias("item")).groupBy(*same)
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    marks = _same_rows(hit_words, items, same)
    counted = read.where(F.col("cls") == COUNT).select(*same, F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        _same_rows(counted, marks, same, "left")
        .select(
            F.col("_key").alias(key), F.col("_of").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
    )


def _touched(base: DataFrame, hits: DataFrame, same: list[str]) -> DataFrame:
    """``_key, _of, _text, hits``: one row per key and text with hits, each hit once.

    Copies of a row have the same hits; both are reduced before they meet in a task. Texts without
    hits are not moved while the lists of hits, which are measured, go to every executor.
    """
    lists = written(hits.groupBy(*same).agg(F.collect_set(F.struct("pos", "cls")).alias("hits")), "hits")
    few = sent(lists, 32 + text_bytes(F.col("_key")) + 24 * F.size("hits"))
    return _same_rows(base.where(F.col("_text").isNotNull()), few, same).dropDuplicates(same)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = contamination(docs, benchmark, key, text).where("contaminated")
    bad = written(found.select(F.col(key).alias("_bad"), F.col("text_hash").alias("_bad_hash")).distinct(), "contaminated")
    bad = sent(bad, 24 + text_bytes(F.col("_bad")))
    same = docs[key].eqNullSafe(bad["_bad"]) & (text_hash(docs[text]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def _same_rows(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL, keeping the left side's."""
    renamed = right.withColumnsRenamed({c: f"{c}_r" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"{c}_r"]) for c in on])
    return left.join(renamed, same, how).drop(*[f"{c}_r" for c in on])
