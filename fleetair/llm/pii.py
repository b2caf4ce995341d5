"""Personal data, by patterns and by bootstrapped contexts.

The entities that fixed patterns find are seeds. The words left of each seed, and of
each identifier-like token, are lexical patterns; patterns and instances form a graph.
A round gives a pattern that enough confident instances vouch for the mean score of all its
instances, and an instance the noisy-or of its patterns; instances that become confident
vouch for further patterns in the next round. Confident patterns then bring in identifiers
that no fixed pattern knows. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetair.llm.common import written
from fleetair.llm.decontaminate import text_hash

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "found")
ROUNDS = 4
MIN_CONFIDENCE = 0.5
#: A pattern needs this many different confident instances before it can vouch for anything.
MIN_SEEDS = 3
#: Characters left of an entity in which its context's words are looked for.
CONTEXT = 80

# Quantifiers are possessive where giving back could not help, so that no text takes
# more than linear time. A match may start where the one before ended (\G).
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Tokens of five or more characters with a digit among them, not far from the start.
    "found": r"(?<![A-Za-z0-9_.+-])(?=[A-Za-z_-]{0,20}[0-9])[A-Za-z0-9_-]{5,}+",
}
#: A text without this cannot match.
_NEEDS = {"email": "@", "phone": "+"}
# The zeros give back, at most three of them: a part may be nothing but zeros.
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(F.lit(True))
    )


def _occurrences(texts: DataFrame) -> DataFrame:
    """``key, of, kind, start, end, context, instance`` of every valid match."""
    def found(kind: str) -> tuple[Column, Column]:
        every = F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0))
        gaps = F.split("t", PATTERNS[kind], -1)
        if kind not in _NEEDS:
            return every, gaps
        none, there = F.array().cast("array<string>"), F.contains("t", F.lit(_NEEDS[kind]))
        return F.when(there, every).otherwise(none), F.when(there, gaps).otherwise(none)

    columns = []
    for kind in KINDS:
        every, gaps = found(kind)
        columns += [every.alias(f"m_{kind}"), gaps.alias(f"g_{kind}")]

    def rows(kind: str) -> Column:
        gaps, found_here = F.col(f"g_{kind}"), F.col(f"m_{kind}")

        def before(i: Column) -> Column:
            """The text before a match, over the two matches of its kind before it."""
            pieces = [F.right(F.get(gaps, i - 2), F.lit(CONTEXT)), F.get(found_here, i - 2),
                      F.right(F.get(gaps, i - 1), F.lit(CONTEXT)), F.get(found_here, i - 1), F.right(F.get(gaps, i), F.lit(CONTEXT))]
            return F.right(F.concat(*[F.coalesce(x, F.lit("")) for x in pieces]), F.lit(CONTEXT))

        return F.transform(found_here, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), before(i).alias("left"), m.alias("match")))

    matches = (
        texts.select("key", "of", *columns)
        .select("key", "of", F.inline(F.concat(*[rows(k) for k in KINDS])))
    )
    # A match starts after all gaps up to its own and all matches before it.
    order = Window.partitionBy("key", "of", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.length("match")).over(order)
    placed = (
        matches.dropDuplicates(["key", "of", "kind", "i"])  # rows of the same key and text
        .withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
        .where(_valid(F.col("kind"), F.col("match")))
    )
    # Tokens that touch a seed are no candidates of their own.
    seed = F.col("kind") != "found"
    by_start = Window.partitionBy("key", "of").orderBy("start", "end")
    before = F.max(F.when(seed, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(seed, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    apart = placed.withColumns({"before": before, "after": after}).where(
        seed | ((F.coalesce("before", F.col("start")) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))))
    # The last two words left of the entity, digits made alike.
    context = F.regexp_replace(F.lower(F.regexp_extract("left", r"(?:(?<!\S)\S++\s++)?\S*+\s*+\z", 0)), "[0-9]", "0")
    return apart.select("key", "of", "kind", "start", "end", context.alias("context"), F.lower("match").alias("instance"))


def _confident(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``context, confidence`` and ``instance, score`` after the rounds of scoring.

    A context or an instance that most of the table has is one row per partner here, and
    is met by grouped sums and by joins with one row per context or instance on their other side.
    """
    edges = (
        occurrences.where(F.trim("context") != "")
        .groupBy("context", "instance").agg(F.max((F.col("kind") != "found").cast("double")).alias("seed"))
    )
    many = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SEEDS).select("context")
    edges = written(edges.join(many, "context"), "edges")
    scores = edges.where("seed = 1").select("instance", F.lit(1.0).alias("score")).distinct()
    known = None
    for _ in range(ROUNDS):
        score = F.coalesce("score", F.lit(0.0))
        patterns = edges.join(scores, "instance", "left").groupBy("context").agg(
            (F.sum(score) / (F.count(F.lit(1)) + 1)).alias("confidence"),
            F.sum((score >= MIN_CONFIDENCE).cast("int")).alias("vouching"),
        ).where(F.col("vouching") >= MIN_SEEDS).select("context", "confidence")
        patterns = written(patterns, "patterns")
        doubt = F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999))))
        told = edges.join(patterns, "context").groupBy("instance").agg(
            F.greatest(F.max("seed"), 1.0 - F.exp(doubt)).alias("score"))
        seeds = edges.where("seed = 1").select("instance", F.lit(1.0).alias("score"))
        scores = written(told.union(seeds).groupBy("instance").agg(F.max("score").alias("score")), "instances")
        now = patterns.count()
        if now == known:  # no further pattern: the next round would say the same of the same
            break
        known = now
    return patterns, scores


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans`` for every row; spans are structs of start, rank, kind and end.

    Positions are code points of the whole text, end exclusive; NULL counts as empty.
    Spans are sorted by start, then kind in the order of ``KINDS``; the kind ``found``
    holds the identifiers that confident contexts brought in. Rows that repeat a key
    and text get the same spans.
    """
    texts = docs.select(F.col(key).alias("key"), text_hash(F.col(text)).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    every = written(_occurrences(texts), "occurrences")
    patterns, scores = _confident(every)
    new = (
        every.where("kind = 'found'")
        .join(patterns.where(F.col("confidence") >= MIN_CONFIDENCE), "context")
        .join(scores.where(F.col("score") >= MIN_CONFIDENCE), "instance")
    )
    columns = ["key", "of", "kind", "start", "end"]
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = (
        every.where("kind <> 'found'").select(*columns).union(new.select(*columns))
        .groupBy("key", "of").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
        .withColumnsRenamed({"key": "key_r", "of": "of_r"})
    )
    base = texts.select("key", "of")
    none = F.array().cast("array<struct<start: bigint, rank: bigint, kind: string, end: bigint>>")
    return base.join(spans, base["key"].eqNullSafe(spans["key_r"]) & (base["of"] == spans["of_r"]), "left").select(
        F.col("key").alias(key), F.coalesce("spans", none).alias("spans"))
