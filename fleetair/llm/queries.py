"""The operators as queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetair.llm import (
    decontaminate, exact_dedup, html_text, language, lm_score, mixing, periodic_runs, pii, quality, secrets_scan, sharding, simhash,
    token_align,
)
from fleetair.llm.common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 1
    model = language.fit(docs.where(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id")) != 1))
    return docs.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"),
        quality.score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, benchmark)
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Target shares of tokens by domain of the labels table.
DOMAIN_WEIGHTS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the rows that carry a label."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed = mixing.mix(docs, domain_labels(labels), DOMAIN_WEIGHTS, max_rate=None)
    per_domain = [F.get(c, F.lit(i)).alias(f"{c}_{d}") for c in ("p", "target", "achieved") for i, d in enumerate(DOMAIN_WEIGHTS)]
    return mixed.select("doc_id", "tokens", "rate", "copies", "met", *per_domain)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _digested(found: DataFrame, base: Sequence[str]) -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _digested(docs.select("doc_id", secrets_scan.find(F.col("text")).alias("spans")), secrets_scan.KINDS[:3])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(pii.find(table(spark, sf_dir, "documents")), pii.KINDS[:4])


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _id_crc32(F.col("doc_id")) % 5 == 1
    found = lm_score.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _id_crc32(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _id_crc32(F.col("doc_id"))
    seed = F.when(h % 10 == 0, F.floor(h / 10))
    found = table(spark, sf_dir, "documents").select(
        "doc_id", periodic_runs.periodic_runs(F.col("text"), seed).alias("r")).select("doc_id", "r.*")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        _digest(F.array_join(lines, "")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_align.align(table(spark, sf_dir, "documents"), digest=True)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"), "n_shared")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality, op3_decontaminate, op4_kd_shards, op5_mixing, op6_html_text, op7_exact_dedup, op8_simhash,
    op9_secrets, op10_pii, op11_lm_score, op12_periodic_runs, op13_token_align)}

SQL: dict[str, str] = {
    "op3_decontaminate": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, s, s + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM items WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM runs JOIN windows USING (n, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits))
  GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
}
SQL = {name: sql.strip() for name, sql in SQL.items()}
