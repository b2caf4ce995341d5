"""The corpus pipeline, stage by stage and as a whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetair.llm import decontaminate, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"bench{i}" for i in range(20))
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [
        (1, body(1), "en", "a", 1, None), (2, body(1) + " more", "en", "a", 1, None), (3, passage, "en", "b", 1, "x"),
        (4, None, None, None, None, None), (5, "", "en", "a", 0, None), (6, "123 456", "en", "a", 7, None),
        (7, body(7), "fr", "a", 1, None), (7, body(7), "fr", "a", 1, None), (None, body(8), "fr", None, 1, None),
        (9, body(9), None, "c", 1, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = [[1, 2, 3, 7, 7, 9, None], [1, 3, 7, 9, None], [1, 7, 9, None], [1, 7, 9, None], [1, 7, 9, None]]
    for (_, stage), want in zip(corpus_pipeline.STAGES, kept, strict=True):
        columns = docs.columns
        docs = stage(spark, docs, tables).cache()
        ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x or 0))
        assert ids == want
        assert docs.columns[: len(columns)] == columns
    assert {"shard", "slot"} <= set(docs.columns)


def test_keep_one_with_repeated_and_missing_keys(spark):
    """One row of each group, also where a key has several texts or there is none."""
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    texts = [(7, "a"), (7, "b"), (7, "b"), (7, "c"), (8, "c"), (3, "a"), (None, "d"), (None, "d"), (None, "e"), (9, "e"), (None, "f")]
    docs = spark.createDataFrame([(k, body(t), t) for k, t in texts], "doc_id long, text string, of string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = [(None, "d"), (None, "f"), (3, "a"), (7, "b"), (7, "c"), (9, "e")]
    assert sorted(((r.doc_id, r.of) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_keep_one_of_near_copies_without_keys(spark, monkeypatch):
    """Different texts with linked fingerprints and no key leave one row."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text: F.length(text).cast("long"))
    docs = spark.createDataFrame([(None, "x"), (None, "xxx"), (None, "yyy"), (5, "x" * 200), (5, "y" * 200)], "doc_id long, text string")
    got = sorted((r.doc_id is None, len(r.text)) for r in simhash.keep_one(docs).collect())
    assert len(got) == 2 and got[0] == (False, 200) and got[1][0]


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_run(spark, sf):
    """Against the stages' own rules on the given tables."""
    got = corpus_pipeline.run(spark, sf).cache()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert got.count() == len(ids) > 0.4 * docs.count()
    groups = simhash.near_duplicates(docs.where(F.col("doc_id").isin(list(ids))))
    assert groups.where("doc_id <> component_id").isEmpty()
    bad = decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
    assert not ids & {r.doc_id for r in bad.collect()}
    slots = got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d"))
    assert slots.where("n <> last + 1 or n <> d").isEmpty()
