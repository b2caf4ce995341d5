"""Every text operator against a plain version, and on awkward tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from fleetair.llm import (
    decontaminate, exact_dedup, html_text, language, mixing, pii, quality, queries, secrets_scan, sharding, simhash,
)
from fleetair.llm.queries import _digested

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """NULLs in every column, empty and long texts, ties and a repeated row."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    copy = sentence(rng, 60)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (4, long, "en", "a", len(long)),
        (5, copy, "en", "a", 9), (6, copy, "en", "b", 9), (7, copy + " ", None, "b", None), (8, "12 34 !!", "fr", "c", 8),
        (9, "ÉCOLE Straße İ ſ", "fr", "c", 16), (None, copy, "fr", "c", 9), (None, None, None, None, None),
        (-5, "word", "fr", "c", 4), (6, copy, "en", "b", 9),
    ]
    return rows + [(100 + i, sentence(rng, 40), "en" if i % 2 else "fr", "s", 1) for i in range(20)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    """The rows above, with columns whose names the operators might use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({
        "score": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "shard": F.lit("y"), "kind": F.lit(3), "fp": F.lit(0), "domain": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Language and quality


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    model = language.fit(docs.where(~held))
    got = docs.where(held).select("lang", language.predict(F.col("text"), model).alias("p")).select("lang", "p.*").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(odd, empty):
    model = language.fit(odd)
    got = odd.withColumn("p", language.predict(F.col("text"), model)).collect()
    for r in got:
        assert (r.p.lang_pred == "und") == (not regex.search(r"\p{L}", r.text or ""))
    # Numbers that are no letters, though they count as word characters.
    signs = odd.sparkSession.createDataFrame([("²",), ("½ ² Ⅷ",), ("_ 7 ٣",), ("ª",), ("日",)], "text string")
    told = signs.select("text", language.predict(F.col("text"), model).alias("p")).collect()
    assert {r.text: r.p.lang_pred == "und" for r in told} == {"²": True, "½ ² Ⅷ": True, "_ 7 ٣": True, "ª": False, "日": False}
    assert language.predict(F.col("text"), language.fit(empty)) is not None
    assert odd.select(language.predict(F.col("text"), language.fit(empty)).alias("p")).where("p.lang_pred <> 'und'").isEmpty()
    assert empty.select(language.predict(F.col("text"), model)).count() == 0


def test_language_pieces(monkeypatch):
    text = "Ça va? Größe, niño " * 30
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.gram_counts(text) == whole).all()


def test_quality(spark, odd, empty, monkeypatch):
    rng = random.Random(1)
    rows = [(i, (sentence(rng, 30) if i % 2 else "buy now !!! " * 10), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = docs.where("doc_id < 120").select("doc_id", F.col("q").alias("quality"))
    model = quality.fit(docs, labels)
    got = docs.where("doc_id >= 120").select("q", quality.score(F.col("text"), model).alias("s")).collect()
    assert all((r.s >= 0.5) == bool(r.q) for r in got)
    assert odd.select(quality.score(F.col("text"), model).alias("s")).where("s between 0 and 1").count() == odd.count()
    none = quality.fit(empty, labels.limit(0))
    assert {r[0] for r in odd.select(quality.score(F.col("text"), none)).collect()} == {0.5}
    text = "one two, two three -- " * 50
    whole = np.sort(quality.buckets(text))
    monkeypatch.setattr(quality, "PIECE", 64)
    assert (np.sort(quality.buckets(text)) == whole).all()


# Decontamination


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, odd_rows, odd, empty):
    rng = random.Random(2)
    items = [(1, sentence(rng, 40)), (2, sentence(rng, 13)), (3, "Short One item"), (4, None), (5, " , "), (None, "école STRASSE x y"), (1, sentence(rng, 15)), (7, "word")]
    docs = []
    for i in range(120):
        body = sentence(rng, rng.randrange(0, 80)).split()
        pick = plain_words(rng.choice(items)[1])
        if pick and i % 2:
            a = rng.randrange(len(pick))
            body[len(body) // 2 : len(body) // 2] = [w.upper() if w.isascii() else w for w in pick[a : a + rng.randrange(1, 40)]]
        docs.append((1000 + i, " ".join(body), None, None, None))
    docs += [(2000, items[0][1], None, None, None), (2001, f"{items[0][1]} {items[1][1]}", None, None, None)] + odd_rows
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(item if item is not None else ""))

    def expected(text):
        w, hit, ids = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        return len(w), len(hit), sorted(ids)

    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.contamination(table, bench).collect()), key=repr)
    want = sorted(((d[0] is None, d[0], *(lambda e: (e[0], e[1], tuple(e[2])))(expected(d[1]))) for d in docs), key=repr)
    assert got == want
    assert any(len(x[4]) > 1 for x in want)
    bad = {d[0] for d in docs if expected(d[1])[1] and 20 * expected(d[1])[1] >= expected(d[1])[0]}
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == {d[0] for d in docs} - bad | {None}
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contamination(empty, bench).count() == 0


def test_decontamination_of_repeated_rows(spark, monkeypatch):
    """Copies of a row with its key, or without one, bring no hits or windows of their own."""
    rng = random.Random(6)
    passage = sentence(rng, 200)
    bench = spark.createDataFrame([(1, passage), (2, "only three words")], "item_id long, text string")
    rows = [(1, passage), (None, passage + " only three words"), (2, "none of it")]
    touched = decontaminate._touched
    seen = []

    def counted(base, hits, same):
        out = touched(base, hits, same)
        seen.append(sorted(map(len, (r.hits for r in out.collect()))))
        return out

    monkeypatch.setattr(decontaminate, "_touched", counted)
    once = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    many = decontaminate.contamination(spark.createDataFrame(rows * 30, "doc_id long, text string"), bench).collect()
    assert sorted(map(str, many)) == sorted(map(str, once * 30))
    assert seen[0] == seen[1] and len(seen[0]) == 2


def test_decontamination_cuts_texts_once(spark, tmp_path):
    """The number of words comes from the pass that makes the fingerprints: the result reads no text."""
    rng = random.Random(8)
    passage = sentence(rng, 30)
    rows = [(1, passage), (1, passage), (2, "a-b C"), (3, None), (None, ""), (None, "ÉCOLE ſ"), (4, "!!")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    bench = spark.createDataFrame([(1, passage), (2, "b c")], "item_id long, text string")
    # With and without items, and with a table of fingerprints that is shuffled.
    for items, limit in ((bench, None), (bench.limit(0), None), (bench, -1)):
        with pytest.MonkeyPatch.context() as patch:
            if limit is not None:
                patch.setattr("fleetair.llm.common.MAX_SENT_BYTES", limit)
            found = decontaminate.contamination(spark.read.parquet(f"{tmp_path}/docs"), items)
        assert not [f for f in found.inputFiles() if f"{tmp_path.name}/docs" in f]
        hits = {passage: 30, "a-b C": 2} if items is bench else {}
        assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in found.collect()), key=repr) == sorted(
            ((k, len(plain_words(t)), hits.get(t, 0)) for k, t in rows), key=repr)


# Sharding


def test_shards(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, "same text " * 5 if i % 3 == 0 else "x" * rng.randrange(200), None, None, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(docs, n_shards=16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.size == len(r.text) + 1
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 4 * 200
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    parts = {}
    for r in got:
        parts.setdefault(r.text, set()).add(r.shard)
    once = [t for t, s in parts.items() if len(s) > 1 and t != "same text " * 5]
    assert len(once) <= 15  # a cut may fall among the copies of a text
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, n_shards=16).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}
    placed = sharding.shard(odd, target_bytes=100_000, by=["source", "lang"])
    assert placed.count() == odd.count() and placed.columns.count("shard") == 1
    assert sharding.shard(empty, n_shards=4).count() == 0


def test_shards_refine(spark, monkeypatch):
    """Medians among many ties, with histograms far smaller than the table."""
    monkeypatch.setattr(sharding, "BUCKETS", 4)
    monkeypatch.setattr(sharding, "EXACT_ROWS", 10)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("ab")).otherwise(F.lit("cd")).alias("text"))
    n = sorted(r["count"] for r in sharding.shard(docs, n_shards=5).groupBy("shard").count().collect())
    assert len(n) == 5 and n[-1] - n[0] <= 2


# Mixing


def test_mixing(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, ("good fine " if i % 4 else "bad poor ") + " ".join(rng.choices(WORDS, k=20)), None, None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.where("doc_id < 200").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "b").otherwise("a").alias("domain"))
    got = mixing.mix(docs, labels, {"a": 0.9, "b": 0.1}).collect()
    assert all((r.p[1] > 0.5) == (r.doc_id % 4 == 0) for r in got)
    total = [sum(r.rate * r.tokens * r.p[d] for r in got) for d in (0, 1)]
    assert total[0] / sum(total) == pytest.approx(0.9, abs=0.01)
    assert all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in got)
    more = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}, max_rate=None).collect()
    total = [sum(r.rate * r.tokens * r.p[d] for r in more) for d in (0, 1)]
    assert total[1] / sum(total) == pytest.approx(0.5, abs=0.01)
    assert mixing.mix(odd, labels, {"a": 0.9, "b": 0.1}).count() == odd.count()
    assert mixing.mix(odd, labels.limit(0), {"a": 0.9, "b": 0.1}).count() == odd.count()
    assert mixing.mix(empty, labels, {"a": 0.9, "b": 0.1}).count() == 0


def test_mixing_meets_its_targets(spark):
    """On the given tables every domain is within a thousandth of its target."""
    got = queries.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    names = list(queries.DOMAIN_WEIGHTS)
    p = np.array([[r[f"p_{d}"] for d in names] for r in got])
    rate, tokens = (np.array([r[c] for r in got], dtype=float) for c in ("rate", "tokens"))
    target, told = (np.array([got[0][f"{c}_{d}"] for d in names]) for c in ("target", "achieved"))
    assert target / target.sum() == pytest.approx(list(queries.DOMAIN_WEIGHTS.values()))
    reached = (rate * tokens) @ p
    assert reached == pytest.approx(told, rel=1e-6)
    assert reached == pytest.approx(target, rel=1e-3)
    assert {r.met for r in got} == {True}
    assert (rate >= 0).all() and all(abs(r.copies - r.rate) < 1 for r in got)


def test_rates_out_of_reach_are_told(spark):
    """A bound of 1 cannot give more than there is; what is reached comes with the rates."""
    rows = [(i, 10, [1.0, 0.0] if i % 5 else [0.0, 1.0]) for i in range(100)]
    members = spark.createDataFrame(rows, "key long, tokens long, p array<double>")
    rated, reached = mixing.fit_rates(members, [400.0, 500.0], 1.0)
    assert reached.tolist() == pytest.approx([400, 200], rel=1e-3)
    assert {round(r.rate, 2) for r in rated.collect()} == {0.5, 1.0}


def test_rates_are_the_least_squares_solution(spark):
    """Against a long run of plain projected gradient on the same problem."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(1, 50, 200)
    rows = [(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))]
    members = spark.createDataFrame(rows, "key long, tokens long, p array<double>")
    goal = [2000.0, 500.0, 200.0]
    rate = np.array([r.rate for r in mixing.fit_rates(members, goal, None)[0].orderBy("key").collect()])
    miss = (rate * tokens) @ p - goal
    assert (rate >= 0).all() and (rate == 0).any()
    scale, plain = 1 / ((tokens[:, None] * p).T @ p).diagonal(), np.ones(200)
    for _ in range(20_000):
        plain = np.maximum(0, plain - 0.5 * p @ (scale * ((plain * tokens) @ p - goal)))
    best = (plain * tokens) @ p - goal
    first = tokens @ p - goal
    assert scale @ miss**2 <= scale @ best**2 + 0.01 * (scale @ first**2)


# HTML


def text_of(html, low=frozenset()):
    root = html_text.parse(html)
    return html_text.main_text(root, html_text.annotate(root, "h"), low)


def test_html_markup():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header>Top</header>
    <div class="page-header"><article><header><h1>A &amp; B</h1></header><p>one<br>two <b>three</b><p>four &lt;x&gt;
    <ul><li>i<li>j</ul><div class="ad-box ad">no</div><table><tr><td>a<td>b<tr><td>c</table><form>f</form>
    <section id="comments"><article class="comment"><p>hey</p></article></section><!-- c --></article></div>
    <footer>f</footer><script>var t="</p>";</script>"""
    assert text_of(page) == "A & B\none two three\nfour <x>\ni\nj\na\nb\nc"
    assert text_of("<div class=menu>m</div><div>Hello <span>w</span>orld<p>x</p>tail</div>") == "Hello world\nx\ntail"
    assert [text_of(x) for x in (None, "", "a <b>c", "<p></p>")] == ["", "", "a c", ""]
    assert text_of("<div>" * 20_000 + "deep") == "deep"


@pytest.mark.parametrize("tag", ["noscript", "button", "object", "canvas", "template", "svg", "select", "audio", "video"])
def test_html_noise_ends_with_its_tag(tag):
    """A block left open inside does not keep a noise element open."""
    article = "<article><p>All of it</article>"
    assert text_of(f"<body><{tag}><p>Enable scripts</{tag}>{article}<p>tail") == "All of it"
    assert text_of(f"<body><div><{tag}><div><ul><li>x</{tag}>Rest</div>of it") == "Rest\nof it"
    assert text_of(f"<body><p>one</{tag}>two</p>{article}") == "All of it"


def test_html_names_do_not_take_the_article():
    """Noise words in the names of articles and of the branch that holds most text."""
    body, side = "<p>All of the text of it, word by word", "<div class=related><p>More</div><div id=comments>C</div>"
    want = "All of the text of it, word by word"
    for names in ("post category-social", "post comments-open", "hentry social", "notice", "related"):
        assert text_of(f"<body>{side}<article class='{names}'>{body}</article>{side}") == want
    for names in ("content no-sidebar", "with-sidebar", "main social", "wrap header-fixed"):
        assert text_of(f"<body><div class='{names}'>{body}</div>{side}") == want
    assert text_of(f"<div class='content no-sidebar'><article class='post category-social'>{body}</article></div>{side}") == want
    assert text_of(f"<div id=social><article class='post category-social'>{body}</article></div>{side}") == want
    posts = "".join(f"<article class='post comments-open'><p>P{i}</article>" for i in range(3))
    assert text_of(f"<body>{posts}{side}") == "P0\nP1\nP2"
    assert text_of(f"<body><div class=sidebar>{body}</div>") == want
    assert text_of(f"<article><p>Short</p><div id=comments><article class='comment even'>{body}</article></div></article>") == "Short"
    # What names itself wholly stays noise, however long.
    assert text_of(f"<article><p>Short</p><section id=comments>{body}{body}</section></article>") == "Short"
    assert text_of(f"<div class=post>Short</div><section id=comments><article class=comment>{body}</article></section>") == "Short"


def test_html_style_tree(spark):
    """What every page of a host repeats goes, also when no markup tells."""
    rows = [
        (i, f"http://h{i % 2}.example/{i}", f"<body><div class=x1>Same words</div><div class=y>Text {i}</div><p>Always</p></body>")
        for i in range(16)
    ] + [(90, None, "<div class=x1>Same words</div>"), (91, "http://h0.example/z", None), (92, "nonsense", ""), (0, "http://h0.example/0", rows_html(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "_x": F.lit(3)})
    got = [(r.page_id, r.text) for r in html_text.extract(pages).collect()]
    want = [(i, f"Text {i}\nAlways") for i in range(16)] + [(90, "Same words"), (91, ""), (92, ""), (0, "Text 0\nAlways")]
    assert sorted(got) == sorted(want)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_the_style_tree_alone_finds_the_given_articles(spark, monkeypatch):
    """Without any list of names, and without article elements, on hosts of five pages and more."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    # Fewer hosts, so that each has enough pages.
    pages = pages.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id") % 5, F.lit(".example/"), "page_id"))
    given = {r.page_id: r.html for r in pages.collect()}

    def article(html):
        """The text of the article element, read by pattern alone."""
        body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
        return "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)

    from html import unescape
    want = {k: article(v) for k, v in given.items()}
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
    low = html_text.low_importance(pages.select(html_text.host_of(F.col("url")).alias("host"), "html")).collect()
    assert len(low) == 5 and all(len(r.styles) >= 3 for r in low)
    for name in ("NOISE_WORDS", "NOISE_ROLES", "HEADER_WORDS"):
        monkeypatch.setattr(html_text, name, frozenset())
    monkeypatch.setattr(html_text, "NOISE_TAGS", html_text.UNSEEN_TAGS)
    plain = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="c">')), F.lit("</article>"), F.lit("</div>")))
    assert {r.page_id: r.text for r in html_text.extract(plain).collect()} == want


def test_html_of_copies_and_ties(spark):
    """A host whose pages are all alike has no information; nothing is removed for being small."""
    same = "<body><div class=x>Only words</div><div class=y>More words here</div></body>"
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", same) for i in range(12)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"Only words\nMore words here"}


def rows_html(i):
    return f"<body><div class=x1>Same words</div><div class=y>Text {i}</div><p>Always</p></body>"


# Exact and near duplicates


def test_exact_dedup(odd, odd_rows, empty):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d in odd_rows:
        groups.setdefault(norm(d[1]), []).append(d)
    want = []
    for text, rows in groups.items():
        best = min(rows, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))
        for d in rows:
            same = d[0] == best[0] and len(d[1] or "") == len(best[1] or "")
            want.append((d[0], best[0], len(rows), same, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.deduplicate(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_of_one_digest(spark):
    """Two texts with one digest stay apart: contents decide."""
    rows = [(b"d", "one", 5), (b"d", "one", 7), (b"d", "two", 6), (b"e", "x", 1)]
    df = spark.createDataFrame(rows, "sha binary, text string, rank int").withColumn("rank", F.col("rank").cast("decimal(38,0)"))
    got = sorted((r.text, r.of_digest, int(r["rank"]), r.n) for r in exact_dedup.groups(df).collect() if r.text)
    assert got == [("one", 2, 7, 2), ("two", 2, 6, 1)]


def plain_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """(id, fingerprint) -> id -> smallest id reachable; ids that are None only follow."""
    root = {i: i for i, _ in pairs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, f) for i, f in pairs if i is not None]
    for a, f in known:
        for b, g in known:
            if (f ^ g).bit_count() <= 3 and find(a) != find(b):
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                root[hi] = lo
    return find


@pytest.mark.parametrize("tile", [512, 3])
def test_simhash(spark, odd, odd_rows, empty, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd).collect()}
    prints = [(d[0], plain_simhash(d[1])) for d in odd_rows]
    find = plain_components(prints)
    of = {f: find(i) for i, f in prints if i is not None}
    assert got == {(i, f, of[f]) for i, f in prints}
    if tile == 512:
        assert simhash.near_duplicates(empty).count() == 0
        kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
        assert sorted(kept) == sorted({c for _, _, c in got})


@pytest.mark.parametrize("tile", [512, 5])
def test_links_of_a_dense_cluster(spark, tile, monkeypatch):
    """Many near-copies of one fingerprint, and chains away from it."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng, fps = random.Random(7), {rng_fp for rng_fp in (random.Random(9).getrandbits(64) for _ in range(50))}
    centre = rng.getrandbits(64)
    for _ in range(150):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = {(r.u % (1 << 64), r.v % (1 << 64)) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    number = {f: i for i, f in enumerate(sorted(fps))}
    find = plain_components([(i, f) for f, i in number.items()])
    from fleetair.llm.components import connected
    roots = {r.vertex % (1 << 64): r.root for r in connected(links).collect()}
    classes = {}
    for f, i in number.items():
        classes.setdefault(find(i), set()).add(roots.get(f, ("alone", f)))
    assert all(len(v) == 1 for v in classes.values()) and len({next(iter(v)) for v in classes.values()}) == len(classes)


# Secrets and personal data


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


def plain_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_pii(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return out


def noise(rng, pieces, n):
    return "".join(rng.choice(pieces) for _ in range(n))


def test_secret_patterns(spark, odd_rows, empty):
    rng = random.Random(11)
    pieces = ["password", "PassWd", "token", "api_key", "ſecret", "Key", "secret", "=", ": ", '"', "'", " ", "\n", "AKIA", "ABCDEFGH01", "é", "0123456789abcdef", "deadbeef", "x", "+/", "hunter2hunter2"]
    rows = [*odd_rows, *[(500 + i, noise(rng, pieces, 60), None, None, None) for i in range(150)]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = _digested(docs.select("doc_id", secrets_scan.find(F.col("text")).alias("spans")), secrets_scan.KINDS[:3]).collect()
    want = sorted(((d[0], digest(plain_secrets(d[1] or ""))) for d in rows), key=repr)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=repr) == want
    assert empty.select(secrets_scan.find(F.col("text"))).count() == 0


def named(text):
    return [text[a:b] for a, b, _ in secrets_scan.named_spans(text)]


def test_secret_assignments():
    assert named('db_pwd = "correct9Horse7battery"') == ["correct9Horse7battery"]
    assert named('x = "correct9Horse7battery"\ny = x\nconn.authToken = y') == ["correct9Horse7battery"]
    assert named("private_key: aB3dE5gH7jK9mN1pQ2") == ["aB3dE5gH7jK9mN1pQ2"]
    assert named('{"clientSecret": "aB3dE5" + "gH7jK9mN1pQ2"}') == ["gH7jK9mN1pQ2"]
    assert named('title = "correct9Horse7battery"; password = get("correct9Horse7battery")') == []
    assert named("password: correct\npassword = '${ENV_PASSWORD1}'\nsecret == 'aB3dE5gH7jK9mN1pQ2'") == []
    assert named("a = b\nb = a\npassword = a\nb = 'aB3dE5gH7jK9mN1pQ2'") == ["aB3dE5gH7jK9mN1pQ2"]


def test_planted_secrets_are_found():
    """Variables that flow, every kind of quotes, elements, phrases; and what only looks like them."""
    rng = random.Random(21)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    frames = [
        "db_pwd = {q}", "auth={q}", "const credentials: string = {q};", "{{'client_pwd': {q}}}", "v1 = {q}\nv2 = v1\nconn.auth_pwd = v2",
        "<dbAuth>{v}</dbAuth>", "<smtp-credential env='p'>\n  {v}\n</smtp-credential>", "signing_key: {v}", "export DB_PWD={v}",
        "authKey := {q}", "private_key => {q}", 'auth = """{v}"""', "bearer = '''{v}'''", "let pwd = `{v}`",
        "passphrase = \"{p}\"", "seed_phrase: '{p}'",
    ]
    planted, found, more = 0, 0, 0
    for i in range(400):
        v = "".join(rng.choices(alphabet, k=rng.randint(12, 28))) + "7q"
        phrase = " ".join(rng.sample(WORDS, 5))
        frame = frames[i % len(frames)]
        want = phrase if "{p}" in frame else v
        text = f"# note {i}\nprint('hello')\n" + frame.format(v=v, p=phrase, q=rng.choice(['"', "'", "`"]).join(["", v, ""])) + "\ncolour = 'blue5green7red9'\n"
        got = named(text)
        planted, found, more = planted + 1, found + (want in got), more + len(set(got) - {want})
    assert found >= 0.95 * planted and more == 0
    for text in ('pwd = "${DB_PWD_1}"', "auth: <your key 1>", 'pwd = "example"', 'auth = "your-password-here1"', 'pwd = "type 1 word here"', "credential = '********'"):
        assert named(text) == []
    assert named('auth_pwd = "a<b9!kd8example2Q"') == ["a<b9!kd8example2Q"]


def test_pii_patterns(spark, odd_rows, empty):
    rng = random.Random(12)
    pieces = ["a.b", "@", "x-1.org", ".", "1", "12", "255", "256", "4111111111111111", "4111-1111 1111 1111", " ", "-", "+1 ", "(555) 010-9999", "_", "é", "\n", "%", "99.1.2.3"]
    rows = [*odd_rows, *[(500 + i, noise(rng, pieces, 60), None, None, None) for i in range(200)]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = _digested(pii.find(docs), pii.KINDS[:4]).collect()
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=repr) == sorted(((d[0], digest(plain_pii(d[1] or ""))) for d in rows), key=repr)
    assert pii.find(empty).count() == 0


def test_pii_zero_parts(spark):
    """Parts of an address that are only zeros, with and without further zeros."""
    rng = random.Random(13)
    pieces = ["0", "00", "10.0.0.1", ".", "1", "255", "256", "0255", "00256", " ", "127.0.0.", "000"]
    rows = [(i, noise(rng, pieces, 40), None, None, None) for i in range(200)]
    rows += [(900 + i, x, None, None, None) for i, x in enumerate(["10.0.0.1", "127.0.0.1", "192.168.0.12", "1.2.3.0", "0.0.0.0", "8.8.8.8", "1.2.3.0256", "0" * 500 + ".0.0.0"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in _digested(pii.find(docs), pii.KINDS[:4]).collect()}
    assert {d[0]: found[d[0]].base_sha256 for d in rows} == {d[0]: digest(plain_pii(d[1])) for d in rows}
    kinds = {r.doc_id: [s.kind for s in r.spans if s.kind == "ip"] for r in pii.find(docs).where("doc_id >= 900").collect()}
    assert [len(kinds[900 + i]) for i in range(8)] == [1, 1, 1, 1, 1, 1, 0, 1]


def test_pii_bootstrapping(spark):
    rows = [(i, f"Please write to contact address: user{i}@mail.example.org today") for i in range(8)]
    rows += [(50, "Please write to contact address: agent-0077x today"), (51, "some other words agent-0078x here")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == ["found"] and got[51] == [] and all(got[i] == ["email"] for i in range(8))


def plain_kd(rows, n):
    """The leaf of every row by splitting lists: widest dimension, byte median, (key, text, id) order."""
    spans = [max(1, max(r["dims"][d] for r in rows) - min(r["dims"][d] for r in rows)) for d in range(3)]
    out = {}

    def split(some, first, leaves):
        if leaves == 1 or not some:
            out.update({r["id"]: first for r in some})
            return
        wide = [max(r["dims"][d] for r in some) - min(r["dims"][d] for r in some) for d in range(3)]
        d = max(range(3), key=lambda i: wide[i] / spans[i])
        order = sorted(some, key=lambda r: (r["dims"][d], r["crc"], r["second"]))
        left = leaves // 2
        target, total, at = sum(r["bytes"] for r in some) * left / leaves, 0, 0
        while total + order[at]["bytes"] < target:
            total += order[at]["bytes"]
            at += 1
        over = total + order[at]["bytes"] - target
        at += over <= order[at]["bytes"] - over
        split(order[:at], first, left)
        split(order[at:], first + left, leaves - left)

    split(rows, 0, n)
    return out


def test_planted_identifiers_are_found(spark):
    """Beside seeds, next to other tokens with digits, and in contexts that only found identifiers vouch for."""
    rng = random.Random(8)
    ids = [f"{rng.choice('QXZ')}{rng.randrange(10**6, 10**7)}{rng.choice('abc')}" for _ in range(30)]
    rows = [f"some text. Write to reference person: user{i}@mail.example.org, thanks" for i in range(40)]
    rows += [f"on 12march24 see page77 Write to reference person: {x} today" for x in ids[:12]]
    rows += [f"the customs badge holder {x} was there" for x in ids[:12]]  # known by now, and so is the context
    rows += [f"then the customs badge holder {x} left" for x in ids[12:]]
    rows += [f"room{i}b is on floor{i}c" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, rows[r.doc_id][s.start : s.end]) for r in pii.find(docs).collect() for s in r.spans if s.kind == "found"}
    planted = {(i, x) for i, t in enumerate(rows) for x in ids if x in t.split()}
    assert len(got & planted) >= 0.9 * len(planted) and len(planted) == 42
    assert not got - planted


@pytest.mark.parametrize("n", [5, 64])
def test_shards_equal_a_plain_tree(spark, sf, n):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tagged = sharding._dimensions(docs, "doc_id", "text", ()).collect()
    rows = [
        {"id": r.doc_id, "dims": [r._kd_dim0, r._kd_dim1, r._kd_dim2], "crc": r._kd_crc, "second": r._kd_second, "bytes": r._kd_bytes}
        for r in tagged]
    assert {r.doc_id: r.shard for r in sharding.shard(docs, n_shards=n).collect()} == plain_kd(rows, n)
