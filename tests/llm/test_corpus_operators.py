"""Language-model scores, periodic runs and token alignment against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetair.llm import lm_score, periodic_runs, queries, token_align
from fleetair.llm import blocks as bl

rng = random.Random(5)
TEXTS = [
    None, "", "  ", "\n", "Der Hund", "der hund der Hund", "a " * 40, "x\x1cy z  w", "½ ² ▁ <s> <0x41>", "<|endoftext|> a\x00b",
    "tab\tand\nline  two ", " lead", "ünïcode 日本語 テスト 🙂🙂", "word" * 50, "A" * 300 + " b",
    *[" ".join(rng.choices(["the", "The", "of", "sun", "moon,", "rain.", "ééé", "x"], k=rng.randint(1, 60))) for _ in range(60)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "name", "b") for i, t in enumerate(TEXTS)]
    rows += [(70, TEXTS[70], "again", "b"), (None, "no key at all", "none", "b"), (None, None, "none", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, block string").repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_scores(rows):
    """rows of (text, training, deleted): the same model with dictionaries."""
    def counts(chosen):
        one, two = Counter(), Counter()
        for text, _, _ in chosen:
            tokens = [*words(text), None]
            one.update(tokens)
            two.update(zip(["<", *tokens], tokens))
        return one, two

    one, two = counts([r for r in rows if r[1]])
    kept_one, kept_two = counts([r for r in rows if r[1] and not r[2]])
    _, events = counts([r for r in rows if r[2]])
    n, v = sum(one.values()), len(one)

    def share(pairs):
        """Expectation-maximisation over (one estimate, the other, times)."""
        x, before = 0.5, None
        while before is None or abs(x - before) > 1e-12:
            part = sum(k * x * p / (x * p + (1 - x) * q) for p, q, k in pairs)
            x, before = (part + 0.5) / (sum(k for *_, k in pairs) + 1), x
        return x

    kept_n = max(1, sum(kept_one.values()))
    lam, lam1 = defaultdict(lambda: 0.5), 0.5
    if events:
        lam1 = share([(kept_one[b] / kept_n, 1 / (v + 1), k) for (_, b), k in events.items()])
        per_level = defaultdict(list)
        for (a, b), k in events.items():
            seen = kept_one[None] if a == "<" else kept_one[a]
            if seen:
                one_word = lam1 * kept_one[b] / kept_n + (1 - lam1) / (v + 1)
                per_level[seen.bit_length() - 1].append((kept_two[a, b] / seen, one_word, k))
        pooled = share([x for some in per_level.values() for x in some])
        lam = defaultdict(lambda: pooled, {level: share(some) for level, some in per_level.items()})

    def parts(a, b, of, pairs, total):
        seen = of[None] if a == "<" else of[a]
        x = lam[seen.bit_length() - 1] if seen else 0.0
        return seen, x * pairs[a, b] / seen if seen else 0.0, (1 - x) * lam1 * of[b] / max(1, total), (1 - x) * (1 - lam1) / (v + 1)

    out = []
    for text, _, _ in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((one[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        real = sum(math.log10(sum(parts(a, b, one, two, n)[1:])) for a, b in zip(["<", *tokens], tokens))
        out.append((len(tokens), sum(one[t] > 0 for t in tokens), n, base, real))
    return out


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_scores_equal_a_plain_model(docs, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(bl, "BUCKET_ENTRIES", 64 if block == 50 else 1 << 20)
    training = F.col("doc_id") % 5 != 1
    deleted = F.pmod(F.xxhash64(F.lit("deleted"), F.col("doc_id")), F.lit(lm_score.DELETED)) == 0
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("t"), deleted.alias("d")).collect()
    want = plain_scores([(r.text, r.t, r.t and r.d) for r in rows])
    assert any(r.t and r.d for r in rows)
    got = lm_score.score(docs, training).collect()

    def order(rows):
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))

    got = order([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got])
    want = order([(r.doc_id, *w) for r, w in zip(rows, want)])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=1e-4)  # ratios are put together


def test_scores_of_no_training_and_no_rows(docs):
    got = lm_score.score(docs, F.lit(None).cast("boolean")).collect()
    assert {(r.training, r.n_known, r.train_tokens) for r in got} == {(False, 0, 0)}
    assert all(r.score == 0.0 for r in got)  # one unseen word is all there is
    assert lm_score.score(docs.where("false"), F.lit(True)).collect() == []
    text_keys = docs.select(F.concat(F.lit("id"), "doc_id").alias("doc_id"), "text")
    assert lm_score.score(text_keys, F.lit(True)).schema["doc_id"].dataType.simpleString() == "string"


def plain_runs(w):
    found, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q) and not any(
                    all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def test_runs_equal_every_period_tried():
    draw = random.Random(1)
    for _ in range(400):
        k, n, w = draw.choice([1, 2, 3, 5]), draw.randint(0, 130), []
        while len(w) < n:
            w += [draw.randrange(k) for _ in range(draw.randint(1, 20))] * draw.randint(1, 6)
            w = w[: len(w) - draw.randint(0, len(w) // 3)] if draw.random() < 0.5 else w
        w = w[:n]
        if n and draw.random() < 0.3:
            w = [w[i] for i in periodic_runs.repeated_tail(n, draw.randrange(10**8))]
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int64)).tolist()] == plain_runs(w)


def crc32(key):
    import zlib
    return zlib.crc32(str(key).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_query_on_a_given_table(spark, sf):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    planted = 0
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(w) > 1500:
            continue
        h, n = crc32(r.doc_id), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        planted += bool(runs)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        g = got[r.doc_id]
        assert (g.n_runs, g.start, g.length, g.period, g.exponent_milli) == (len(runs), *best, milli)
        assert g.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert g.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in drop))
    assert planted > 3


def test_periodic_runs_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(bl, "PIECE", 16)  # the words of a text come in many pieces
    texts = {"null": None, "empty": "", "blank": " \n", "one": "a " * 30, "two": "é ü " * 12 + "end", "short": "a " * 23}
    df = spark.createDataFrame(list(texts.items()), "runs string, text string")
    got = {r.runs: r.r for r in df.select("runs", periodic_runs.periodic_runs(F.col("text")).alias("r")).collect()}
    assert {k: (v.n_words, [tuple(x) for x in v.runs], v.collapsed) for k, v in got.items()} == {
        "null": (0, [], ""), "empty": (0, [], ""), "blank": (0, [], ""), "one": (30, [(0, 30, 1)], "a"),
        "two": (25, [(0, 24, 2)], "é ü end"), "short": (23, [], " ".join("a" * 23))}
    assert got["two"].best == (0, 24, 2) and got["short"].best is None


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(f"{token_align.TOKENIZERS}/{token_align.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{token_align.TOKENIZERS}/{token_align.PIECE_BPE}")
    names = {v: k for k, v in a.get_vocab(with_added_tokens=False).items()}
    chars = {c: i for c, i in token_align.byte_level_names().items()}
    assert sorted(chars.values()) == list(range(256))

    def encode(text):
        """Whole texts at once; pairs of id and bytes."""
        if not text:
            return [], []
        by_a = [(i, bytes(chars[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        by_b = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            one = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            by_b.append((i, bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        same = all(b"".join(x[1] for x in t) == raw for t in (by_a, by_b))
        return (by_a, by_b) if same else ([], [])

    return encode


def plain_alignment(encoded):
    per_doc, totals = [], Counter()
    for a, b in encoded:
        spans = [[], []]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, raw in tokens:
                spans[side].append((i, at, at + len(raw)))
                at += len(raw)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        groups, start, shared = [], 0, 0
        for cut in cuts:
            sides = [[i for i, s, e in x if start <= s and e <= cut] for x in spans]
            shared += len(sides[0]) * len(sides[1])
            groups.append("|".join(",".join(map(str, x)) for x in sides))
            start = cut
        totals.update(links)
        per_doc.append((len(a), len(b), groups, links, shared))
    best = Counter()
    for (_, j), n in totals.items():
        best[j] = max(best[j], n)
    return [
        (n_a, n_b, len(g), len(links), shared, sum(totals[x] == best[x[1]] for x in links), sum(totals[x] for x in links), ";".join(g))
        for n_a, n_b, g, links, shared in per_doc]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_alignment_equals_whole_texts(docs, coders, monkeypatch, block):
    monkeypatch.setattr(token_align, "BLOCK_UNITS", block)
    monkeypatch.setattr(token_align, "ALIGNED", 1 << 13 if block != 40 else 7)
    monkeypatch.setattr(bl, "BUCKET_ENTRIES", 16 if block == 40 else 1 << 20)
    rows = docs.select("doc_id", "text").collect()
    want = plain_alignment([coders(r.text) for r in rows])
    got = token_align.align(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted([(r.doc_id, *w) for r, w in zip(rows, want)], key=key)
    assert any(w[0] == 0 for w in want) and any(w[2] < w[0] for w in want)


def test_alignment_of_given_documents(spark, sf, coders):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if r.text is None or len(r.text) < 4000]
    want = plain_alignment([coders(r.text) for r in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in token_align.align(df).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want)}
    digests = {r.doc_id: r.groups for r in token_align.align(df, digest=True).collect()}
    assert digests == {k: sha(v[-1]) if v[-1] else "" for k, v in got.items()}
    assert token_align.align(df.where("false")).collect() == []


def test_products_equal_dense(monkeypatch):
    draw = np.random.default_rng(3)
    monkeypatch.setattr(token_align, "PRODUCTS", 20)
    for _ in range(30):
        a, b = draw.integers(0, 3, (7, 9)), draw.integers(0, 3, (9, 5))

        def rows(m):
            at = np.nonzero(m)
            return token_align.Rows(np.append(0, np.cumsum((m != 0).sum(axis=1))), at[1], m.shape[1], m[at])

        c = token_align.product(rows(a), rows(b))
        dense = np.zeros((7, 5), int)
        dense[np.repeat(np.arange(7), np.diff(c.first)), c.column] = c.value
        assert (dense == a @ b).all()
        t = rows(a).transposed()
        assert (t.first[-1], t.width) == ((a != 0).sum(), 7)
