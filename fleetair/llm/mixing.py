"""Mixing documents to target domain weights with soft memberships.

A naive Bayes classifier learned from a table of labels gives every document a
posterior over domains. Projected-gradient least squares then fits a nonnegative rate, at
most ``max_rate`` if there is one, for each document, such that the expected tokens of each domain,
the sum of rate x tokens x posterior, match the targets. The driver sees sums per
domain only. Everything is DataFrame functions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm.common import bounded_sample, written

BUCKETS = 1 << 14
#: Labelled rows that the classifier learns from, of each domain about as many.
SAMPLE_PER_DOMAIN = 20_000
#: How often the commonest feature is added to each domain, the others in proportion,
#: which pulls a feature's share in a domain to its share everywhere.
SMOOTHING = 2.0
#: Standard errors by which a feature's share must differ in a domain to count.
SIGNIFICANT = 4.0
#: And the factor by which it must differ.
MIN_RATIO = 2.0
#: Part of its target by which a domain's tokens may differ from it.
TOLERANCE = 5e-4
#: Steps without a move after which the totals are settled.
QUIET = 3
#: Gradient steps that are replayed from their few numbers before rates are written.
REPLAY = 8


def _constant(values: object, kind: str) -> Column:
    """A literal array; parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def features(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key, tokens, buckets`` and the columns ``keep``: the number of words, and the hashed features present.

    The features are the distinct words (letters and digits), the distinct runs of
    punctuation, and three shares in eighths: of distinct words, of words that repeat
    the word before or the one before that, and of runs of punctuation per word.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(
        F.col(key).alias("key"), *keep,
        F.filter(F.split(raw, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "").alias("w"),
        F.regexp_extract_all(raw, F.lit(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"), F.lit(0)).alias("signs"))
    w = F.col("w")
    again = F.size(F.filter(w, lambda x, i: (x == F.get(w, i - 1)) | (x == F.get(w, i - 2))))
    distinct = cut.select(
        "key", *keep, F.size("w").alias("tokens"), F.array_distinct("w").alias("w"), again.alias("again"),
        F.size("signs").alias("n_signs"), F.array_distinct("signs").alias("signs"))
    n = F.greatest("tokens", F.lit(1))
    shares = [
        F.concat_ws(" ", F.lit(f"#{name}"), F.least(F.lit(8), F.ceil(8 * F.col(c) / n)) if c else F.ceil(8 * F.size("w") / n))
        for name, c in (("distinct", None), ("again", "again"), ("signs", "n_signs"))
    ]
    both = F.concat("w", "signs", F.array(*shares))
    hashed = F.transform(both, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    return distinct.select("key", *keep, F.col("tokens").cast("long").alias("tokens"), F.array_distinct(hashed).alias("buckets"))


def posteriors(
    docs: DataFrame, labels: DataFrame, domains: Sequence[str], key: str, text: str,
    per_domain: int = SAMPLE_PER_DOMAIN,
) -> DataFrame:
    """``key, tokens, p``: the posterior over ``domains`` of every row of ``docs``.

    ``labels`` has ``key, domain``; a sample of them bounded by ``per_domain`` is learned
    from, and so may be broadcast: two thirds for the features' log odds, the rest for
    the probabilities that sums of log odds stand for. A domain without labels gets posterior 0; without
    any labels all domains are equally likely.
    """
    marked = labels.where(F.col("domain").isin(*domains)).groupBy("key").agg(F.min("domain").alias("domain"))
    sample = bounded_sample(marked, "key", "domain", per_domain).withColumnRenamed("key", "_sample")
    docs = docs.select(key, text)
    chosen = docs.join(F.broadcast(sample), docs[key] == sample["_sample"])
    known = written(features(chosen, key, text, "domain"), "known")
    for_odds = F.pmod(F.xxhash64(F.lit("odds"), "key"), F.lit(3)) < 2
    feats = features(docs, key, text)
    n = {r["domain"]: r["count"] for r in marked.groupBy("domain").count().collect()}
    seen = np.zeros((len(domains), BUCKETS))
    for r in (  # at most domains x BUCKETS rows
        known.where(for_odds).select("domain", F.explode("buckets").alias("b"))
        .groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    ):
        seen[domains.index(r["domain"]), r["b"]] = r["n"]
    if not seen.sum():
        return feats.select("key", "tokens", _constant([1 / len(domains)] * len(domains), "array<double>").alias("p"))
    logs = _log_odds(seen)

    def scored(rows: DataFrame) -> DataFrame:
        """Sums of log odds against the first domain, squashed so that none is endless."""
        def odds(d: int) -> Column:
            weights = _constant(np.round(logs[d] - logs[0], 9).tolist(), "array<double>")
            total = F.aggregate("buckets", F.lit(0.0), lambda acc, x: acc + F.get(weights, x))
            return 10 * F.tanh(total / 10)

        return rows.withColumn("z", F.array(*[odds(d) for d in range(1, len(domains))]).cast("array<double>"))

    # The rest of the sample, a bounded number of rows, turns sums into probabilities.
    held = scored(known.where(~for_odds)).select("domain", "z").collect()
    total = np.array([n.get(d, 0) for d in domains], dtype=float)
    w = calibrate(np.array([[1.0, *r["z"]] for r in held]).reshape(len(held), len(domains)),
                  np.array([domains.index(r["domain"]) for r in held], dtype=int), total)

    def margin(d: int) -> Column:
        out = F.lit(float(w[0, d]))
        for j in range(1, len(domains)):
            out = out + F.get("z", F.lit(j - 1)) * F.lit(float(w[j, d]))
        return out

    margins = scored(feats).select("key", "tokens", F.array(*[margin(d) for d in range(len(domains))]).alias("m"))
    odds = margins.select("key", "tokens", F.transform("m", lambda m: F.exp(m - F.array_max("m"))).alias("o"))
    whole = F.aggregate("o", F.lit(0.0), lambda a, x: a + x)
    return odds.select("key", "tokens", whole.alias("s"), "o").select("key", "tokens", F.transform("o", lambda x: x / F.col("s")).alias("p"))


def _log_odds(seen: np.ndarray) -> np.ndarray:
    """Log of a feature's share in a domain over its share everywhere, from counts.

    A difference within ``SIGNIFICANT`` standard errors, or of less than ``MIN_RATIO``,
    is taken as none.
    """
    # Shares of all features seen in a domain, so that a text's length says nothing.
    per_domain = seen.sum(axis=1, keepdims=True)
    everywhere = (seen.sum(axis=0) + 0.5) / (seen.sum() + 0.5 * BUCKETS)
    pull = SMOOTHING / everywhere.max()
    rate = (seen + pull * everywhere) / (per_domain + pull)
    expected = per_domain * everywhere
    certain = np.abs(seen - expected) > SIGNIFICANT * np.sqrt(expected + 1.0)
    logs = np.log(rate / everywhere)
    return np.where(certain & (np.abs(logs) >= np.log(MIN_RATIO)), logs, 0.0)


def calibrate(x: np.ndarray, cls: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Multinomial logistic regression of the few sums, by gradient steps.

    Rows are weighted so that domains count as often as in ``total``, all the labels.
    A domain without rows gets no probability.
    """
    k = len(total)
    w = np.zeros((x.shape[1], k))
    here = np.bincount(cls, minlength=k).astype(float)
    w[0] = np.where(here > 0, 0.0, -1e9)
    if not len(cls) or (here > 0).sum() < 2:
        w[0] = np.where(total > 0, np.log(np.maximum(total, 1e-9) / max(1.0, total.sum())), -1e9)
        w[np.arange(1, k), np.arange(1, k)] = 1.0
        return w
    weight = (total / np.maximum(here, 1.0))[cls]
    weight /= weight.sum()
    scale = np.sqrt(weight @ x**2) + 1e-9
    y, u = np.eye(k)[cls], x / scale
    v = np.zeros_like(w)
    for _ in range(3000):
        m = u @ v + w[0]
        e = np.exp(m - m.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        v -= 1.0 * (u.T @ ((e - y) * weight[:, None]) + 1e-6 * v)
    out = v / scale[:, None]
    out[0] += w[0]
    return out


def _dot(p: Column, v: Column, size: int) -> Column:
    out = F.lit(0.0)
    for d in range(size):
        out = out + F.get(p, F.lit(d)) * F.get(v, F.lit(d))
    return out


def fit_rates(members: DataFrame, targets: Sequence[float], max_rate: float | None = 1.0) -> tuple[DataFrame, np.ndarray]:
    """``key, tokens, p`` with ``rate``, and the domains' tokens at these rates.

    Projected gradient, from rate 1, on the squared differences between expected and
    target tokens of the domains, measured by the inverse of the domains' own matrix of tokens: in
    units of the square root of a document's tokens the step is then one, however unlike the domains
    are. The matrix is that of the documents free to move, which meets targets within reach in a few
    steps; from the first step that comes no closer on it is that of all documents, with momentum.
    Stops when every domain is within ``TOLERANCE`` of its target, or when nothing moves any
    more, which is the least-squares answer to targets out of reach. Documents without
    tokens keep rate 1.
    """
    k = len(targets)
    p, tokens = F.col("p"), F.col("tokens").cast("double")

    def gram_sums(weight: Column) -> list[Column]:
        return [F.sum(weight * F.get(p, F.lit(a)) * F.get(p, F.lit(b))) for a in range(k) for b in range(a, k)]

    def inverse(sums: Sequence[float | None], all_tokens: float) -> np.ndarray:
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = [x or 0.0 for x in sums]
        gram += np.triu(gram, 1).T
        # Domains that hardly any tokens belong to, or that always come together, share a step.
        return np.linalg.inv(gram + 1e-9 * all_tokens * np.eye(k))

    first = members.agg(F.sum(tokens), *gram_sums(tokens), *[F.sum(tokens * F.get(p, F.lit(d))) for d in range(k)]).first()
    start, everything = members.withColumn("rate", F.lit(1.0)), first[0]
    if not everything:
        return start, np.zeros(k)
    scale = inverse(first[1:-k], everything)
    goal, most = np.asarray(targets, dtype=float), float("inf") if max_rate is None else max_rate

    def replayed(rows: DataFrame, steps: list[list[float]]) -> DataFrame:
        """A step is the move along each domain, then the momentum."""
        if not steps:
            return rows

        def move(at: Column, v: Column) -> Column:
            moved = F.least(F.lit(most), F.greatest(F.lit(0.0), at["ahead"] - _dot(p, v, k)))
            return F.struct(moved.alias("rate"), (moved + F.get(v, F.lit(k)) * (moved - at["rate"])).alias("ahead"))

        state = F.struct("rate", "ahead")
        moved = F.aggregate(_constant(steps, "array<array<double>>"), state, move)
        return (
            rows.withColumn("state", F.when(F.col("tokens") > 0, moved).otherwise(state))
            .withColumns({"rate": F.col("state.rate"), "ahead": F.col("state.ahead")}).drop("state")
        )

    def expected(rows: DataFrame, rate: str) -> list[Column]:
        return [F.sum(F.col(rate) * tokens * F.get(p, F.lit(d))).alias(f"{rate}{d}") for d in range(k)]

    rows, steps, t, quiet = start.withColumn("ahead", F.lit(1.0)), [], 1.0, 0
    before, error, freely, miss = None, float("inf"), True, np.array(first[-k:]) - goal
    move = scale @ miss
    while True:
        now = replayed(rows, steps)
        # Free to move: between the bounds, or at one of them and on the way inwards.
        way = _dot(p, F.lit(move.tolist()), k)
        free = ((F.col("rate") > 0) | (way < 0)) & ((F.col("rate") < most) | (way > 0))
        got = now.agg(*expected(now, "rate"), *expected(now, "ahead"), *gram_sums(F.when(free, tokens))).first()
        reached, miss = np.array(got[:k]), np.array(got[k : 2 * k]) - goal
        moved = np.inf if before is None else np.abs(reached - before).max()
        quiet = quiet + 1 if moved <= TOLERANCE / 100 * everything else 0
        if np.all(np.abs(reached - goal) <= TOLERANCE * goal) or (quiet == QUIET and not freely):
            return now.drop("ahead"), reached
        now_error = float(miss @ scale @ miss)
        worse = now_error > error
        if freely and (worse or quiet):
            # Back to where the last step came from, and on with the matrix of all.
            freely, quiet = False, 0
            if worse:
                steps.pop()
                before, error = None, float("inf")
                continue
        before, error = reached, now_error
        if freely:
            move = inverse(got[2 * k :], everything) @ miss
            steps.append([*move.tolist(), 0.0])
        else:
            t_next = 1.0 if worse else (1 + np.sqrt(1 + 4 * t * t)) / 2  # momentum starts again
            move = scale @ miss
            steps.append([*move.tolist(), 0.0 if worse else float((t - 1) / t_next)])
            t = t_next
        if len(steps) > REPLAY:  # the last step may have to be taken back
            rows, steps = written(replayed(rows, steps[:-1]), "rates"), steps[-1:]


def mix(
    docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], total_tokens: float | None = None,
    max_rate: float | None = 1.0, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, tokens, p, rate, copies, target, achieved, met`` for every row.

    ``labels`` has ``key, domain``; of several labels of a key the first by name counts,
    and labels of other domains or without a document teach nothing. ``weights`` are
    the target shares of the domains. ``total_tokens`` defaults to what keeps all of the
    domain with the largest share. ``target`` and ``achieved``, the same on every row, are the
    domains' tokens asked for and those expected at the fitted rates, and ``met`` whether these agree to
    a thousandth; if not, no rates come closer. ``copies`` is the rate made whole
    by a hash of the key: its floor, or one more with the probability of the rest.
    NULL and empty texts have no tokens and rate 1; repeated rows are rated alike.
    """
    domains = list(weights)
    marked = labels.select(F.col(key).alias("key"), "domain")
    members = written(posteriors(docs, marked, domains, key, text), "posteriors")
    supply = members.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))).alias(d) for i, d in enumerate(domains)]).first()
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    if total_tokens is None:
        main = int(share.argmax())
        total_tokens = (supply[main] or 0.0) / share[main]
    targets = (share * total_tokens).tolist()
    rated, reached = fit_rates(members, targets, max_rate)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "key"), F.lit(1 << 40)) / float(1 << 40)
    return rated.select(
        F.col("key").alias(key), "tokens", "p", "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"),
        F.lit(targets).alias("target"), F.lit(reached.tolist()).alias("achieved"),
        F.lit(bool(np.all(np.abs(reached - targets) <= 1e-3 * np.array(targets)))).alias("met"))
