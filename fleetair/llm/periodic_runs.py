"""Runs of words that repeat with a period, by a dictionary of basic factors.

The dictionary names, for each power of two, the factors of that many words at every
position; two positions have the same name where the words are the same. A factor
and its next occurrence that both lie within twice the factor's length are one step of
an arithmetic progression, and neighbouring positions with the same step propose a run
with the step as its period: it is the smallest one, since a smaller period would be an
earlier occurrence. A run of period q and three or more periods is proposed at the
first power of two that is not below q. Proposals are extended while words repeat, and those
that several lengths propose are one.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetair.llm.blocks import numbering, word_lists

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has this many words at least, and this many periods.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Words that are joined at a time when what is left of a text is put together.
JOINED = 1 << 16


def basic_factors(words: np.ndarray):
    """``length, at, name`` per power of two: where factors stand that occur more than
    once, ascending, and their names. Ends when no factor occurs twice."""
    length, at, name = 1, np.arange(len(words)), words.astype(np.int64)
    while True:
        distinct, name, n = np.unique(name, return_inverse=True, return_counts=True)
        often = n[name] > 1
        at, name = at[often], name[often]
        if not len(at):
            return
        yield length, at, name
        # A factor of twice the length has two named halves.
        second = np.searchsorted(at, at + length)
        there = np.append(at, -1)[second] == at + length
        name = name[there] * len(distinct) + name[second[there]]
        at, length = at[there], 2 * length


def find_runs(words: np.ndarray) -> np.ndarray:
    """Rows of start, length and period, by start and then period.

    ``words`` are numbers that are equal where words are equal.
    """
    proposed = [np.empty((0, 3), np.int64)]
    for length, at, name in basic_factors(words):
        order = np.argsort(name, kind="stable")
        place, of = at[order], name[order]
        near = (of[1:] == of[:-1]) & (place[1:] - place[:-1] <= length)
        if not near.any():
            continue
        first, step = place[:-1][near], (place[1:] - place[:-1])[near]
        order = np.argsort(first)
        first, step = first[order], step[order]
        # Neighbouring positions with the same step are one stretch.
        begins = np.ones(len(first), bool)
        begins[1:] = (first[1:] != first[:-1] + 1) | (step[1:] != step[:-1])
        begin = np.flatnonzero(begins)
        start, period = first[begin], step[begin]
        end = first[np.append(begin[1:], len(first)) - 1] + length + period
        long_enough = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        proposed.append(np.stack([start, end, period], axis=1)[long_enough])
    return _extended(words, np.unique(np.concatenate(proposed), axis=0))


def _extended(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Start, end and period as far as they go, as start, length and period, each once."""
    start, end, period = runs.T.copy()
    while len(runs):
        left = start > 0
        left[left] = words[start[left] - 1] == words[start[left] - 1 + period[left]]
        right = end < len(words)
        right[right] = words[end[right]] == words[end[right] - period[right]]
        if not (left.any() or right.any()):
            break
        start -= left
        end += right
    return np.unique(np.stack([start, end - start, period], axis=1), axis=0)


def repeated_tail(n: int, seed: int) -> np.ndarray:
    """Which word stands at each place of a text of n words whose tail is made to repeat."""
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def longest(runs: np.ndarray) -> int:
    """The run of most periods; of equally many the first."""
    best = 0
    for i, (_, length, period) in enumerate(runs.tolist()):
        if length * int(runs[best, 2]) > int(runs[best, 1]) * period:
            best = i
    return best


def periodic_runs(text: Column, tail_seed: Column | None = None) -> Column:
    """struct<n_words, runs array<struct<start, length, period>>, best, collapsed> of whole texts.

    ``best`` has the greatest length over period, then the smallest start and period;
    NULL without runs. ``collapsed`` is the text without the words that stand in a run
    after its first period, words joined by one space. Where ``tail_seed`` is given and
    not NULL the tail of the text is first made to repeat, see ``repeated_tail``, which
    plants a run. A NULL, empty or blank text has no words and no runs. A text of any length
    is read in pieces; what is held of it are a number for each word and its distinct words.
    """
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    @F.arrow_udf("struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>,"
                 " best: struct<start: bigint, length: bigint, period: bigint>, collapsed: string>")
    def found(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for value, seed in zip(texts, seeds, strict=True):
            numbers, words = numbering(), [np.empty(0, np.int64)]
            for piece in word_lists(value.as_py() or b""):
                words.append(np.fromiter(map(numbers.__getitem__, piece), np.int64, len(piece)))
            at = np.concatenate(words)
            if seed.is_valid and len(at):
                at = at[repeated_tail(len(at), seed.as_py())]
            runs = find_runs(at)
            edges = np.zeros(len(at) + 1, np.int64)
            np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
            kept, spelled = at[np.cumsum(edges)[:-1] == 0], list(numbers)
            parts = [b" ".join([spelled[w] for w in kept[i : i + JOINED].tolist()]) for i in range(0, len(kept), JOINED)]
            rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
            out.append((len(at), rows, rows[longest(runs)] if rows else None, b" ".join(parts)))
        n, runs, best, collapsed = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.StructArray.from_arrays([
            pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(collapsed, pa.binary()).cast(pa.string()),
        ], ["n_words", "runs", "best", "collapsed"])

    seed = F.lit(None) if tail_seed is None else tail_seed
    return found(text.cast("binary"), seed.cast("long"))
