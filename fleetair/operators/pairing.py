"""Pair the latest rows of two interleaved sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetair.plans.timeline import Slices, Timeline, as_list


def pair_latest(
    df: DataFrame,
    key,
    order,
    side: str,
    a_cols: list[str],
    b_cols: list[str],
    ts: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """One merged row each time both sides have been refreshed.

    ``side`` is 'A' or 'B'. Per key, in ``order`` (unique): remember the latest
    row of each side, and when both are newer than the last merged row, emit
    one: the A columns of the latest A row, the B columns of the latest B row,
    and the later of the two times.

    A row can only complete a pair when it changes side. After two rows of one
    side the next change always completes one; within an unbroken streak of
    changes every second row does (the first uses up both sides, the next starts
    afresh). So a row emits when it is an odd member of its streak, and the
    streak position is its distance from the last row that kept the side.
    """
    key, order = as_list(key), as_list(order)
    ts = ts or order[0]
    is_a, is_b = F.col(side) == "A", F.col(side) == "B"
    line = Timeline(df.where(is_a | is_b), key, order, slices).walk(
        prev={"_prev": F.col(side)},
        derive={"_change": F.coalesce(F.col("_prev") != F.col(side), F.lit(False))},
        last={
            "_a": F.when(is_a, F.struct(ts, *a_cols)),
            "_b": F.when(is_b, F.struct(ts, *b_cols)),
        },
        total={"_n": F.lit(1)},
        snap={"_kept": (~F.col("_change"), "_n")},
    )
    emits = F.col("_change") & ((F.col("_n") - F.col("_kept")) % 2 == 1)
    return line.df.where(emits).select(
        *key,
        F.greatest(F.col(f"_a.{ts}"), F.col(f"_b.{ts}")).alias(ts),
        *[c for c in order if c != ts],
        *[F.col(f"_a.{c}").alias(c) for c in a_cols],
        *[F.col(f"_b.{c}").alias(c) for c in b_cols],
    )
