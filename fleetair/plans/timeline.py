"""Ordered per-key computations that stay parallel when one key is hot.

A window over ``partitionBy(device).orderBy(ts)`` puts each device in one task.
That is the best plan while every device fits in a task, and the wrong one when
a single device holds a third of the table. ``plan_slices`` finds the keys that
are too big and cuts each at quantiles of its order column; ``Timeline`` then runs
the same ordered functions (previous value, last known value, running total) by
(key, slice) and carries the state into each slice from a small per-slice
summary. Keys that fit are untouched: with no hot key the plan is one exchange,
one sort and the plain window functions.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetair.plans.joins import MAX_BROADCAST_BYTES
from fleetair.plans.scratch import written
from fleetair.plans.search import count_at_or_below

# A window task streams this many rows comfortably (a few GB of sort spill).
MAX_ROWS_PER_TASK = 10_000_000
# What is kept of a key's positions; slices are cut at up to half as many quantiles.
SKETCH = 1024

_DAY_US = 86_400_000_000


def position(df: DataFrame, name: str) -> Column:
    """The order column as a long: microseconds for times, itself for integers."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        # Field arithmetic, so the session time zone has no say in it.
        return (
            F.unix_date(c.cast("date")).cast("long") * F.lit(_DAY_US)
            + (F.hour(c) * 60 + F.minute(c)).cast("long") * F.lit(60_000_000)
            + (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
        )
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise TypeError(f"cannot slice on column {name} of type {kind.simpleString()}")


def as_list(names: str | list[str] | tuple[str, ...]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


@dataclass(frozen=True)
class Slices:
    """The keys that need slicing. ``hot`` has, per such key, the ascending edges of its
    slices, into how many equal parts each is cut again, and the cuts among rows without a position."""

    keys: tuple[str, ...]
    pos: str
    tie: str | None = None
    hot: DataFrame | None = None
    n_hot: int = 0
    n_slices: int = 0

    def tag(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` (0 for keys that fit) and ``_hot``. Slices of a key ascend with the
        position; those of rows without one are negative."""
        if self.hot is None:
            return df
        names = [F.col(k).alias(f"_hk{i}") for i, k in enumerate(self.keys)]
        hot = self.hot.select(*names, "_edges", "_parts", "_null_cuts")
        if self.n_slices * 8 <= MAX_BROADCAST_BYTES:
            hot = F.broadcast(hot)
        same = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"_hk{i}")) for i, k in enumerate(self.keys)],
        )
        p = position(df, self.pos)
        at = F.greatest(F.lit(0), count_at_or_below(F.col("_edges"), F.col("_p")) - 1)
        start, end = F.get("_edges", F.col("_at")), F.get("_edges", F.col("_at") + 1)
        width = F.greatest(F.lit(1).cast("long"), F.ceil((end - start) / F.col("_parts")))
        part = F.least(F.col("_parts") - 1, F.floor((F.col("_p") - start) / width))
        below = F.lit(-1).cast("long")
        if self.tie:
            below = below - F.size("_null_cuts") + count_at_or_below(F.col("_null_cuts"), position(df, self.tie))
        numbered = F.when(F.col("_p").isNull(), below).otherwise(
            F.col("_at") * F.col("_parts") + F.greatest(F.lit(0).cast("long"), F.coalesce(part, F.lit(0))))
        return (
            df.join(hot, same, "left").withColumn("_hot", F.col("_edges").isNotNull())
            .withColumn("_p", F.when(F.col("_hot"), p)).withColumn("_at", F.when(F.col("_hot"), at))
            .withColumn("_slice", F.when(F.col("_hot"), numbered).otherwise(F.lit(0)).cast("long"))
            .drop(*[f"_hk{i}" for i in range(len(self.keys))], "_edges", "_parts", "_null_cuts", "_p", "_at")
        )


def no_slices(keys, pos: str) -> Slices:
    """For callers that know every key fits in one task."""
    return Slices(tuple(as_list(keys)), pos)


def plan_slices(
    df: DataFrame, keys, pos: str, max_rows: int | None = None, tie: str | None = None
) -> Slices:
    """Find keys with more than ``max_rows`` rows and cut each into slices.

    One pass over the key and order columns: a count per key and a mergeable quantile sketch
    of its positions, from which slices of about half of ``max_rows`` are cut, narrow where rows
    come in bursts. ``tie``, the order column after ``pos``, cuts the rows without a position. The cuts
    are a table in the scratch folder; the driver sees how many there are. A table whose rows
    all fit in one task is only counted, unless ``max_rows`` is given.
    """
    keys = as_list(keys)
    if max_rows is None:
        if df.count() <= MAX_ROWS_PER_TASK:
            return no_slices(keys, pos)
        max_rows = MAX_ROWS_PER_TASK
    p = position(df, pos)
    q = position(df, tie) if tie else F.lit(None).cast("long")
    per_key = (
        df.select(*keys, p.alias("_p"), q.alias("_q")).groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"), F.count("_p").alias("_n_p"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"),
            F.kll_sketch_agg_bigint("_p", SKETCH).alias("_cuts"),
            F.kll_sketch_agg_bigint(F.when(F.col("_p").isNull(), F.col("_q")), SKETCH).alias("_nulls"),
            F.count(F.when(F.col("_p").isNull(), F.col("_q"))).alias("_n_q"),
        )
        .where(F.col("_n") > max_rows)
    )

    def quantiles(sketch: str, n: str) -> Column:
        """Cuts between as many equal parts as rows call for, or the sketch can tell apart."""
        grid = SKETCH // 2
        want = F.least(F.lit(grid), F.ceil(2 * F.col(n) / max_rows)).cast("int")
        all_cuts = F.kll_sketch_get_quantile_bigint(sketch, F.lit([i / grid for i in range(1, grid)]))
        some = F.transform(F.sequence(F.lit(1), want - 1), lambda i: F.get(all_cuts, F.floor(i * grid / want).cast("int") - 1))
        return F.when((F.col(n) > 0) & (want > 1), some).otherwise(F.array().cast("array<bigint>"))

    found = per_key.withColumns({"_q_p": quantiles("_cuts", "_n_p"), "_q_q": quantiles("_nulls", "_n_q")})
    inner = F.filter("_q_p", lambda x: x > F.col("_lo"))
    edges = F.when(F.col("_lo").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.array_distinct(F.concat(F.array("_lo"), inner, F.array(F.col("_hi") + 1))))
    parts = F.greatest(F.lit(1), F.ceil(F.ceil(2 * F.col("_n_p") / max_rows) / (SKETCH // 2))).cast("long")
    # A value that is three cuts in a row has more rows than a task should.
    tied = F.exists(F.sequence(F.lit(0), F.greatest(F.lit(2), F.size("_q_p")) - 1),
                    lambda i: F.get("_q_p", i) == F.get("_q_p", i + 2))
    hot = written(found.select(
        *keys, edges.alias("_edges"), parts.alias("_parts"), F.array_distinct("_q_q").alias("_null_cuts"), tied.alias("_tied")), "hot")
    n_hot, n_slices, n_tied = hot.agg(
        F.count(F.lit(1)), F.sum(F.size("_edges") * F.col("_parts") + F.size("_null_cuts")), F.count(F.when(F.col("_tied"), 1))).first()
    if not n_hot:
        return no_slices(keys, pos)
    if n_tied:
        warnings.warn(
            f"{n_tied} keys have more than {max_rows} rows that share one value of {pos}; "
            "these are ordered in one task", stacklevel=2)
    return Slices(tuple(keys), pos, tie, hot, n_hot, n_slices)


def _plus(*parts: Column) -> Column:
    """The sum of what is there; NULL if nothing is."""
    there = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
    return F.when(there, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts]))


class Timeline:
    """A table ordered per key, with ordered functions that respect slices.

    ``order`` must be unique within a key; its first column is the one sliced.
    """

    def __init__(self, df: DataFrame, keys, order, slices: Slices | None = None):
        self.keys = as_list(keys)
        self.order = as_list(order)
        self.slices = slices or plan_slices(df, self.keys, self.order[0], tie=self._tie(df))
        self.df = self.slices.tag(df)

    def _tie(self, df: DataFrame) -> str | None:
        """The second order column, if it can be cut as well."""
        kinds = (T.IntegralType, T.TimestampType, T.TimestampNTZType)
        return next((c for c in self.order[1:2] if isinstance(df.schema[c].dataType, kinds)), None)

    @property
    def hot(self) -> bool:
        return self.slices.hot is not None

    @property
    def _part(self) -> list[str]:
        return [*self.keys, "_slice"] if self.hot else self.keys

    def _with(self, df: DataFrame) -> Timeline:
        new = object.__new__(Timeline)
        new.keys, new.order, new.slices, new.df = self.keys, self.order, self.slices, df
        return new

    def with_columns(self, **cols: Column) -> Timeline:
        return self._with(self.df.withColumns(cols))

    def result(self, *drop: str) -> DataFrame:
        return self.df.drop("_slice", "_hot", *drop)

    def scan(
        self, lag: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
        total: dict[str, Column] | None = None, peers: bool = False,
    ) -> Timeline:
        """``walk`` with the value on the previous row as ``lag``."""
        return self.walk(prev=lag, last=last, total=total, peers=peers)

    def walk(
        self,
        prev: dict[str, Column] | None = None,
        among: Column | None = None,
        derive: dict[str, Column] | None = None,
        last: dict[str, Column] | None = None,
        total: dict[str, Column] | None = None,
        snap: dict[str, tuple[Column, str]] | None = None,
        peers: bool = False,
    ) -> Timeline:
        """Add ordered columns, all in one pass over the rows.

        ``prev``: the value on the previous row, or the previous row ``among`` those where this
        holds. ``derive``: columns from these and the row itself, NULL on rows not among them. From both:
        ``last``, the last non-null value up to this row; ``total``, the running sum up to this
        row (with ``peers``, up to the last row that ties with it); ``snap``, the running sum of
        that name as it was at the last row where a condition holds.

        A hot key's slices are walked apart and written. The only row of a slice that cannot know
        what it derives is its first one; it is left out of the slice's sums, and the slice is
        summed up by its sums, its last values and that row. Going through the
        summaries in order tells what each slice begins with and what its first row derives;
        both are then added to the slice's rows. So the input is read once here, however
        much is asked of it.
        """
        prev, derive, last, total, snap = prev or {}, derive or {}, last or {}, total or {}, snap or {}
        if among is not None and (last or snap):
            raise ValueError("last and snap need every row to be among those with a previous one")
        inside = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
        w = Window.partitionBy(*self._part).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        summed = w if peers else upto
        unknown = self.hot and bool(prev)

        df = self.df
        if among is None:
            df = df.withColumns({n: F.lag(c).over(w) for n, c in prev.items()})
        elif prev:
            packed = F.when(inside, F.struct(*[c.alias(n) for n, c in prev.items()]))
            df = df.withColumn("_packed", F.last(packed, ignorenulls=True).over(earlier))
            df = df.withColumns({n: F.col("_packed")[n] for n in prev}).drop("_packed")
        if unknown:
            one = F.when(inside, 1)
            df = df.withColumns({
                "_none": F.col("_hot") & (F.count(one).over(earlier) == 0),
                "_after": F.col("_hot") & (F.count(one).over(upto) > 0),
            }).withColumn("_open", F.col("_none") & inside)

        def closed(c: Column) -> Column:
            return F.when(~F.col("_open"), c) if unknown else c

        df = df.withColumns({n: closed(F.when(inside, c)) for n, c in derive.items()})
        df = df.withColumns({
            **{n: F.last(closed(c), ignorenulls=True).over(upto) for n, c in last.items()},
            **{n: F.sum(closed(c)).over(summed) for n, c in total.items()},
        })
        at_snap = {n: F.when(closed(cond), F.struct(F.col(t).alias("v"))) for n, (cond, t) in snap.items()}
        df = df.withColumns({n: F.last(c, ignorenulls=True).over(upto)["v"] for n, c in at_snap.items()})
        if not self.hot:
            return self._with(df)

        local = written(df, "slices")
        state = written(self._states(local, prev, inside, derive, last, total, snap, closed, unknown), "states")
        width = 16 * (len(self.keys) + 2 * len(state.columns))
        if state.count() * width <= MAX_BROADCAST_BYTES:
            state = F.broadcast(state)
        same = F.col("_slice").eqNullSafe(F.col("_cs")) & F.col("_hot")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_ck{i}"))
        df = local.join(state, same, "left")
        after = F.col("_after") if unknown else F.lit(False)
        if prev:
            df = df.withColumns({n: F.when(F.col("_none"), F.col("_in")[n]).otherwise(F.col(n)) for n in prev})
            df = df.withColumns({n: F.when(inside, c) for n, c in derive.items()})
        first = {t: F.when(after, F.col(f"_o_{t}")) for t in total}
        snaps = {
            n: F.when(F.col(n).isNotNull(), _plus(F.col(n), F.col(f"_t_{t}"), first[t]))
            .when(after & F.col(f"_c_{n}"), _plus(F.col(f"_t_{t}"), first[t])).otherwise(F.col(f"_s_{n}"))
            for n, (_, t) in snap.items()}
        df = df.withColumns({
            **snaps,
            **{n: F.coalesce(F.col(n), F.when(after, F.col(f"_f_{n}")), F.col(f"_l_{n}")) for n in last},
            **{n: _plus(F.col(n), F.col(f"_t_{n}"), first[n]) for n in total},
        })
        helpers = [c for c in state.columns if c not in self.df.columns]
        return self._with(df.drop(*helpers, "_none", "_after", "_open"))

    def _states(self, local, prev, inside, derive, last, total, snap, closed, unknown: bool) -> DataFrame:
        """What each slice of a hot key begins with, and what its first row adds.

        ``_in`` previous values; per total ``_t_`` the sum before and ``_o_`` of the first row; per last
        ``_l_`` the value before and ``_f_`` on the first row; per snap ``_s_`` the sum before and ``_c_``
        whether the first row takes it.
        """
        at = F.struct(*self.order)
        aggs = [F.sum(closed(c)).alias(f"_sum_{n}") for n, c in total.items()]
        aggs += [F.max_by(c, F.when(closed(c).isNotNull(), at)).alias(f"_last_{n}") for n, c in last.items()]
        aggs += [F.max_by(F.struct(F.col(t).alias("v")), F.when(closed(c), at)).alias(f"_snap_{n}") for n, (c, t) in snap.items()]
        if prev:
            values = F.struct(*[c.alias(n) for n, c in prev.items()])
            aggs.append(F.max_by(values, F.when(inside, at)).alias("_left"))
            aggs.append(F.min_by(F.struct(*self.df.columns), F.when(inside, at)).alias("_row"))
        per_slice = local.where("_hot").groupBy(*self.keys, "_slice").agg(*aggs)
        names = [f"_ck{i}" for i in range(len(self.keys))]
        table = per_slice.select(
            *[F.col(k).alias(c) for k, c in zip(self.keys, names)], F.col("_slice").alias("_cs"),
            *[c for c in per_slice.columns if c not in (*self.keys, "_slice")])
        w = Window.partitionBy(*names).orderBy("_cs")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        if prev:
            table = table.withColumn("_in", F.last("_left", ignorenulls=True).over(before))
            # The first row, with what comes before it, as a row of the table itself.
            table = table.select(
                *[c for c in table.columns if c != "_row"], *[F.col(f"_row.{c}").alias(c) for c in self.df.columns],
                F.col("_row").isNotNull().alias("_here"))
            table = table.withColumns({n: F.col("_in")[n] for n in prev})
            table = table.withColumns({n: F.when(inside, c) for n, c in derive.items()})
            here = F.col("_here")
        else:
            here = F.lit(False)

        def first(c: Column) -> Column:
            return F.when(here, c) if prev else F.lit(None)

        table = table.withColumns({
            **{f"_o_{n}": first(c).cast(local.schema[n].dataType) for n, c in total.items()},
            **{f"_f_{n}": first(c).cast(local.schema[n].dataType) for n, c in last.items()},
            **{f"_c_{n}": F.coalesce(first(c), F.lit(False)).cast("boolean") for n, (c, _) in snap.items()},
        })
        table = table.withColumns({
            **{f"_t_{n}": F.sum(_plus(F.col(f"_sum_{n}"), F.col(f"_o_{n}"))).over(before) for n in total},
            **{f"_l_{n}": F.last(F.coalesce(F.col(f"_last_{n}"), F.col(f"_f_{n}")), ignorenulls=True).over(before) for n in last},
        })

        def left(n: str, t: str) -> Column:
            """The sum as the slice leaves it behind."""
            begin = (F.col(f"_t_{t}"), F.col(f"_o_{t}"))
            return F.when(F.col(f"_snap_{n}").isNotNull(), _plus(F.col(f"_snap_{n}.v"), *begin)).when(F.col(f"_c_{n}"), _plus(*begin))

        table = table.withColumns({f"_s_{n}": F.last(left(n, t), ignorenulls=True).over(before) for n, (_, t) in snap.items()})
        return table.select(
            *names, "_cs", *(["_in"] if prev else []), *[f"_{k}_{n}" for n in total for k in "to"],
            *[f"_{k}_{n}" for n in last for k in "lf"], *[f"_{k}_{n}" for n in snap for k in "sc"])


def first_per_group(df: DataFrame, keys, order, count: str | None = None) -> DataFrame:
    """The first row of each group by ``order``, as a grouped aggregate.

    Rows are reduced before the exchange, so a group of a billion copies sends one
    row per map task; a ranking window would move them all. The reduction is a sort
    aggregate, since whole rows are no fixed-width value: each task sorts its rows.
    """
    keys, order = as_list(keys), as_list(order)
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    picked = df.groupBy(*keys).agg(*aggs)
    return picked.select(
        *[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in df.columns],
        *([count] if count else []),
    )
