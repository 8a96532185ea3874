"""Segmented scans: running sums and looks at the row before, in groups of which one may hold most of the rows.

A window over a group is one task's work. Groups with more rows than a task's share are cut at quantiles of their order into
segments; segments are scanned apart, and what a segment passes on, its last row and its sum, is carried over from one to
the next in a table of at most some hundreds of rows a hot group. Where no group is hot the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.session import written

#: Segments of a hot group, at most.
SEGMENTS = 256
Prev = Callable[[str], Column]


def same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    """Rows that agree in the columns, where null is null."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def hot_cuts(df: DataFrame, by: Sequence[str], at: str) -> DataFrame | None:
    """(by, _cuts): of each group with more rows than a task's share the quantiles of ``at``; None where there is none.

    There are fewer such groups than shuffle partitions. Counts and quantile sketches are merged before they are shuffled.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(df.groupBy(*by).agg(F.count("*").alias("_n")), "groups")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(1, total // parts)).drop("_n")
    if parts < 2 or hot.isEmpty():
        return None
    n = min(SEGMENTS, parts)
    inside = df.join(F.broadcast(hot), same(df, hot, by), "left_semi")
    cuts = F.percentile_approx(F.col(at).cast("double"), [k / n for k in range(1, n)], 10_000)
    return inside.groupBy(*by).agg(F.array_distinct(F.coalesce(cuts, F.array().cast("array<double>"))).alias("_cuts"))


def segmented(df: DataFrame, by: Sequence[str], at: str, nulls_last: bool) -> DataFrame | None:
    """``df`` with _part, the number of a row's segment: null outside hot groups. None where no group is hot. Rows of one ``at`` stay together."""
    hot = hot_cuts(df, by, at)
    if hot is None:
        return None
    hot = written(hot, "cuts")
    here = F.size(F.filter("_cuts", lambda c: c <= F.col(at).cast("double")))
    part = F.when(F.col("_cuts").isNotNull(), F.when(df[at].isNull(), F.lit(SEGMENTS if nulls_last else -1)).otherwise(here))
    return df.join(F.broadcast(hot), same(df, hot, by), "left").select(*[df[c] for c in df.columns], part.alias("_part"))


def carried(segments: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    """(by, _part, _before): the sum of ``amount`` over the segments of the group before each."""
    w = Window.partitionBy(*by).orderBy("_part")
    return segments.select(*by, "_part", (F.sum(amount).over(w) - amount).alias("_before"))


def with_carried(rows: DataFrame, before: DataFrame, by: Sequence[str], total: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``total`` and what is carried into the row's segment."""
    keys = [*by, "_part"]
    held = before.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], "_before")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)])
    return rows.join(F.broadcast(held), on, "left").withColumn(name, total + F.coalesce("_before", F.lit(0))).drop("_before", *[f"_k{k}" for k in range(len(keys))])


def numbered(df: DataFrame, by: Sequence[str], at: str, key: str, looked: Sequence[str], new: Callable[[Prev], Column], name: str, *, nulls_last: bool = False) -> DataFrame:
    """Rows with ``name``, the number (from 0) of their island in the group's order by ``at``, then ``key``.

    ``new`` says of a row whether it begins an island: it gets a function from the name of a column in ``looked`` to the
    value in the row before, null in a group's first row. Null answers are no. Null groups are one.
    """
    order = [F.col(at).asc_nulls_last() if nulls_last else F.col(at), F.col(key)]
    cut = segmented(df, by, at, nulls_last)
    groups = [*by] if cut is None else [*by, "_part"]
    w = Window.partitionBy(*groups).orderBy(*order)
    rows = (df if cut is None else cut).withColumn("_new", F.coalesce(new(lambda c: F.lag(c).over(w)), F.lit(False)).cast("int"))
    rows = rows.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if cut is None:
        return rows.drop("_new")
    rows = written(rows, "segments")
    place = F.struct(F.col(at).isNull() if nulls_last else F.col(at).isNotNull(), at, key)
    ends = rows.where(F.col("_part").isNotNull()).groupBy(*groups).agg(F.min_by(F.struct(*looked), place).alias("_head"), F.max_by(F.struct(*looked), place).alias("_tail"), F.sum("_new").alias("_sum"))
    before = F.lag("_tail").over(Window.partitionBy(*by).orderBy("_part"))
    heads = ends.withColumn("_tail", before).select(*groups, "_sum", *[F.col(f"_head.{c}").alias(c) for c in looked if c not in groups], *[F.col(f"_tail.{c}").alias(f"_prev_{c}") for c in looked])
    begins = F.coalesce(new(lambda c: F.col(f"_prev_{c}")), F.lit(False)).cast("int")
    # A segment begins with what all before it hold, their heads included, and with its own head.
    counted = heads.select(*groups, begins.alias("_begins"), (F.col("_sum") + begins).alias("_all"))
    offset = carried(counted, by, F.col("_all")).join(counted.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(groups)], "_begins"), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(groups)]))
    offset = offset.select(*groups, (F.col("_before") + F.col("_begins")).alias("_before"))
    return with_carried(rows, offset, by, F.col(name), name).drop("_new", "_part")


def running_in_groups(df: DataFrame, by: Sequence[str], at: str, amount: str, name: str) -> DataFrame:
    """Rows with ``name``: the sum of ``amount`` over the rows of the group up to this one, by ``at``, which is not null and no two rows of a group share."""
    cut = segmented(df, by, at, False)
    groups = [*by] if cut is None else [*by, "_part"]
    w = Window.partitionBy(*groups).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = (df if cut is None else cut).withColumn(name, F.sum(amount).over(w))
    if cut is None:
        return rows
    rows = written(rows, "segments")
    sums = rows.where(F.col("_part").isNotNull()).groupBy(*groups).agg(F.sum(amount).alias("_all"))
    return with_carried(rows, carried(sums, by, F.col("_all")), by, F.col(name), name).drop("_part")
