"""Order, percentiles and quotas. Every order ends with a key, so ties are decided."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.operators.joins import hub_join
from lumiquarry.operators.scan import running_in_groups
from lumiquarry.session import written


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``rank`` names a column for their place, from 1."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def linear_percentile(value: Column, percent: float) -> Column:
    """The percentile with linear interpolation; nulls don't count."""
    return F.percentile(value, F.lit(percent / 100))


def nearest_rank(value: Column, percent: float) -> Column:
    """The element at floor(p/100 (n - 1)) of the ascending values. Sorts a group in one task; ``group_elements`` does not."""
    values = F.sort_array(F.collect_list(value))
    return F.try_element_at(values, (F.floor(F.lit(percent / 100) * (F.size(values) - 1)) + 1).cast("int"))


def upper_median(value: Column) -> Column:
    """The element at n div 2 of the ascending values. Sorts a group in one task; ``group_elements`` does not."""
    values = F.sort_array(F.collect_list(value))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def interpolated(low: Column, high: Column, part: Column) -> Column:
    """``low * (1 - part) + high * part``, of which the first product and the sum are rounded once, as the SQL engine does: between neighbouring doubles other ways come out on the other one."""
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low.cast("double"), (1 - part).cast("double"), (high * part).cast("double")).cast("double")
    return F.when(part == 0, low).when(low.isNotNull() & high.isNotNull(), fused)


def group_elements(df: DataFrame, by: Sequence[str], value: str, places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, one column a place): elements of each group's ascending values; nulls don't count, a group of nulls has none.

    A place is a function from the group's number of values to a place from 0, which may lie between two: then the element
    is interpolated. Equal values are counted first and counts summed up in order, hot groups by segments (``scan``), so
    that no task sees a group's values together.
    """
    by = list(by)
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = running_in_groups(written(per, "values"), by, "_v", "_c", "_to")
    # The place of an element is known by its group's size alone; sizes meet the rows of large groups without a shuffle.
    upto = written(upto.withColumn("_by", F.struct(*by)), "running")
    size = upto.groupBy("_by").agg(F.sum("_c").alias("_n"), F.count("*").alias("_rows"))
    both = hub_join(upto, size, "_by", "_rows", upto.count())
    at = lambda k: F.min(F.when(F.col("_to") > k, F.col("_v")))  # noqa: E731  the value at place k from 0

    def element(place: Column) -> Column:
        if both.select(place.alias("place")).schema["place"].dataType.typeName() != "double":
            return at(place)
        return interpolated(at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place)))

    found = both.groupBy("_by").agg(*[element(place(F.col("_n"))).alias(name) for name, place in places.items()])
    groups = df.groupBy(*by).agg(F.lit(1).alias("_one")).drop("_one")
    found = found.select(*[F.col(f"_by.{c}").alias(f"_b{k}") for k, c in enumerate(by)], *places)
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)])
    return groups.join(found, on, "left").select(*by, *places)


def linear_place(percent: float) -> Callable[[Column], Column]:
    """Where the percentile with linear interpolation lies."""
    return lambda n: (n - 1) * F.lit(percent / 100)


def nearest_place(percent: float) -> Callable[[Column], Column]:
    """The place floor(p/100 (n - 1))."""
    return lambda n: F.floor(F.lit(percent / 100) * (n - 1))


def upper_median_place(n: Column) -> Column:
    """The place n div 2."""
    return F.floor(n / 2)


def ordinal_percent(order: Sequence[Column], by: Sequence[str] = ()) -> Column:
    """Place by n - 1 in percent, ties apart. Within groups ``by``; for a whole table see ``global_rank``."""
    w = Window.partitionBy(*by)
    return (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1) * 100


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """The rank from 0 that ties share as their mean. A group is one task's work; see ``average_percents``."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1 + (ties - 1) / 2


def average_percent(value: str, by: Sequence[str] = ()) -> Column:
    """W5 in [0, 1]; 1 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n > 1, average_rank(value, by) / (n - 1)).otherwise(1.0)


def average_percents(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """W5 in [0, 1] as a column of ``df``, 1 for a single row, in groups of which one may hold most rows. Nulls are one least value.

    Equal values are counted first; counts are summed up in order, hot groups by segments, and meet their rows again by
    ``hub_join``, so that neither a group nor a value that many rows share is one task's work.
    """
    by = list(by)
    rows = df.withColumn("_at", F.struct(*by, value))
    per = rows.groupBy("_at").agg(F.count("*").alias("_c"))
    per = written(per.select("_at", *[F.col(f"_at.{c}").alias(c) for c in by], F.coalesce(F.col(f"_at.{value}").cast("double"), F.lit(float("-inf"))).alias("_v"), "_c"), "values")
    upto = written(running_in_groups(per, by, "_v", "_c", "_to"), "running")
    size = upto.withColumn("_by", F.struct(*by)).groupBy("_by").agg(F.sum("_c").alias("_n"), F.count("*").alias("_rows"))
    both = hub_join(upto.withColumn("_by", F.struct(*by)), size, "_by", "_rows", upto.count())
    before, n = F.col("_to") - F.col("_c"), F.col("_n")
    place = both.select("_at", "_c", F.when(n > 1, (before + (F.col("_c") - 1) / 2) / (n - 1)).otherwise(1.0).alias(name))
    total = per.agg(F.sum("_c")).first()[0] or 0
    return hub_join(rows, place, "_at", "_c", total).drop("_at")


def running_total(df: DataFrame, order: Sequence[Column], value: Column, total: str) -> DataFrame:
    """Rows with ``total``: the sum of the whole numbers ``value`` over the rows up to and with this one, without a single task.

    Rows are range-partitioned and sorted once, summed up as they stream through their part, and written, so that parts are
    the same for both their readers; each part is then offset by the sums of the parts before, one row a part.
    """
    keyed = df.withColumn("_value", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            sums = np.cumsum(batch.column("_value").to_numpy()) + so_far
            so_far = int(sums[-1]) if len(sums) else so_far
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "_sum"])

    local = written(keyed.mapInArrow(summed, keyed.withColumn("_sum", F.lit(0).cast("long")).schema), "ranked")
    sums = local.groupBy("_part").agg(F.sum("_value").alias("_all"))
    before = sums.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(total, F.col("_before") + F.col("_sum")).drop("_part", "_value", "_sum", "_before")


def global_rank(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Numbers all rows from 0 in order. See ``running_total``."""
    return running_total(df, order, F.lit(1).cast("long"), rank).withColumn(rank, F.col(rank) - 1)


def whole_percentile(df: DataFrame, value: Column, percent: float, name: str = "percentile") -> DataFrame:
    """A5, A7 of a whole table: one row (name); null without values.

    Values are counted per distinct value, counts are summed up by ranges, and the two values that hold the wanted places
    are read off: no task sees all of them, as the exact aggregate of one group would.
    """
    per = df.select(value.cast("double").alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("_c"))
    upto = running_total(per, [F.col("_v")], F.col("_c"), "_to")
    place = (F.col("_n") - 1) * (percent / 100)
    ends = upto.join(F.broadcast(upto.agg(F.sum("_c").alias("_n"))), F.lit(True)).withColumn("_at", place)
    at = lambda k: F.min(F.when(F.col("_to") > k, F.col("_v")))  # noqa: E731  the value at place k from 0
    low, high, part = at(F.floor("_at")), at(F.ceil("_at")), F.max(F.col("_at") - F.floor("_at"))
    return ends.agg(interpolated(low, high, part).alias(name))


def agreement(df: DataFrame, order: Sequence[Column], key: str, liked: DataFrame) -> DataFrame:
    """(median_percent, n): the median place in percent, by one model's order of all rows, of the ``liked`` ones (key)."""
    n = df.agg(F.count("*").alias("_n"))
    ranked = global_rank(df, order, "_r").join(F.broadcast(n), F.lit(True)).withColumn("_p", F.col("_r") / F.greatest(F.lit(1), F.col("_n") - 1) * 100)
    own = ranked.join(liked.select(key), key, "left_semi")
    return whole_percentile(own, F.col("_p"), 50, "median_percent").join(own.agg(F.count("*").alias("n")), F.lit(True))


def quota_then_best(df: DataFrame, by: str, score: Column, key: str, most: int) -> DataFrame:
    """max(1, most div groups) best rows of each group, then the best leftovers up to ``most``."""
    groups = df.agg(F.count_distinct(by).alias("groups"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.col("groups"), F.lit(1)))).cast("int")
    order = [score.desc_nulls_last(), F.col(key)]
    ranked = df.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).join(F.broadcast(groups.select(quota.alias("_quota"))), F.lit(True))
    taken = ranked.where(F.col("_at") <= F.col("_quota"))
    used = taken.agg(F.count("*").alias("_used"))
    # No more than ``most`` leftovers of a group can be chosen, and no more than that in all.
    rest = ranked.where((F.col("_at") > F.col("_quota")) & (F.col("_at") <= F.col("_quota") + most)).orderBy(*order).limit(most)
    rest = rest.withColumn("_place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(used), F.lit(True)).where(F.col("_place") <= most - F.col("_used"))
    return taken.select(*df.columns).union(rest.select(*df.columns))


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 200) -> DataFrame:
    """Rows offset to offset + limit (2000 at most) of the order."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 2000))


def photo_order(mode: str, taken: str = "taken_at", aesthetic: str = "aesthetic", iqa: str = "iqa", key: str = "id", seed: int = 0) -> list[Column]:
    """The list's orders. The score orders are for rows that have the score."""
    return {
        "taken_at": [F.col(taken).asc_nulls_last(), F.col(key)], "aesthetic": [F.col(aesthetic).desc_nulls_last(), F.col(key)],
        "iqa": [F.col(iqa).desc_nulls_last(), F.col(key)], "random": [F.rand(seed), F.col(key)],
    }[mode]


def extremes(df: DataFrame, order: Sequence[Column], n: int, top: bool) -> DataFrame:
    """The first ``n`` rows, or the last ``n`` with the very last first."""
    if not top:
        return df.orderBy(*order).limit(n)
    # A descending order of the same keys: nulls, first in ascending order, come last.
    return df.orderBy(*[c.desc() for c in order]).limit(n)
