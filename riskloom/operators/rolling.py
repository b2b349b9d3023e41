"""Trailing totals from cumulative sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(daily: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals and averages of ``value`` over the trailing periods of every day from an entity's first to its last.

    daily may hold several rows per (entity, day); they are summed first, map-side. Prefix sums run over the days with
    rows, each is carried forward over the empty days up to the next, and a trailing total is the difference of
    the prefix values at the two ends of its window. A window task holds one entity's days, never its rows.

    Result: entity, day (date), value of the day, s<p> and avg<p> (= s<p> / p) for each period p.
    Null entity, day or value: rows without entity or day are left out, null values are 0. Empty input: no rows.
    """
    per_day = (
        daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(entity, F.col(day).cast("date").alias("day"))
        .agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("value"))
    )
    order = Window.partitionBy(entity).orderBy("day")
    prefix = per_day.withColumn("prefix", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "until", F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day"))
    )
    dense = prefix.withColumn("each", F.explode(F.sequence("day", "until"))).select(
        entity, F.col("each").alias("day"), F.when(F.col("each") == F.col("day"), F.col("value")).otherwise(F.lit(0)).alias("value"), "prefix"
    )
    for p in periods:
        total = F.col("prefix") - F.coalesce(F.lag("prefix", p).over(order), F.lit(0))
        dense = dense.withColumn(f"s{p}", total)
    return dense.select(entity, "day", "value", *[c for p in periods for c in (F.col(f"s{p}"), (F.col(f"s{p}") / F.lit(p)).alias(f"avg{p}"))])
