"""Per-key results where a few keys hold most rows: aggregate both inputs eagerly, join the compact states, roll up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    by: list[str],
    sums: list[str] = (),
    maxima: list[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Aggregate of ``left JOIN right ON on GROUP BY by`` without ever forming the joined rows.

    ``by`` and the measures are columns of left, rows of right only multiply. Each input is reduced to one state
    per key before anything is joined: left to (on, by) -> count, sums, maxima, right to on -> count. Counts
    multiply, sums are scaled by the partner's count, maxima carry over. A key that holds a third of all rows leaves
    every map task as one row, so no task of the join or of the roll-up holds more than one row per map task and key.

    Result: by, joined_rows (long), sum_<c> for each c in sums, max_<c> for each c in maxima.
    Null in ``on`` never joins; null in ``by`` forms a group; null measures count as absent (a sum of nothing but
    nulls is null); repeated rows of either side count as often as they stand; an empty input gives no rows.

    ``how="left"`` keeps every value of by: beside the columns above, which are 0 (joined_rows) or null where no row has a
    partner, it gives rows, all_sum_<c> and all_max_<c> over the rows of left alone, each once; null in ``on`` counts there too.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    keys = list(dict.fromkeys([*on, *by]))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    states = (left.where(known) if how == "inner" else left).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(c).alias(f"__s_{c}") for c in sums],
        *[F.max(c).alias(f"__m_{c}") for c in maxima],
    )
    partners = right.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("__k"))
    joined = states.join(partners, on, how)
    own = [] if how == "inner" else [
        F.sum("__n").alias("rows"),
        *[F.sum(f"__s_{c}").alias(f"all_sum_{c}") for c in sums],
        *[F.max(f"__m_{c}").alias(f"all_max_{c}") for c in maxima],
    ]
    return joined.groupBy(*by).agg(
        F.sum(F.col("__n") * F.coalesce("__k", F.lit(0))).alias("joined_rows"),
        *[F.sum(F.col(f"__s_{c}") * F.col("__k")).alias(f"sum_{c}") for c in sums],
        *[F.max(F.when(F.col("__k").isNotNull(), F.col(f"__m_{c}"))).alias(f"max_{c}") for c in maxima],
        *own,
    )


def key_shares(joins: dict[str, tuple[DataFrame, DataFrame, list[str], str]]) -> DataFrame:
    """Rows of each key value, its share of all rows of its table, and the rows it has in a join of that table.

    ``joins`` maps a name to (left, right, join columns, key column of left). Rows come from eager_join_aggregate: both
    inputs are reduced to compact states by join key, the states are joined and rolled up to one row per value, which holds
    the rows of left as they stand (``n``) and the multiplied counts (``joined_rows``). The totals have one row per
    entry of ``joins``, which is the proven bound under which they are broadcast.

    Result: ref_table, key_value (null included), n (rows), joined_rows, total, share.
    """
    rolled = []
    for name, (left, right, on, key) in joins.items():
        ours = [f"__on{i}" for i in range(len(on))]  # no name of the caller meets one of ours
        left, right = (df.select(*[F.col(c).alias(o) for c, o in zip(on, ours)], *more) for df, more in ((left, [F.col(key).alias("__key")]), (right, [])))
        one = eager_join_aggregate(left, right, ours, ["__key"], how="left")
        rolled.append(one.select(F.lit(name).alias("ref_table"), F.col("__key").alias("key_value"), F.col("rows").alias("n"), "joined_rows"))
    states = cut(reduce(DataFrame.unionByName, rolled))  # one row per value: the totals read it again, not the tables
    totals = states.groupBy("ref_table").agg(F.sum("n").alias("total"))
    return states.join(F.broadcast(totals), "ref_table").withColumn("share", F.col("n") / F.col("total"))


def heavy_keys(joins: dict[str, tuple[DataFrame, DataFrame, list[str], str]], percent: int = 3) -> DataFrame:
    """Key values, not null, that hold at least ``percent`` hundredths of all rows of their table: ref_table, key_value."""
    shares = key_shares(joins)
    return shares.where(F.col("key_value").isNotNull() & (F.col("n") * 100 >= F.col("total") * percent)).select("ref_table", "key_value")
