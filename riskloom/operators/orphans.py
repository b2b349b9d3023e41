"""References to records that do not exist or came later, by compressed bitmaps of dictionary-encoded keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ..runtime import cut
from . import containers as C

#: Rows of reference and parent tables for each dictionary bucket.
ROWS_PER_BUCKET = 131_072

MISSING, LATE, SAME_PERIOD = 0, 1, 2


@pandas_udf(BinaryType())
def _container(ids: pd.Series) -> pd.Series:
    """The ids of one range as a compressed container."""
    return ids.map(lambda x: C.to_bytes(C.of_values(x)))


@pandas_udf(ArrayType(StructType([StructField("bit", IntegerType()), StructField("state", IntegerType())])))
def _survivors(maps: pd.Series) -> pd.Series:
    """Ids of one key range that are referenced while no parent is known: reference AND-NOT parent, period by period, on the compressed forms."""
    out = []
    for entries in maps:
        refs: dict[int, C.Container] = {}
        parents: dict[int, C.Container] = {}
        for e in entries:
            (refs if e["is_ref"] else parents)[e["period"]] = C.from_bytes(e["ids"])
        ever = C.EMPTY
        for ids in parents.values():
            ever = C.either(ever, ids)
        found: dict[int, int] = {}
        known = C.EMPTY
        loads = sorted(parents)
        k = 0
        for period in sorted(refs):
            while k < len(loads) and loads[k] < period:
                known = C.either(known, parents[loads[k]])
                k += 1
            unknown = C.and_not(refs[period], known)
            now = parents.get(period, C.EMPTY)
            later = C.and_not(unknown, now)
            for state, ids in ((SAME_PERIOD, C.both(unknown, now)), (LATE, C.both(later, ever)), (MISSING, C.and_not(later, ever))):
                for bit in C.values(ids).tolist():
                    found[bit] = state
        out.append([{"bit": b, "state": s} for b, s in found.items()])
    return pd.Series(out)


def orphan_keys(refs: DataFrame, parents: DataFrame, keys: list[str], at: str, rows: int | None = None) -> DataFrame:
    """Distinct keys of refs that had no parent by the end of some period in which they were referenced, or may not have had.

    Keys of both sides become integers: a hash bucket (their number follows ``rows``, a bound of the rows of both sides,
    counted if not given) and the dense rank of the key inside it. The dictionary is written once. Per bucket, range of
    65,536 ids, side and month of ``at`` the ids become one compressed container (array, runs or bitmap by density);
    per range the containers are combined as they are (reference AND-NOT parents known so far) and the surviving ids are decoded and
    joined back to the dictionary. Containers of one range are as many as there are months, so no group is unbounded.

    Result: keys, __first_at (earliest ``at`` of a parent, null if there is none).
    """
    rows = refs.count() + parents.count() if rows is None else rows
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    none = F.lit(None)
    names = keys
    keys = [f"__k{i}" for i in range(len(names))]  # no name of the caller meets one of ours
    refs, parents = (df.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col(at).alias("__at")) for df in (refs, parents))
    at, month = "__at", (F.year("__at") * 12 + F.month("__at")).cast("int")
    both = refs.select(*keys, none.cast("timestamp_ntz").alias("first_at"), month.alias("period")).unionByName(
        parents.select(*keys, F.col(at).cast("timestamp_ntz").alias("first_at"), none.cast("int").alias("period"))
    )
    states = both.groupBy(*keys).agg(F.min("first_at").alias("first_at"), F.collect_set("period").alias("periods"))
    states = states.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    coded = cut(states.withColumn("id", F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys)) - 1))
    parent_month = (F.year("first_at") * 12 + F.month("first_at")).cast("int")
    entries = F.concat(
        F.transform("periods", lambda p: F.struct(F.lit(True).alias("is_ref"), p.alias("period"))),
        F.when(F.col("first_at").isNotNull(), F.array(F.struct(F.lit(False).alias("is_ref"), parent_month.alias("period")))).otherwise(F.array().cast("array<struct<is_ref: boolean, period: int>>")),
    )
    maps = (
        coded.select("bucket", "id", F.explode(entries).alias("e"))
        .select("bucket", F.floor(F.col("id") / C.RANGE).cast("int").alias("range"), "e.*", (F.col("id") % C.RANGE).cast("int").alias("low"))
        .groupBy("bucket", "range", "is_ref", "period")
        .agg(F.collect_list("low").alias("low"))
        .select("bucket", "range", F.struct("is_ref", "period", _container("low").alias("ids")).alias("map"))
        .groupBy("bucket", "range")
        .agg(F.collect_list("map").alias("maps"))
    )
    bits = maps.select("bucket", "range", F.explode(_survivors("maps")).alias("s")).select("bucket", (F.col("range") * C.RANGE + F.col("s.bit")).cast("int").alias("id"))
    return coded.join(bits, ["bucket", "id"], "left_semi").select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col("first_at").alias("__first_at"))


def orphan_rows(refs: DataFrame, parents: DataFrame, keys: list[str], at: str, join, rows: int | None = None) -> DataFrame:
    """Rows of refs whose key no parent has ('missing') or whose parent's earliest ``at`` is after the row's ('late').

    The bitmaps leave the keys that can matter; their rows are then compared exactly by time. ``join`` joins a
    big and a small frame on columns (see runtime.join_measured). Null keys are no references and give no row.
    """
    refs = refs.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    parents = parents.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    hit = join(refs, orphan_keys(refs, parents, keys, at, rows), keys)
    first = F.col("__first_at")
    late = first > F.col(at).cast("timestamp_ntz")
    return hit.where(first.isNull() | late).withColumn("state", F.when(first.isNull(), F.lit("missing")).otherwise(F.lit("late"))).drop("__first_at")
