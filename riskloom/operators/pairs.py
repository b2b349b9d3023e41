"""Counts of pairs of items in the same basket, large baskets split into chunk-pair products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, join_measured

#: Items of one chunk of a large basket, on average.
CHUNK = 128
#: Buckets of the item dictionary; each is one group of a window.
BUCKETS = 1024


def _within(ids: Column) -> Column:
    """Each id of a sorted array with the rest of the array behind it."""
    return F.transform(ids, lambda x, i: F.struct(x.alias("a"), F.slice(ids, i + 2, F.size(ids)).alias("rest")))


def pair_counts(rows: DataFrame, group: str, basket: str, item: str, min_together: int = 1, min_lift: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items that share baskets of the same group, in no order of the two, with their counts.

    A basket of more than ``chunk`` rows is split by item hash into chunks of about that many items. A small basket
    is one chunk and makes its pairs in place; of a large one, every pair of chunks is a product of its own that any task
    may take, so no task holds more than two chunks of a basket. Items are integers while pairs are counted, map-side first.

    Exact pruning before pairs are formed: n_ab is at most min(n_a, n_b), so an item with n < min_together, or with
    n * min_lift > N, is in no wanted pair.

    Result: g, i1, i2, n1, n2 (baskets of each), total (baskets of the group, those with nothing but null items too), n_ab; one row per
    pair with n_ab >= min_together and n_ab * total >= min_lift * n1 * n2. Null groups, baskets and items are in no
    pair; repeated rows count once. Empty input: no rows.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(basket).alias("b"), F.col(item).alias("i")).where(F.col("g").isNotNull() & F.col("b").isNotNull())
    sizes = cut(rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")))
    totals = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    large = sizes.where(F.col("n") > chunk).select("g", "b", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    split = join_measured(rows.where(F.col("i").isNotNull()), large, ["g", "b"], "left").select(
        "g", "b", "i", F.coalesce("chunks", F.lit(1)).alias("chunks")
    )
    split = split.withColumn("chunk", F.when(F.col("chunks") == 1, 0).otherwise(F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int")))
    parts = split.groupBy("g", "b", "chunks", "chunk").agg(F.collect_set("i").alias("items"))
    flat = parts.select("g", "b", "chunks", "chunk", F.explode("items").alias("i"))

    support = flat.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"))
    wanted = (F.col("n") >= min_together) & (F.col("n") * min_lift <= F.col("total"))
    coded = support.join(totals, "g").where(wanted).withColumn("bucket", F.pmod(F.xxhash64("g", "i"), F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("g", "i"))
    words = cut(coded.select("g", "i", "n", "total", F.shiftleft(F.col("bucket"), 40).bitwiseOR(rank.cast("long")).alias("id")))

    known = join_measured(flat, words.select("g", "i", "id"), ["g", "i"])
    chunks = known.groupBy("g", "b", "chunks", "chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    inside = chunks.where(F.size("ids") > 1).select(F.explode(_within(F.col("ids"))).alias("p")).select("p.a", F.explode("p.rest").alias("b"))
    partner = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("chunk")))
    products = (
        chunks.where(F.col("chunks") > 1)
        .select("g", "b", "chunk", "ids", partner.alias("other"))
        .groupBy("g", "b", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
        .agg(
            F.max(F.when(F.col("chunk") < F.col("other"), F.col("ids"))).alias("left"),
            F.max(F.when(F.col("chunk") > F.col("other"), F.col("ids"))).alias("right"),
        )
    )
    across = products.select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = inside.unionByName(across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= min_together)

    one = words.select(F.col("id").alias("a"), F.col("g"), F.col("i").alias("i1"), F.col("n").alias("n1"), "total")
    two = words.select(F.col("id").alias("b"), F.col("i").alias("i2"), F.col("n").alias("n2"))
    named = pairs.join(one, "a").join(two, "b").where(F.col("n_ab") * F.col("total") >= F.lit(min_lift) * F.col("n1") * F.col("n2"))
    return named.select("g", "i1", "i2", "n1", "n2", "total", "n_ab")
