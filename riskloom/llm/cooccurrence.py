"""Items that appear together: counts of pairs and how much more often than by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import CHUNK, pair_counts


def together(rows: DataFrame, group: str, basket: str, item: str, min_together: int = 1, min_lift: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items that share baskets of the same group, with their counts and association scores.

    Large baskets are split into chunks of items, the products of chunk pairs are distributed and combined with the
    pairs of ordinary baskets (see pair_counts, which prunes exactly what no wanted pair can contain).

    Result: group, item_a, item_b (smaller string first), n_baskets (N), n_a, n_b, n_ab, lift = n_ab * N / (n_a * n_b),
    jaccard, one row per pair with n_ab >= min_together and n_ab * N >= min_lift * n_a * n_b. N counts baskets with
    null items too; null groups, baskets and items are in no pair; repeated rows count once. Empty input: no rows.
    """
    named = pair_counts(rows, group, basket, item, min_together, min_lift, chunk)
    first = F.col("i1") < F.col("i2")
    return named.select(
        F.col("g").alias(group),
        F.least("i1", "i2").alias("item_a"),
        F.greatest("i1", "i2").alias("item_b"),
        F.col("total").alias("n_baskets"),
        F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("n_a"),
        F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("n_b"),
        "n_ab",
        (F.col("n_ab") * F.col("total") / (F.col("n1") * F.col("n2"))).alias("lift"),
        (F.col("n_ab") / (F.col("n1") + F.col("n2") - F.col("n_ab"))).alias("jaccard"),
    )
