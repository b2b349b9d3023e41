"""Human verdicts on findings: precision, reliability, and findings adjusted by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _is(verdict: str) -> Column:
    return F.lower("verdict") == verdict


def unique(entries: DataFrame) -> DataFrame:
    """Entries with a non-empty id, of repeated ids the earliest."""
    rows = entries.where((F.col("id") != "") & F.col("id").isNotNull())
    rest = [c for c in entries.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("timestamp", *[c for c in rest if c != "timestamp"])).alias("e")).select("id", "e.*")


def verdict_weight(verdict: Column) -> Column:
    return F.when(F.lower(verdict) == "correct", 1).when(F.lower(verdict) == "incorrect", -1).otherwise(0)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(entries: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts, findings and precision (uncertain ones left out) per group, or over all if ``by`` is empty."""
    out = entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_is("correct")).alias("correct"), F.count_if(_is("incorrect")).alias("incorrect"), F.count_if(_is("uncertain")).alias("uncertain"), F.countDistinct("finding_id").alias("findings")
    )
    judged = F.col("correct") + F.col("incorrect")
    return out.withColumn("precision", _ratio(F.col("correct"), judged)).withColumn("incorrect_rate", _ratio(F.col("incorrect"), F.col("total")))


def finding_ratios(entries: DataFrame) -> DataFrame:
    """Confirmed and rejected share of each finding's verdicts, uncertain ones counting in the base."""
    out = entries.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(_is("correct")).alias("yes"), F.count_if(_is("incorrect")).alias("no"))
    return out.select("finding_id", "n", (F.col("yes") / F.col("n")).alias("confirm"), (F.col("no") / F.col("n")).alias("reject"))


def precision_at(entries: DataFrame, by: str, k: int) -> DataFrame:
    """Precision over the newest k verdicts of each group that are not uncertain.

    Only k rows per group survive each map task's share of the window (the group limit is pushed below the shuffle).
    """
    newest = Window.partitionBy(by).orderBy(F.desc("timestamp"), F.desc("id"))
    rows = entries.where(~_is("uncertain")).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)
    return rows.groupBy(by).agg((F.count_if(_is("correct")) / F.count(F.lit(1))).alias("precision"), F.count(F.lit(1)).alias("n"))


def adjust(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings after their verdicts: with three or more, 80 % confirmed is validated; 60 % rejected is lowered by its severity."""
    ratios = finding_ratios(entries).where("n >= 3")
    out = findings.join(ratios, "finding_id", "left")
    confirmed, rejected = F.coalesce(F.col("confirm") >= 0.8, F.lit(False)), F.coalesce(F.col("reject") >= 0.6, F.lit(False))
    lower = F.when(F.col("severity") == "critical", "warning").otherwise("info")
    return out.withColumn("validated", confirmed).withColumn("severity", F.when(rejected & ~confirmed, lower).otherwise(F.col("severity"))).drop("n", "confirm", "reject")


def report(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings on the feedback itself: HITL-001 to 003."""
    total = metrics(entries, []).where("total > 0")
    one = F.lit(1).alias("one")
    n = findings.agg(F.count(F.lit(1)).alias("n_findings")).select(one, "n_findings")
    first = total.select(F.lit("HITL-001").alias("rule"), F.when(F.col("precision") < 0.5, "warning").otherwise("info").alias("severity"), F.format_string("%d verdicts", "total").alias("message"))
    dense = total.select("*", one).join(n, "one").where((F.col("n_findings") > 10) & (F.col("total") / F.col("n_findings") < 5))
    second = dense.select(F.lit("HITL-002").alias("rule"), F.lit("info").alias("severity"), F.lit("few verdicts for the findings").alias("message"))
    weak = metrics(entries, ["engine"]).where("precision < 0.5")
    return first.unionByName(second).unionByName(weak.select(F.lit("HITL-003").alias("rule"), F.lit("warning").alias("severity"), F.format_string("low precision of %s", "engine").alias("message")))
