"""Findings checked by an external model: prompts, answers, cache, risk. The client is injected; there is no network here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

ANSWER = "is_valid boolean, confidence double, explanation string, suggested_fix string"
RESULT = "finding_id string, response string, failed boolean"


def cache_key():
    return F.concat_ws(":", "finding_id", "file_path", F.col("line").cast("string"), "message")


def prompts(findings: DataFrame) -> DataFrame:
    """Findings with the question to ask."""
    text = F.format_string('Is this finding valid? Answer in JSON with is_valid, confidence, explanation, suggested_fix.\nEngine: %s\nSeverity: %s\nFile: %s:%d\nMessage: %s', "engine", "severity", "file_path", F.col("line").cast("long"), "message")
    return findings.withColumn("prompt", text)


def to_validate(findings: DataFrame, cache: DataFrame) -> DataFrame:
    """Findings the cache (key) does not know yet."""
    return findings.withColumn("key", cache_key()).join(cache.select("key").distinct(), "key", "left_anti")


def ask(findings: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """Answers of the client, one call per finding, in the executors; an exception becomes a failed answer."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, p in zip(batch["finding_id"], batch["prompt"]):
                try:
                    rows.append((i, client(p), False))
                except Exception as e:  # noqa: BLE001 - any failure of the client is an answer
                    rows.append((i, str(e), True))
            yield pd.DataFrame(rows, columns=["finding_id", "response", "failed"])

    return prompts(findings).select("finding_id", "prompt").mapInPandas(call, RESULT)


def parse(answers: DataFrame) -> DataFrame:
    """Typed answers: code fences taken off, missing fields valid and 0.5, confidence within [0, 1], empty or "null" fixes dropped.

    An answer that is no JSON object counts as valid with confidence 0.5; a failed call as invalid, its message as fix.
    """
    bare = F.trim(F.regexp_replace("response", r"(?s)^.*?```(?:json)?\s*|\s*```.*$", ""))
    text = F.when(F.col("response").contains("```"), bare).otherwise(F.trim("response"))
    a = F.from_json(text, ANSWER, {"mode": "PERMISSIVE"})
    fix = F.trim(a["suggested_fix"])
    return answers.select(
        "finding_id",
        F.when(F.col("failed"), False).otherwise(F.coalesce(a["is_valid"], F.lit(True))).alias("is_valid"),
        F.when(F.col("failed"), 0.0).otherwise(F.least(F.greatest(F.coalesce(a["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0))).alias("confidence"),
        a["explanation"].alias("explanation"),
        F.when(F.col("failed"), F.col("response")).when((fix != "") & (F.lower(fix) != "null"), fix).alias("suggested_fix"),
    )


def risk(validated: DataFrame, by: list[str] = ()) -> DataFrame:
    """min(1, (0.3 valid errors + 0.1 valid warnings) * least confidence); blocked by any valid error."""
    good = F.col("is_valid")
    errors, warnings = F.count_if(good & F.col("severity").isin("error", "critical")), F.count_if(good & (F.col("severity") == "warning"))
    least = F.coalesce(F.min(F.when(good, F.col("confidence"))), F.lit(1.0))
    return validated.groupBy(*by).agg(F.least(F.lit(1.0), (0.3 * errors + 0.1 * warnings) * least).alias("risk"), (errors > 0).alias("blocked"))


def validate(findings: DataFrame, client: Callable[[str], str] | None, cache: DataFrame | None = None) -> DataFrame:
    """The whole check: findings of the model engine are left out, those the cache (key and answer) knows are not asked again, the rest are; answers are joined back.

    Result: the findings with is_valid, confidence, explanation, suggested_fix, key. Without client (disabled) nothing is asked and every finding not in
    the cache stands with confidence 0.5. risk() scores the result.
    """
    rows = cut(findings.where(F.lower("engine") != "ml").withColumn("key", cache_key()))
    parts = ["is_valid", "confidence", "explanation", "suggested_fix"]
    known = None if cache is None else rows.join(cache.dropDuplicates(["key"]).select("key", *parts), "key")
    fresh = rows if cache is None else rows.join(cache.select("key").distinct(), "key", "left_anti")
    if client is None:
        told = fresh.select("*", F.lit(True).alias("is_valid"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("suggested_fix"))
    else:
        told = fresh.join(cut(parse(ask(fresh, client))), "finding_id")  # written once: a call is not made again
    return told if known is None else told.unionByName(known.select(*told.columns))
