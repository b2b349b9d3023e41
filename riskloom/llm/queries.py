"""The problems on language-model data as queries, with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import normal_hash, spread, table
from .cooccurrence import together
from .encoding import encode_text
from .handwritten import not_handwritten
from .identities import identity_pairs, link_identities
from .leakage import leaked_spans, without_leaks
from .sentences import sentence_ends

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("RISKLOOM_TOKENIZERS", "/opt/tokenizers")


# 1: items that appear together


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "process_file_changes", "analysis_id", "commit_hash", "file_path").withColumn("commit_hash", normal_hash("commit_hash"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files changed together in at least 6 commits and 4 times as often as chance would have it."""
    return together(_changes(spark, d), "analysis_id", "commit_hash", "file_path", 6, 4).select("analysis_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def _scored_pairs(spark: SparkSession, d: str, min_together: int) -> DataFrame:
    out = together(_changes(spark, d), "analysis_id", "commit_hash", "file_path", min_together)
    return out.select("analysis_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), "n_baskets", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("jaccard", 6).alias("jaccard"))


def p1_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of files changed together, be it once, with counts and ratio to chance."""
    return _scored_pairs(spark, d, 1)


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p1_all_pairs with at least two common commits, as its SQL has them."""
    return _scored_pairs(spark, d, 2)


# 3: generated, minified and vendored files


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that no one on the project wrote by hand, with the evidence."""
    columns = ("analysis_id", "file_path")
    paths = table(spark, d, "dep_nodes", *columns).distinct().unionByName(table(spark, d, "process_file_changes", *columns).distinct())
    return not_handwritten(paths, spread(table(spark, d, "source_files", "analysis_id", "path", "content"), 4))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_files(spark, d).select("analysis_id", "file_path")


# 5: variant spellings of names


def p5_people(spark: SparkSession, d: str) -> DataFrame:
    """Identities and the person each belongs to."""
    return link_identities(table(spark, d, "process_commits", "author", "author_email"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return identity_pairs(p5_people(spark, d))


# 8: encoding


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k; null and empty texts have the empty list."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    return docs.select("doc_id", encode_text(spark, F.col("text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken").alias("ids"))


# 9: leakage


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", F.explode("items").alias("item_id")).distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of leaked words and the items found in them."""
    return _spans(spark, d)


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their leaked stretches."""
    return without_leaks(table(spark, d, "documents", "doc_id", "text"), _spans(spark, d)).select("doc_id", "clean_text", "n_removed", F.round("coverage", 6).alias("coverage"))


# 10: sentences


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the sentence units of every document."""
    return sentence_ends(spread(table(spark, d, "documents", "doc_id", "text", "lang")))


QUERIES = {f.__name__: f for f in (p1_found, p1_all_pairs, p1_pairs, p3_found, p3_files, p5_found, p5_people, p8_ids, p9_found, p9_spans, p9_clean, p10_found)}

_PAIRS = r"""
c AS (SELECT DISTINCT analysis_id, lower(regexp_replace(commit_hash, '^\s+|\s+$', '', 'g')) AS h, file_path FROM process_file_changes WHERE commit_hash IS NOT NULL),
t AS (SELECT analysis_id, count(DISTINCT h) AS n_baskets FROM c GROUP BY ALL),
s AS (SELECT analysis_id, file_path, count(*) AS n FROM c WHERE file_path IS NOT NULL GROUP BY ALL),
p AS (SELECT x.analysis_id, x.file_path AS file_a, y.file_path AS file_b, count(*) AS n_ab FROM c x JOIN c y
      ON x.analysis_id = y.analysis_id AND x.h = y.h AND x.file_path < y.file_path GROUP BY ALL),
pairs AS (SELECT p.*, n_baskets, a.n AS n_a, b.n AS n_b FROM p JOIN t USING (analysis_id)
          JOIN s a ON a.analysis_id = p.analysis_id AND a.file_path = file_a JOIN s b ON b.analysis_id = p.analysis_id AND b.file_path = file_b)
"""

SQL = {
    "p1_found": f"WITH {_PAIRS} SELECT analysis_id, file_a, file_b FROM pairs WHERE n_ab >= 6 AND n_ab * n_baskets >= 4 * n_a * n_b",
    "p1_all_pairs": f"""WITH {_PAIRS} SELECT analysis_id, file_a, file_b, n_baskets, n_a, n_b, n_ab, round(n_ab * n_baskets / (n_a * n_b), 6) AS lift,
        round(n_ab / (n_a + n_b - n_ab), 6) AS jaccard FROM pairs""",
    "p1_pairs": f"""WITH {_PAIRS} SELECT analysis_id, file_a, file_b, n_baskets, n_a, n_b, n_ab, round(n_ab * n_baskets / (n_a * n_b), 6) AS lift,
        round(n_ab / (n_a + n_b - n_ab), 6) AS jaccard FROM pairs WHERE n_ab >= 2""",
}
