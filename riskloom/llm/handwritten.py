"""Generated, minified, vendored and data files among source files, by a random forest and by paths learned from what it finds."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from ..runtime import cut, join_measured

#: Labelled files of each class that the forest is fitted on, at most: those of smallest hash.
FIT_ROWS = 10_000
#: Share of a class's mean score among its labelled files from which on a file belongs to it.
SCORE_SHARE = 0.3
#: Evidence that makes a path token decide: files found by content / (files + 2) over the files whose content is known.
PATH_PRECISION = 0.75
#: Share of the mean rate of notices under the best token of each copy with a notice, from which on all files under a token are copies.
COPY_SHARE = 0.5
#: Rate of notices under a token from which on a file without one tells nothing about hand-written files.
SUSPECT_RATE = 0.25

_HEAD_LINES = 12
_COMMENT = re.compile(r"\s*(//|#(?!!)|/\*|\*|<!--|--|;)")
#: Wordings of notices in header comments (fixed values).
_GENERATED = re.compile(r"@generated|auto-?\s?generated|generated (by|from|file|code|automatically)|code generated|automatically (created|generated)|do not (edit|modify)|(automatisch|maschinell) erzeugt|nicht von hand|généré automatiquement|generado automáticamente|changes will be (lost|overwritten)", re.I)
_VENDORED = re.compile(r"\bvendored\b|\bbundled copy\b|\bupstream:|third[- ]party copy|local edits will be lost|\(c\).*\b(contributors|authors)\b.*licen[sc]e|\bv?\d+\.\d+[\w.]* - \(c\)", re.I)
_BUILD = re.compile(r"^/\*!")
_NOT_NOTICE = re.compile(r"SPDX|^\s*(//|#)\s*$")

#: Folder names that hold copies from third parties or the output of tools (fixed values).
TOOL_FOLDERS = frozenset("vendor _vendor vendored third_party thirdparty third-party node_modules bower_components jspm_packages external pods carthage generated __generated__ generated-sources generated-src dist".split())
#: File name patterns of tools by convention (fixed values).
TOOL_NAMES = re.compile(r"([.\-]min\.(js|css|mjs)$)|(\.bundle\.js$)|(\.pb\.(go|cc|h|rs)$)|(_pb2(_grpc)?\.pyi?$)|(\.(gen|generated|g)\.[a-z]+$)|(^zz_generated\.)|(\.[0-9a-f]{8,}\.(js|css)$)|(-\d+\.\d+\.\d+(\.min)?\.js$)")

_TOKENS = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_LITERAL = re.compile(r"\"[A-Za-z0-9+/=\\]{40,}\"|'[A-Za-z0-9+/=\\]{40,}'|(?:\s*[\[(]?\s*-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)\s*[\])]?\s*,){4,}")

FEATURES = ["ratio", "entropy", "distinct", "ident_mean", "ident_short", "comments", "line_mean", "line_max", "digits", "spaces", "symbols", "repeats", "size"]
_SCHEMA = StructType([*[StructField(c, DoubleType()) for c in FEATURES], StructField("notice", StringType()), StructField("literal", DoubleType())])


def describe(content: str | None) -> tuple:
    """Features of a file without the header lines that hold a notice, the kind of notice, and the share of data literals."""
    if content is None:
        return (None,) * len(FEATURES) + (None, None)
    lines = content.split("\n")
    notice, drop = None, set()
    if m := re.match(r"/\*!.*?\*/", content, re.S):
        notice, content = "build", content[m.end() :]
        lines = content.split("\n")
    head = []
    for i, line in enumerate(lines[:_HEAD_LINES]):
        if not line.strip():
            continue
        if not _COMMENT.match(line):
            break
        head.append((i, line))
    for i, line in head:
        found = "generated" if _GENERATED.search(line) else "vendored" if _VENDORED.search(line) else None
        if found:
            notice = notice or found
            drop.add(i)
        elif _NOT_NOTICE.search(line):
            drop.add(i)
    if notice == "generated":  # of a block of notices the lines around go too
        drop |= {i for i, line in head if re.search(r"tool:|auto-generated", line, re.I)}
    body = [line for i, line in enumerate(lines) if i not in drop]
    text = "\n".join(body)
    raw = text.encode("utf-8", "replace")
    tokens = _TOKENS.findall(text)
    counts = Counter(tokens)
    n = max(1, len(tokens))
    idents = [t for t in tokens if _IDENT.fullmatch(t)]
    filled = [x for x in body if x.strip()]
    size = max(1, len(text))
    shapes = Counter(re.sub(r"\d+", "0", re.sub(r"[A-Za-z_]+", "a", x)) for x in filled)
    return (
        len(zlib.compress(raw, 6)) / max(1, len(raw)),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        float(np.mean([len(i) for i in idents])) if idents else 0.0,
        sum(len(i) <= 2 for i in idents) / max(1, len(idents)),
        sum(bool(_COMMENT.match(x)) for x in filled) / max(1, len(filled)),
        size / max(1, len(filled)),
        float(max(map(len, body), default=0)),
        sum(c.isdigit() for c in text) / size,
        sum(c.isspace() for c in text) / size,
        sum(not (c.isalnum() or c.isspace()) for c in text) / size,
        max(shapes.values(), default=0) / max(1, len(filled)),
        math.log1p(size),
        notice,
        sum(len(m) for m in _LITERAL.findall(text)) / size,
    )


@pandas_udf(_SCHEMA)
def _describe(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe(c) for c in content], columns=_SCHEMA.names)


def path_tokens(path: str) -> list[str]:
    """What a path says of its file: its folders, its base name, the ends of its base name."""
    *folders, base = path.split("/")
    stem, *ends = base.split(".")
    out = {f"folder:{re.sub(r'[-.]?[0-9]+([.][0-9]+)*$', '', f.lower())}" for f in folders if f}
    out |= {f"name:{stem.lower()}", f"last:{re.split('[_-]', stem.lower())[-1]}.{ends[-1].lower() if ends else ''}", f"last:{re.split('[_-]', stem.lower())[-1]}"}
    if "_" in stem or "-" in stem:
        out.add(f"end:_{re.split('[_-]', stem.lower())[-1]}")
    if len(ends) > 1:
        out.add("dots:" + ".".join("0" if re.fullmatch(r"[0-9a-f]{6,}", e) else e.lower() for e in ends))
    out.add("digit:" + "/".join([*folders[-2:], re.sub(r"\d+", "0", ends[-1]) if ends else ""])) if re.search(r"\d$", stem) else None
    return sorted(out)


def tool_path(path: str) -> bool:
    """Whether a path follows a convention of tools or third-party copies."""
    *folders, base = path.split("/")
    return any(f.lower() in TOOL_FOLDERS for f in folders) or bool(TOOL_NAMES.search(base.lower()))


_PATH_SCHEMA = StructType([StructField("tool", BooleanType()), StructField("tokens", ArrayType(StringType()))])


@pandas_udf(_PATH_SCHEMA)
def _path(path: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(tool_path(p), path_tokens(p)) for p in path], columns=_PATH_SCHEMA.names)


#: Classes of the forest; the first is everything else.
CLASSES = ["other", "generated", "build", "literals"]


def _forest(described: DataFrame):
    """A random forest fitted on labelled files: a function that adds ``by_forest`` to described files, or None without labels.

    Classes are files with a notice of a generator, files with the banner of a minifier, files that are data
    literals for the most part (data bears no notices: its label is its share of literals), and all others. Files with a vendor's notice look
    hand-written, and files under path tokens where notices are frequent are of unknown class: both are left out. Among the others some are
    not hand-written though nothing says so. The probability of each class is therefore compared with its mean over the files that bear the
    label (times SCORE_SHARE), which corrects for files of the class without label. Of each class the FIT_ROWS files of smallest hash are used.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    none = F.col("notice").isNull()
    label = F.when(F.col("notice") == "generated", 1.0).when(F.col("notice") == "build", 2.0).when(none & (F.col("literal") > 0.6), 3.0).when(none & ~F.col("suspect"), 0.0)
    rows = described.where(F.col("ratio").isNotNull()).withColumn("label", label).where(F.col("label").isNotNull())
    order = F.xxhash64("analysis_id", "path")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features").transform
    parts = [rows.where(F.col("label") == float(k)).orderBy(order).limit(FIT_ROWS) for k in range(len(CLASSES))]
    fit = cut(reduce(DataFrame.unionByName, parts))
    sizes = {int(r[0]): r[1] for r in fit.groupBy("label").count().collect()}
    if sizes.get(0, 0) < 5 or sum(sizes.values()) - sizes[0] < 5:
        return None
    model = RandomForestClassifier(numTrees=24, maxDepth=7, minInstancesPerNode=2, seed=7).fit(assemble(fit).coalesce(4))

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(assemble(df)).withColumn("scores", vector_to_array("probability"))
        return scored.drop("features", "rawPrediction", "probability", "prediction")

    own = score(fit).where("label > 0").groupBy("label").agg(F.avg(F.element_at("scores", F.col("label").cast("int") + 1)).alias("mean"))
    least = {int(r[0]): r[1] * SCORE_SHARE for r in own.collect()}
    hit = reduce(lambda x, y: x | y, [F.element_at("scores", k + 1) > t for k, t in least.items()])
    return lambda df: score(df).withColumn("by_forest", hit).drop("scores")


def _rates(files: DataFrame, positive: Column, other: Column) -> DataFrame:
    """Per path token: files / (files that are not ``other`` + 2) that are positive."""
    per = files.select(F.explode("tokens").alias("token"), positive.cast("int").alias("k"), other.cast("int").alias("o")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.sum("o").alias("o"))
    return per.where("k > 0").select("token", (F.col("k") / (F.col("n") - F.col("o") + 2)).alias("rate"))


def _best(files: DataFrame, rates: DataFrame) -> DataFrame:
    """The token of highest rate of each file, as (token, rate, files): others under which it happens to lie get no credit for it."""
    each = join_measured(files.select("analysis_id", "path", F.explode("tokens").alias("token")), rates, ["token"])
    best = each.groupBy("analysis_id", "path").agg(F.max(F.struct("rate", "token")).alias("b"))
    return best.groupBy("b.token", "b.rate").agg(F.count(F.lit(1)).alias("files"))


def _learned_tokens(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Path tokens (token) under which files come from tools, and those under which they are copies, from read files (tokens, verdict, notice).

    Tools: nearly all files under the token were found by content. Copies look hand-written and only some bear a
    notice; if those are chosen by chance, the rate of notices under a token of nothing but copies is what it is on average under the best
    token of each copy with a notice, and COPY_SHARE of that is enough.
    """
    copy = F.coalesce(F.col("notice") == "vendored", F.lit(False))
    tool = (F.col("verdict") != "none") & ~copy
    tools, copies = cut(_rates(read, tool, copy)), cut(_rates(read, copy, tool))
    by_tool = _best(read.where(tool), tools).where(F.col("rate") >= PATH_PRECISION).select("token")
    best = cut(_best(read.where(copy), copies))
    mean = best.agg(F.sum(F.col("rate") * F.col("files")) / F.sum("files")).first()[0] or 0.0  # one number
    by_copy = best.where(F.col("rate") >= mean * COPY_SHARE).select("token")
    return cut(by_tool), cut(by_copy)


def not_handwritten(paths: DataFrame, sources: DataFrame, conventions: bool = True) -> DataFrame:
    """Which files no one wrote by hand, and by what evidence.

    paths (analysis_id, file_path) may repeat; sources (analysis_id, path, content) may lack files. A file is found by a
    notice in its header comments, by the forest's score of its content, or by its path: by a token (folder, base name, ending) that
    was learned, over the whole corpus, from the files of known content (see _learned_tokens), else by conventions of tools.
    A content that was read and cleared is overruled by tokens of copies, which look hand-written, and by conventions only;
    ``conventions=False`` leaves the latter out.

    Result: analysis_id, file_path, evidence (notice, forest, path or convention), one row per file found.
    Null path or analysis: left out. Null or missing content: by path only. Empty content: by path only.
    """
    files = paths.where(F.col("analysis_id").isNotNull() & F.col("file_path").isNotNull()).select("analysis_id", F.col("file_path").alias("path")).distinct()
    described = sources.where(F.col("path").isNotNull() & F.col("analysis_id").isNotNull()).select(
        "analysis_id", "path", _describe(F.when(F.trim("content") != "", F.col("content"))).alias("v")
    )
    described = cut(described.select("analysis_id", "path", "v.*").dropDuplicates(["analysis_id", "path"]).withColumn("tokens", _path("path")["tokens"]))
    read = described.where(F.col("ratio").isNotNull())
    often = _rates(read, F.col("notice").isNotNull(), F.lit(False)).where(F.col("rate") >= SUSPECT_RATE).select("token")
    suspect = join_measured(read.select("analysis_id", "path", F.explode("tokens").alias("token")), often, ["token"]).select("analysis_id", "path").distinct().withColumn("suspect", F.lit(True))
    described = cut(read.join(suspect, ["analysis_id", "path"], "left").na.fill(False, ["suspect"]))
    score = _forest(described) or (lambda df: df.withColumn("by_forest", F.lit(False)))
    verdict = F.when(F.col("notice").isNotNull(), "notice").when(F.col("by_forest"), "forest").otherwise("none")
    known = cut(score(described).select("analysis_id", "path", "tokens", "notice", verdict.alias("verdict")))
    by_tool, by_copy = _learned_tokens(known)
    everything = cut(files.join(known.select("analysis_id", "path", "verdict"), ["analysis_id", "path"], "left").withColumn("v", _path("path")).select("analysis_id", "path", "verdict", "v.*"))
    marks = by_tool.withColumn("copy", F.lit(False)).unionByName(by_copy.withColumn("copy", F.lit(True)))
    open_ = everything.where("verdict IS NULL OR verdict = 'none'").select("analysis_id", "path", F.col("verdict").isNull().alias("unread"), F.explode("tokens").alias("token"))
    told = join_measured(open_, marks, ["token"]).where("copy OR unread").select("analysis_id", "path").distinct().withColumn("told", F.lit(True))
    evidence = F.when(F.col("verdict") != "none", F.col("verdict")).when(F.col("told"), F.lit("path"))
    if conventions:
        evidence = evidence.when(F.col("tool"), F.lit("convention"))
    out = everything.join(told, ["analysis_id", "path"], "left").withColumn("evidence", evidence)
    return out.where(F.col("evidence").isNotNull()).select("analysis_id", F.col("path").alias("file_path"), "evidence")
