"""Imports declared in source text, as rows of a module graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import IMPORT_LANGUAGES, language_of, module_name

#: Import patterns of one line, by language (fixed values).
PY_IMPORT = r"^\s*import\s+([A-Za-z0-9_., ]+)"
PY_FROM = r"^\s*from\s+(\.*[A-Za-z0-9_.]*)\s+import\s+\(?([A-Za-z0-9_, *]+)"
JS_PATTERNS = (
    (r"^\s*import\s+(?:[^'\"]*\s+from\s+)?['\"]([^'\"]+)['\"]", "static"),
    (r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "dynamic"),
    (r"=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "static"),
    (r"^\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "static"),
    (r"^\s*export\s+[^'\"]*\s+from\s+['\"]([^'\"]+)['\"]", "reexport"),
)
JAVA_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+(?:\.\*)?)\s*;"
GO_SINGLE = r"(?m)^\s*import\s+(?:[A-Za-z0-9_.]+\s+)?\"([^\"]+)\""
GO_BLOCK = r"(?s)\bimport\s*\(([^)]*)\)"

_IMPORT = "array<struct<target: string, kind: string>>"


def _python(line: Column) -> Column:
    """import a, b as c gives a and b; from x import a, b gives x, x.a and x.b, leading dots kept."""
    listed = F.regexp_extract(line, PY_IMPORT, 1)
    plain = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")), lambda x: x != "")
    base = F.regexp_extract(line, PY_FROM, 1)
    names = F.filter(F.transform(F.split(F.regexp_extract(line, PY_FROM, 2), ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")), lambda x: (x != "") & (x != "*"))
    joint = F.when(base.endswith("."), F.lit("")).otherwise(F.lit("."))
    below = F.transform(names, lambda n: F.concat(base, joint, n))
    targets = F.when(base != "", F.concat(F.array(base), below)).when(listed != "", plain).otherwise(F.array().cast("array<string>"))
    return F.transform(targets, lambda t: F.struct(t.alias("target"), F.lit("static").alias("kind")))


def _javascript(line: Column) -> Column:
    """The first pattern that fits a line."""
    hits = [F.when(F.regexp_extract(line, p, 1) != "", F.struct(F.regexp_extract(line, p, 1).alias("target"), F.lit(kind).alias("kind"))) for p, kind in JS_PATTERNS]
    return F.filter(F.array(F.coalesce(*hits)), lambda x: x.isNotNull())


def _whole(text: Column, language: Column) -> Column:
    """Imports of languages read as a whole, without lines."""
    java = F.regexp_extract_all(text, F.lit(JAVA_IMPORT), F.lit(1))
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(GO_BLOCK), F.lit(1)), "\n")
    go = F.concat(F.regexp_extract_all(text, F.lit(GO_SINGLE), F.lit(1)), F.regexp_extract_all(blocks, F.lit('"([^"]+)"'), F.lit(1)))
    return F.transform(F.when(language == "java", java).when(language == "go", go), lambda t: F.struct(t.alias("target"), F.lit("static").alias("kind")))


def imports(files: DataFrame) -> DataFrame:
    """Import statements of source files (analysis_id, path, content): analysis_id, source, target, line (0 where a language is read as a whole), kind.

    The language follows the path. Null texts and languages without rules give nothing; repeated statements stay.
    """
    rows = files.select("analysis_id", F.col("path").alias("source"), "content", language_of(F.col("path"), IMPORT_LANGUAGES, True).alias("language")).where("content IS NOT NULL AND language IS NOT NULL")
    by_line = rows.where(F.col("language").isin("python", "javascript")).select("analysis_id", "source", "language", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    found = F.when(F.col("language") == "python", _python(F.col("text"))).otherwise(_javascript(F.col("text")))
    lines = by_line.select("analysis_id", "source", (F.col("pos") + 1).cast("long").alias("line"), F.explode(found).alias("i"))
    whole = rows.where(F.col("language").isin("java", "go")).select("analysis_id", "source", F.lit(0).cast("long").alias("line"), F.explode(_whole(F.col("content"), F.col("language"))).alias("i"))
    return lines.unionByName(whole).select("analysis_id", "source", "line", F.col("i.target").alias("target"), F.col("i.kind").alias("kind"))


def absolute(source: Column, target: Column) -> Column:
    """Absolute module of a relative import: each dot beyond the first goes up one package from the source's."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    package = F.split(module_name(source), r"\.")
    base = F.slice(package, 1, F.greatest(F.size(package) - dots, F.lit(0)))
    rest = F.regexp_replace(target, r"^\.+", "")
    return F.when(dots == 0, target).otherwise(F.array_join(F.filter(F.concat(base, F.array(rest)), lambda x: x != ""), "."))


def module_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (analysis_id, id) and edges of the import graph: files by module name, then what they import, first mention kept."""
    edges = imports(files).select("analysis_id", module_name(F.col("source")).alias("source_id"), absolute(F.col("source"), F.col("target")).alias("target_id"), "line", "kind")
    own = files.select("analysis_id", module_name(F.col("path")).alias("id"), F.lit(True).alias("internal"))
    nodes = own.unionByName(edges.select("analysis_id", F.col("target_id").alias("id"), F.lit(False).alias("internal")))
    return nodes.groupBy("analysis_id", "id").agg(F.bool_or("internal").alias("internal")), edges
