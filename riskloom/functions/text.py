"""Column functions on paths, messages and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a message that mark a bug fix (fixed values).
BUG_WORDS = ("fix", "bug", "crash", "defect", "error", "hotfix", "patch", "issue", "#")

#: Severities by rank (fixed values).
SEVERITIES = ("info", "warning", "error", "critical")

#: File endings by language of the complexity analysis and of the import analysis (fixed values).
IR_LANGUAGES = {"python": ("py",), "javascript": ("js", "jsx", "mjs", "cjs", "ts", "tsx"), "rust": ("rs",)}
IMPORT_LANGUAGES = {"python": ("py",), "javascript": ("js", "jsx", "mjs", "cjs", "ts", "tsx"), "java": ("java",), "go": ("go",)}

#: Names of runtimes (fixed values).
RUNTIME_ALIASES = {
    "jvm": ("jvm", "java", "kotlin"), "node": ("node", "nodejs", "javascript", "typescript", "js", "ts"), "python": ("python", "py"), "rust": ("rust", "rs"), "go": ("go", "golang"),
}


def is_bug_fix(message: Column) -> Column:
    """Whether a message contains any of the bug words, as part of a longer word too; false for null."""
    return F.coalesce(F.lower(message).rlike("|".join(BUG_WORDS)), F.lit(False))


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike("test|spec"), F.lit(False))


def language_of(path: Column, languages: dict[str, tuple[str, ...]], lower: bool) -> Column:
    """Language by file ending, null if none fits."""
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    ending = F.lower(ending) if lower else ending
    out = F.lit(None).cast("string")
    for name, ends in languages.items():
        out = F.when(ending.isin(*ends), name).otherwise(out)
    return out


def runtime_of(name: Column) -> Column:
    """Runtime by one of its names, null if unknown."""
    out = F.lit(None).cast("string")
    for runtime, names in RUNTIME_ALIASES.items():
        out = F.when(F.lower(name).isin(*names), runtime).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """0 to 3; unknown counts as info."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity))
    return F.greatest(F.coalesce(place, F.lit(1)) - 1, F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int") + 1)


def risk_label(risk: Column) -> Column:
    return F.when(risk < 0.3, "LOW").when(risk < 0.6, "MODERATE").when(risk < 0.8, "HIGH").otherwise("CRITICAL")


def ci_status(risk: Column, blocked: Column) -> Column:
    return F.when(blocked | (risk >= 0.8), "FAIL").when(risk >= 0.5, "WARN").otherwise("PASS")


def parent(path: Column) -> Column:
    """Folder of a path, empty for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """Path without '.' parts and with '..' parts resolved; '..' at the root vanishes."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def module_name(path: Column) -> Column:
    """Dotted module name of a path: ending dropped, parts '.', '..', src and lib left out, __init__ named after its folder."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: ~p.isin("", ".", "..", "src", "lib"))
    return F.array_join(F.filter(parts, lambda p: p != "__init__"), ".")
