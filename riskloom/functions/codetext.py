"""Heuristic metrics of source text as column expressions, with an Arrow UDF for what needs a character automaton."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Patterns whose matches are added up (fixed values).
LOOPS = (r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bfor\s+(?:let\s+)?[a-zA-Z_]\w*\s+of\s+", r"\bfor\s+[^\n]*\s+in\s+", r"\brange\s+", r"\bloop\s*\{")
BRANCHES = (r"\bif\b", r"\belse\s+if\b", r"\belse\b", r"\bmatch\b", r"\bswitch\b", r"\bcase\b", r"\bcond\b", r"\?\s*[a-zA-Z_]+\s*:", r"\|\|", r"&&")
FUNCTIONS = (
    r"\bfn\s+[a-zA-Z_]\w*\s*\(", r"\bdef\s+[a-zA-Z_]\w*\s*\(", r"\bfunction\s+[a-zA-Z_]\w*\s*\(", r"\bpublic\s+\w+\s+\w+\s*\(", r"\bprivate\s+\w+\s+\w+\s*\(",
    r"\bprotected\s+\w+\s+\w+\s*\(", r"\bfun\s+[a-zA-Z_]\w*\s*\(", r"\bfunc\s+[a-zA-Z_]\w*\s*\(", r"\basync\s+fn\s+[a-zA-Z_]\w*\s*\(", r"\bdef\s+[a-zA-Z_]\w*\s*\(self",
)
ALLOCATIONS = (r"\bnew\s+[A-Z]", r"\bvec!", r"\bVec::new\b", r"\bHashMap::new\b", r"\bBox::new\b", r"\bString::new\b", r"\bArray\s*\(", r"\bObject\s*\(")
#: Route patterns by language; where one is contained in another, both count (fixed values).
ROUTES = {
    "jvm": (r"@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)\s*\(\s*[\"']([^\"']+)", r"@Path\s*\(\s*[\"']([^\"']+)"),
    "python": (r"@(?:app|router)\.(?:get|post|put|delete|route)\s*\(\s*[\"']([^\"']+)",) * 2,
    "node": (r"\.(?:get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)", r"router\.(?:get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)"),
    "rust": (r"\.route\s*\(\s*[\"']([^\"']+)", r"#\[(?:get|post|put|delete)\s*\(\s*[\"']([^\"']+)"),
    "go": (r"\.(?:GET|POST|PUT|DELETE|HandleFunc)\s*\(\s*[\"']([^\"']+)",),
}
#: Risk of each complexity class (fixed values).
CLASS_RISK = {"O(1)": 0.0, "O(log n)": 0.1, "O(n)": 0.3, "O(n log n)": 0.4, "O(n²)": 0.7, "O(n³)": 0.85, "O(2ⁿ)": 1.0}


def count_all(text: Column, patterns: tuple[str, ...]) -> Column:
    """Matches of all patterns added up; overlapping patterns count each."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(p))
    return out.cast("long")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


#: A block comment; a line comment inside it hides its end.
_BLOCK = r"/\*(?://[^\n]*|/\*|(?!\*/).)*+(?:\*/)?"
#: Comments alone or beside strings, which end at their own mark; and with strings that end at either mark.
_COMMENTS = re.compile(r"""(?P<keep>"(?:\\.|[^"\\])*+"?|'(?:\\.|[^'\\])*+'?)|//[^\n]*|""" + _BLOCK, re.S)
_COMMENTS_STRINGS = re.compile(r"""(?P<string>["'](?:\\.|[^"'\\])*+["']?)|//[^\n]*|""" + _BLOCK, re.S)


def _blank(m: re.Match) -> str:
    text = m.group()
    if m.lastgroup == "keep":
        return text
    if m.lastgroup == "string":
        return " " * len(text)
    return "" if text.startswith("//") else re.sub(r"[^\n]", " ", text)


def _strip(source: str, strings: bool) -> str:
    """Source without comments, and without strings if wanted, in one pass over the places where either begins."""
    return (_COMMENTS_STRINGS if strings else _COMMENTS).sub(_blank, source)


@pandas_udf(StringType())
def without_comments_and_strings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _strip(t, True))


@pandas_udf(StringType())
def without_comments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _strip(t, False))


def count_allocations(text: Column) -> Column:
    """Allocations outside comments and strings, at most 1000 counted."""
    return F.least(count_all(without_comments_and_strings(text), ALLOCATIONS), F.lit(1000).cast("long"))


#: Beginnings of comment lines, and words of a branch whose body may stand without braces (fixed values).
COMMENT_LINE = r"^(//|#|/\*|\*)"
BARE_BRANCH = "if |for |while |catch |except"


def brace_nesting(text: Column) -> Column:
    """Deepest nesting of braces by lines; closing more than is open stops at zero."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COMMENT_LINE))

    def step(acc, x):
        opened = F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))
        closed = F.length(x) - F.length(F.replace(x, F.lit("}"), F.lit("")))
        depth = F.greatest(acc["depth"] + opened - closed, F.lit(0))
        bare = x.rlike(BARE_BRANCH) & ~x.contains("{") & ~x.endswith(":")
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], F.when(opened > closed, depth).otherwise(0), F.when(bare, 1).otherwise(0)).alias("most"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step)["most"].cast("long")


def indent_nesting(text: Column) -> Column:
    """Nesting of indented languages: a half of the deepest indent in fours, at least 1."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike("^(#|$)"))
    deepest = F.array_max(F.transform(lines, lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4)))
    return F.greatest(F.floor(F.coalesce(deepest, F.lit(0)) / 2), F.lit(1)).cast("long")


def complexity_class(loops: Column, nesting: Column) -> Column:
    """Class by number of loops and nesting."""
    return (
        F.when(loops == 0, "O(1)")
        .when(loops == 1, F.when(nesting >= 4, "O(n³)").when(nesting >= 3, "O(n²)").otherwise("O(n)"))
        .when(loops == 2, F.when(nesting >= 3, "O(n³)").otherwise("O(n²)"))
        .when(loops <= 5, "O(n²)")
        .when(loops <= 10, "O(n³)")
        .otherwise(F.when(nesting >= 5, "O(2ⁿ)").otherwise("O(n³)"))
    )


def class_risk(label: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, risk in CLASS_RISK.items():
        out = F.when(label == name, risk).otherwise(out)
    return out


def endpoints(text: Column, runtime: Column) -> Column:
    """Routes declared in a source, one element for each pattern and match."""
    bare = without_comments(text)
    out = F.array().cast("array<string>")
    for name, patterns in ROUTES.items():
        found = F.concat(*[F.regexp_extract_all(bare, F.lit(p), F.lit(1)) for p in patterns])
        out = F.when(runtime == name, found).otherwise(out)
    return out


def duplication_ratio(text: Column) -> Column:
    """Share of lines (trimmed, not empty) of five characters or more that occur again later; 0 for fewer than four lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\r\t", "  "))), lambda x: x != "")
    long_ = F.filter(lines, lambda x: F.length(x) >= 5)
    n = F.size(lines)
    return F.when(n < 4, 0.0).otherwise((F.size(long_) - F.size(F.array_distinct(long_))) / n)


def health(errors: Column, warnings: Column, infos: Column, cyclomatic: Column, nesting: Column, resource_risks: Column) -> Column:
    zero = F.lit(0)
    score = 1.0 - 0.15 * errors - 0.05 * warnings - 0.01 * infos - 0.02 * F.greatest(cyclomatic - 10, zero) - 0.03 * F.greatest(nesting - 4, zero) - 0.1 * resource_risks
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def json_raw_bytes(text: Column) -> Column:
    """Bytes of the keys and values of a JSON text, without marks; true, false and null count four, and no text less than 64."""
    trimmed = F.trim(text, F.lit(" \t\n\r\f\v"))
    parts = F.regexp_extract_all(trimmed, F.lit(r'(?s):[ \t\n\r\f]*(?:"[^"]*"?|[tfn][^,}\]]*|[A-Za-z0-9.\-]*)|"[^"]*"?'), F.lit(0))

    def size(part: Column) -> Column:
        value = F.regexp_replace(part, r"^:[ \t\n\r\f]*", "")
        plain = F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
        return F.when(part.startswith(":") & value.rlike("^[tfn]"), 4).otherwise(plain)

    return F.greatest(F.aggregate(F.transform(parts, size), F.lit(0), lambda a, b: a + b), F.lit(64)).cast("double")


def json_temp_bytes(text: Column) -> Column:
    """64 bytes for each object and array inside another."""

    def step(acc: Column, c: Column) -> Column:
        opens = c.isin("{", "[")
        return F.struct(F.greatest(acc["depth"] + F.when(opens, 1).otherwise(-1), F.lit(0)).alias("depth"), (acc["n"] + F.when(opens & (acc["depth"] > 0), 1).otherwise(0)).alias("n"))

    marks = F.regexp_extract_all(text, F.lit(r"[{}\[\]]"), F.lit(0))
    return (F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step)["n"] * 64).cast("double")
