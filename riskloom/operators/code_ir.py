"""Code trees as rows: one row per function, branch, loop, call, definition, allocation, with metrics and findings on them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codetext import _strip, health
from ..functions.text import IR_LANGUAGES, language_of
from ..runtime import cut, spread

NODE = "analysis_id string, path string, node int, parent int, kind string, name string, line int, depth int, nest int, loop_depth int, func string, has_else boolean, returns boolean, text string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]

#: Calls that open a resource and calls that give it back (fixed values).
OPENERS, CLOSERS = frozenset("open connect acquire socket lock".split()), frozenset("close release disconnect unlock".split())
#: Parts of names that hint at a resource (fixed values).
RESOURCE_NAMES = "file|socket|conn|handle|fd"

_BRANCH = re.compile(r"^(?:\}\s*)?(else\s+if|if|else|match|switch)\b(.*)")
_LOOP = re.compile(r"^(?:\}\s*)?(for|while|loop|do)\b(.*)")
_FN = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|function)\s+([A-Za-z_$][\w$]*)")
_LET = re.compile(r"^(?:let|var|const)\s+(?:mut\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(.*)")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_EMPTY = re.compile(r"\s*(?:\{\s*\}|;)")
#: Names that are no captured variables (fixed values).
NOT_CAPTURED = frozenset("self this _ args kwargs console process module exports".split())
#: Words of languages with braces that are no variables.
_WORDS = frozenset(
    "as async await break case catch class const continue default delete do dyn else enum export extends extern false finally fn for from function if impl import in instanceof let loop match mod move "
    "mut new null of pub ref return self Self static struct super switch this throw trait true try type typeof undefined unsafe use var void where while yield".split()
)
_NAME = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)(?!\s*(?:\(|::|!))(?![\w$])")
_CLOSURE = re.compile(r"\|([^|]*)\||(?:\(([^()]*)\)|([A-Za-z_$][\w$]*))\s*=>")
_RETURNED = re.compile(r"\(?\s*([A-Za-z_$][\w$]*(?:\s*,\s*[A-Za-z_$][\w$]*)*)\s*\)?")
_NOT_CALLS = frozenset("if for while match switch return fn function loop catch".split())


class _Rows:
    def __init__(self):
        self.rows: list[list] = []

    def add(self, parent: int, kind: str, name: str, line: int, depth: int, nest: int, loops: int, func: str, has_else=None, returns=None, text: str = "") -> int:
        self.rows.append([len(self.rows), parent, kind, name, line, depth, nest, loops, func, has_else, returns, text])
        return len(self.rows) - 1


def _captured(n: ast.Lambda | ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Variables that a closure or an inner function reads and neither takes nor sets, in order of name; what is only called is none."""
    known = {a.arg for a in ast.walk(n.args) if isinstance(a, ast.arg)}
    called, read = set(), set()
    for x in ast.walk(n):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
            called.add(id(x.func))
        elif isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
            known.add(x.id)
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)) and x is not n:
            known |= {a.arg for a in ast.walk(x.args) if isinstance(a, ast.arg)}
    read = {x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and id(x) not in called}
    return sorted(read - known - NOT_CAPTURED)


def python_nodes(source: str) -> list[list]:
    """Nodes of Python source by the standard parser; source that does not parse gives one node of kind error."""
    out = _Rows()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out.add(-1, "error", "", 0, 0, 0, 0, "")
        return out.rows
    todo = [(n, -1, 0, 0, 0, "") for n in reversed(tree.body)]
    while todo:  # an explicit stack: depth of the source is no limit
        n, parent, depth, nest, loops, func = todo.pop()
        line, me, inner = getattr(n, "lineno", 0), parent, (depth, nest, loops, func)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            me = out.add(parent, "function", n.name, line, depth, nest, loops, func)
            for name in _captured(n) if func else ():
                out.add(me, "capture", name, line, depth, nest, loops, func)
            inner = (depth + 1, 0, 0, n.name)
        elif isinstance(n, ast.Lambda):
            me = out.add(parent, "closure", "", line, depth, nest, loops, func)
            for name in _captured(n):
                out.add(me, "capture", name, line, depth, nest, loops, func)
        elif isinstance(n, (ast.If, ast.IfExp)):
            body = n.body if isinstance(n, ast.If) else []
            leaves = any(isinstance(x, (ast.Return, ast.Raise, ast.Continue, ast.Break)) for x in body)
            other = n.orelse if isinstance(n, ast.If) else []
            empty = "empty" if any(b and all(isinstance(x, ast.Pass) for x in b) for b in (body, other)) else ""
            me = out.add(parent, "conditional", empty, line, depth, nest, loops, func, bool(n.orelse), leaves, ast.unparse(n.test))
            inner = (depth + 1, nest + 1, loops, func)
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
            me = out.add(parent, "loop", "while" if isinstance(n, ast.While) else "for", line, depth, nest, loops + 1, func)
            inner = (depth + 1, nest + 1, loops + 1, func)
        elif isinstance(n, ast.Call):
            name = ast.unparse(n.func) if isinstance(n.func, (ast.Name, ast.Attribute)) else ""
            me = out.add(parent, "call", name, line, depth, nest, loops, func)
            last = name.rsplit(".", 1)[-1]
            if last in CLOSERS and "." in name:
                out.add(me, "release", name.rsplit(".", 1)[0], line, depth, nest, loops, func)
        elif isinstance(n, ast.Assign):
            names = [t.id for t in n.targets if isinstance(t, ast.Name)]
            opened = isinstance(n.value, ast.Call) and isinstance(n.value.func, (ast.Name, ast.Attribute)) and ast.unparse(n.value.func).rsplit(".", 1)[-1] in OPENERS
            for name in names:
                out.add(parent, "define", name, line, depth, nest, loops, func)
                if opened:
                    out.add(parent, "allocate", name, line, depth, nest, loops, func)
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            me = out.add(parent, "scope", "", line, depth, nest, loops, func)
        elif isinstance(n, (ast.Return, ast.Raise)):
            value = n.value if isinstance(n, ast.Return) else None
            out.add(parent, "return" if isinstance(n, ast.Return) else "throw", "", line, depth, nest, loops, func, text="" if value is None else ast.unparse(value))
            for x in value.elts if isinstance(value, (ast.Tuple, ast.List)) else [value]:
                if isinstance(x, ast.Name):
                    out.add(parent, "returned", x.id, line, depth, nest, loops, func)
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            out.add(parent, "use", n.id, line, depth, nest, loops, func)
        todo += [(c, me, *inner) for c in reversed(list(ast.iter_child_nodes(n)))]
    return out.rows


def _condition(text: str, at: int) -> tuple[str, bool]:
    """The whole condition that begins at ``at``, over as many lines as it has, and whether the branch behind it is empty.

    One in parentheses, with nothing but a block or statement behind them, ends with them; any other before its block.
    """
    i, depth, began = at, 0, text[at : at + 80].lstrip().startswith("(")
    while i < len(text):
        c = text[i]
        if c in "\"'`" and (m := _STRING.match(text, i)):
            i = m.end()
            continue
        if depth <= 0 and c in "{};":
            break
        depth += (c in "([{") - (c in ")]}")
        i += 1
        if began and c == ")" and depth == 0 and not re.match(r"\s*(?:&&|\|\||[=!<>]=|[.<>+*/%?-])", text[i : i + 80]):
            break
    return " ".join(text[at:i].split()), bool(_EMPTY.match(text, i))


def brace_nodes(source: str) -> list[list]:
    """Nodes of languages with braces, line by line over text without comments and strings."""
    out, stack = _Rows(), []  # stack of (node, kind, brace level at which it closes)
    scopes: dict[int, tuple[set, set]] = {}  # closures and inner functions: what they take or set, what they read
    branch: dict[int, list] = {}  # the last conditional at each depth
    level, func = 0, ""
    whole, start = _strip(source, False), 0  # start: of the next line
    for no, raw in enumerate(whole.split("\n"), 1):
        here, start = start + len(raw) - len(raw.lstrip()), start + len(raw) + 1
        line = raw.strip()
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "", line)
        while stack and level - (1 if bare.startswith("}") else 0) < stack[-1][2]:
            stack.pop()
        parent = stack[-1][0] if stack else -1
        nest = sum(k in ("conditional", "loop") for _, k, _ in stack)
        loops = sum(k == "loop" for _, k, _ in stack)
        func = next((out.rows[i][3] for i, k, _ in reversed(stack) if k == "function"), "")
        at = (no, len(stack), nest, loops, func)
        opened, closed = bare.count("{"), bare.count("}")
        node, kind = -1, ""
        if m := _FN.match(bare):
            node, kind = out.add(parent, "function", m[1], *at), "function"
            if any(k in ("function", "closure") for _, k, _ in stack):
                scopes[node] = ({*_NAME.findall(bare)}, set())
        elif m := _BRANCH.match(bare):
            behind = here + (_BRANCH.match(line) or m).start(2)
            word = " ".join(m[1].split())
            if word in ("else", "else if") and out.rows:
                last = branch.get(len(stack))
                if last:
                    last[9] = True
                    if word == "else" and _EMPTY.match(whole, behind):
                        last[3] = "empty"
            if word != "else":
                kind = "conditional"
                test, empty = _condition(whole, behind)
                many = word in ("match", "switch")
                node = out.add(parent, kind, "match" if many else "empty" if empty else "", *at, many, bool(re.search(r"\b(return|throw|break|continue|panic!)", bare)), test)
                branch[len(stack)] = out.rows[node]
            else:
                kind = "else"
                node = parent
        elif m := _LOOP.match(bare):
            kind = "loop"
            node = out.add(parent, kind, m[1], no, len(stack), nest, loops + 1, func)
        elif m := _LET.match(bare):
            out.add(parent, "define", m[1], *at)
            call = _CALL.search(m[2])
            if call and re.split(r"\.|::", call[1])[-1] in OPENERS:
                out.add(parent, "allocate", m[1], *at)
        names = [x for x in _NAME.findall(bare) if x not in _WORDS and kind != "function"]
        defined = m[1] if kind == "" and (m := _LET.match(bare)) else None
        if (c := _CLOSURE.search(bare)) and kind != "conditional":
            closure = out.add(parent, "closure", "", *at)
            takes = {x for g in c.groups() if g for x in _NAME.findall(g)}
            scopes[closure] = (takes, set())
            if opened > closed and node < 0:
                node, kind = closure, "closure"
            else:
                scopes[closure][1].update(x for x in _NAME.findall(bare[c.end() :]) if x not in _WORDS)
        for name in dict.fromkeys(names):
            if name != defined or names.count(name) > 1:
                out.add(parent, "use", name, *at)
        for i, k, _ in stack:
            if i in scopes and k in ("closure", "function"):
                scopes[i][0].update([defined] if defined else ())
                scopes[i][1].update(names)
        if re.match(r"return\b", bare):
            value = bare[6:].strip(" ;")
            out.add(parent, "return", "", *at, text=value)
            if m := _RETURNED.fullmatch(value):
                for name in re.split(r"\s*,\s*", m[1]):
                    out.add(parent, "returned", name, *at)
            for i, k, _ in reversed(stack):
                if k == "conditional":
                    out.rows[i][10] = True
                    break
        elif re.match(r"throw\b|panic!", bare):
            out.add(parent, "throw", "", *at)
        if kind != "function":
            for c in _CALL.finditer(bare):
                if c[1] not in _NOT_CALLS:
                    me = out.add(parent, "call", c[1], *at)
                    parts = re.split(r"\.|::", c[1])
                    if parts[-1] in CLOSERS and len(parts) > 1:
                        out.add(me, "release", parts[0], *at)
        level += opened - closed
        if node >= 0 and opened > closed or kind == "else" and opened:
            stack.append((node, kind, level))
        level = max(level, 0)
    for node, (known, read) in scopes.items():
        _, _, _, _, line, depth, nest, loops, func, *_ = out.rows[node]
        for name in sorted(read - known - NOT_CAPTURED):
            out.add(node, "capture", name, line, depth, nest, loops, func)
    return out.rows


def nodes(files: DataFrame) -> DataFrame:
    """Tree rows of source files (analysis_id, path, content) of the languages with a parser; whole texts, Arrow batches.

    Text with NUL in its first 8,192 characters is binary and left out, as are null texts.
    """
    language = language_of(F.col("path"), IR_LANGUAGES, False)
    rows = files.select("analysis_id", "path", "content", language.alias("language")).where("content IS NOT NULL AND language IS NOT NULL AND position('\\0' IN substring(content, 1, 8192)) = 0")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, p, text, lang in zip(batch["analysis_id"], batch["path"], batch["content"], batch["language"]):
                found = python_nodes(text) if lang == "python" else brace_nodes(text)
                out += [[a, p, *r] for r in found]
            yield pd.DataFrame(out, columns=COLUMNS)

    return spread(rows).mapInPandas(parse, NODE)


KEY = ["analysis_id", "path"]


def metrics(tree: DataFrame) -> DataFrame:
    """Per file: cyclomatic = 1 + conditionals + loops, nesting, cognitive, loop nesting, functions, allocations, closures."""
    kind = F.col("kind")
    cognitive = F.when(kind == "conditional", 1 + F.col("nest")).when(kind == "loop", 2 + F.col("nest")).otherwise(0)
    return tree.groupBy(*KEY).agg(
        (1 + F.count_if(kind.isin("conditional", "loop"))).alias("cyclomatic"), F.coalesce(F.max(F.when(kind.isin("conditional", "loop"), F.col("nest") + 1)), F.lit(0)).alias("nesting"), F.sum(cognitive).alias("cognitive"),
        F.max("loop_depth").alias("loop_nesting"), F.count_if(kind == "function").alias("functions"), F.count_if(kind == "allocate").alias("allocations"), F.count_if(kind == "closure").alias("closures"), F.count_if(kind == "loop").alias("loops"),
    )


def recursive(tree: DataFrame) -> DataFrame:
    """Functions whose body calls their own name."""
    return tree.where((F.col("kind") == "call") & (F.col("name") == F.col("func")) & (F.col("func") != "")).select(*KEY, F.col("func").alias("name")).distinct()


def leaks(tree: DataFrame) -> DataFrame:
    """Allocations whose variable is never released in its function; of several of one variable the last."""
    alloc = tree.where("kind = 'allocate'").groupBy(*KEY, "func", "name").agg(F.max("line").alias("line"))
    return alloc.join(tree.where("kind = 'release'").select(*KEY, "func", "name").distinct(), [*KEY, "func", "name"], "left_anti")


def live_definitions(tree: DataFrame) -> DataFrame:
    """Definitions that are used in the same function."""
    defs = tree.where("kind = 'define'").select(*KEY, "func", "name").distinct()
    return defs.join(tree.where("kind = 'use'").select(*KEY, "func", "name"), [*KEY, "func", "name"], "left_semi")


def escapes(tree: DataFrame) -> DataFrame:
    """Resources whose variable is returned, alone or among others."""
    returned = tree.where("kind = 'returned'").select(*KEY, "func", "name")
    return tree.where(F.col("kind").isin("define", "allocate") & F.lower("name").rlike(RESOURCE_NAMES)).join(returned, [*KEY, "func", "name"], "left_semi").select(*KEY, "name", "line").distinct()


def findings(tree: DataFrame) -> DataFrame:
    """Findings of rules MGTG on trees: analysis_id, path, rule, severity, line. The tree is written once: each rule reads it, none parses again."""
    return _found(cut(tree))


def _found(tree: DataFrame) -> DataFrame:
    per = metrics(tree)
    out = []

    def add(df: DataFrame, rule: str, severity: str, line) -> None:
        out.append(df.select(*KEY, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.cast("int").alias("line")))

    one = F.lit(1)
    add(per.where("cyclomatic > 10"), "MGTG-C000", "warning", one)
    add(per.where("nesting > 4"), "MGTG-C001", "info", one)
    add(per.where("cognitive > 20"), "MGTG-C002", "info", one)
    branches = tree.where("kind = 'conditional'")
    add(branches.where("NOT has_else AND name <> 'match' AND NOT returns"), "MGTG-G000", "warning", F.col("line"))
    add(branches.where("(NOT has_else OR name = 'empty') AND lower(text) RLIKE 'null|undefined|none'"), "MGTG-G001", "warning", F.col("line"))
    add(branches.where("nest >= 3"), "MGTG-G002", "info", F.col("line"))
    add(per.where("loop_nesting > 2"), "MGTG-P000", "info", one)
    add(recursive(tree), "MGTG-P001", "info", one)
    add(leaks(tree), "MGTG-M000", "error", F.col("line"))
    add(escapes(tree), "MGTG-M100", "warning", F.col("line"))
    add(tree.where("kind = 'capture'"), "MGTG-M200", "info", F.col("line"))
    total = out[0]
    for df in out[1:]:
        total = total.unionByName(df)
    return total


def file_health(tree: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Health of each file by its findings (those of the tree if not given) and metrics."""
    tree = cut(tree) if found is None else tree
    n = (_found(tree) if found is None else found).groupBy(*KEY).agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"), F.count_if(F.col("rule") == "MGTG-M000").alias("risks")
    )
    out = metrics(tree).join(n, KEY, "left").na.fill(0)
    return out.withColumn("health", health(*[F.col(c) for c in ("errors", "warnings", "infos", "cyclomatic", "nesting", "risks")]))
