"""Functions found in source text and the repair rules on them (prices and effort of repairs are left out)."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codetext import duplication_ratio
from ..runtime import cut, spread

KEY = ["analysis_id", "path"]
#: What a scan of a file gives: item is function, class, loop, coupling, chain, allocation, blocking or error.
ITEM = "analysis_id string, path string, item string, name string, other string, line int, body_lines int, nesting int, cyclomatic int, branches int, io int, fan_in int, fan_out int, engines array<string>, definition string"
SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[c.split()[1]]) for c in ITEM.split(", ")])

#: Beginnings of function definitions: of all engines, and of the refactoring engine besides (fixed values).
FUNCTIONS = ("fn ", "def ", "function ", "pub fn ", "pub async fn ", "async fn ")
FUNCTIONS_REFACTORING = ("pub(crate) fn ", "pub(crate) async fn ", "pub unsafe fn ")
#: Beginnings that the testing and the coupling rules take for definitions (fixed values).
PLAIN_FUNCTIONS = ("fn ", "def ", "function ")
#: Beginnings of classes, words that are no name (fixed values).
CLASSES = ("class ", "struct ", "pub struct ", "pub class ", "pub(crate) struct ")
NO_NAMES = frozenset("fn def function pub async unsafe pub(crate) struct class".split())
#: Beginnings of lines that count for the cyclomatic complexity, of branches, of loops (fixed values).
CYCLOMATIC = ("if ", "else if ", "for ", "while ", "case ", "&&", "||", "catch ")
BRANCHES = ("if ", "else ", "match ", "switch ", "case ", "?")
LOOPS = ("for ", "while ", "loop ", "for(", "while(")
#: Parts of lines that read or write, that block, that allocate, that handle errors (fixed values).
IO = (
    ".read(", ".write(", ".query(", ".fetch(", ".execute(", "fs::read", "fs::write", "File::open", "fopen", "fread", "fwrite", "http::", "reqwest::", "curl", "axios.", "fetch(", "XMLHttpRequest",
    "database", "mongodb.", "postgres", "sqlite", "redis", "stdin", "stdout", "net::", "TcpStream", "UdpSocket",
)
SYNC = (".unwrap()", ".expect(", "std::sync::", "Mutex::lock", "thread::sleep", "std::thread::sleep", "sleep(", ".recv()", ".blocking_", "block_on", "wait()", "join()", "result()")
ALLOC = (
    "new ", "Box::new", "Rc::new", "Arc::new", "Vec::new", "String::new", "HashMap::new", "vec![", "format!(", "malloc", "calloc", "alloc",
    "new Array", "new Map", "new Object", "new Set", "new ", "clone()", "to_owned()", "to_string()",
)
ERRORS = ("Result<", "Option<", "unwrap(", "expect(", "?", "Err(", "Ok(", "try {", "catch ", "throws", "throw ", "if let Err", "match ", "Err(")
#: Engines and the findings of a file that each reports at most (fixed values).
LIMITS = {"refactoring": 3, "coupling": 5, "performance": 5, "testing_gap": 5, "debt_roi": 10}

_COMMENT = ("//", "#", "/*")


class _Depths:
    """Depths of braces at the end of each line, with the least of every 64 lines, so that a search skips blocks that stay deeper."""

    def __init__(self, depth: np.ndarray):
        self.depth = depth
        self.low = np.pad(depth, (0, -len(depth) % 64), constant_values=np.iinfo(np.int64).max).reshape(-1, 64).min(1)

    def end(self, i: int, target: int) -> int:
        """First line behind i that ends at most at the target depth, else the last line."""
        at = i + 1
        while at < len(self.depth):
            stop = (at // 64 + 1) * 64
            hit = np.flatnonzero(self.depth[at:stop] <= target)
            if len(hit):
                return at + int(hit[0])
            block = np.flatnonzero(self.low[stop // 64 :] <= target)
            if not len(block):
                break
            at = stop + int(block[0]) * 64
        return len(self.depth) - 1


def _matcher(names: set[str], tail: str = "") -> ahocorasick.Automaton | None:
    """Finds all names, each followed by tail, in one pass over a text."""
    out = ahocorasick.Automaton()
    for name in names:
        out.add_word(name + tail, name)
    if not names:
        return None
    out.make_automaton()
    return out


def _name(line: str) -> str:
    parts = [x for x in line.split("(")[0].split() if x not in NO_NAMES]
    return parts[-1].split("<")[0] if parts and parts[-1].split("<")[0] else "anonymous"


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def scan_file(text: str, path: str) -> list[dict]:
    """Functions, classes, nested loops, calls and marks of one file.

    A body ends with the brace that closes the first one of its definition, or, where the definition ends with a colon, while the
    indent is deeper. Loops nest by braces, in files of Python by indent. A function without body on its line has no body.
    """
    lines = text.split("\n")
    trimmed = [x.strip() for x in lines]
    n = len(lines)
    code = np.array([not x.startswith(_COMMENT) for x in trimmed])
    plain = np.array([not x.startswith(("//", "#")) for x in trimmed])
    opened = np.array([x.count("{") for x in lines], np.int64)
    closed = np.array([x.count("}") for x in lines], np.int64)
    depth = np.cumsum(opened - closed)
    ends = _Depths(depth)
    highest = np.zeros(n, np.int64)  # deepest inside each line
    for i in np.flatnonzero(opened):
        at = top = int(depth[i] - opened[i] + closed[i])
        for c in lines[i]:
            at += (c == "{") - (c == "}")
            top = max(top, at)
        highest[i] = top
    total = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    cyclomatic = total([sum(x.startswith(k) for k in CYCLOMATIC) for x in trimmed])
    branches = total([bool(p) and x.startswith(BRANCHES) for x, p in zip(trimmed, plain)])
    does_io = np.array([bool(p) and any(k in x for k in IO) for x, p in zip(trimmed, plain)])
    io = total(does_io)
    out: list[dict] = []
    functions: list[dict] = []
    free = 0  # the performance rules see no function inside another
    for i in np.flatnonzero(code).tolist():
        line = trimmed[i]
        exported = line[7:].removeprefix("default ") if line.startswith("export ") else line
        if exported.startswith(CLASSES):
            name = next((x for x in re.split(r"[{<(:]", exported)[0].split() if x not in NO_NAMES), "unknown")
            body = ends.end(i, int(depth[i] - opened[i])) - i if opened[i] else 0
            out.append({"item": "class", "name": name, "line": i + 1, "body_lines": body, "definition": line})
            continue
        common, more = exported.startswith(FUNCTIONS), exported.startswith(FUNCTIONS_REFACTORING)
        tested = exported.startswith(PLAIN_FUNCTIONS) or "fn " in line and "(" in line
        if not (common or more or tested):
            continue
        deepest = 0
        if line.endswith(":") and not opened[i]:
            end = i
            for j in range(i + 1, n):
                if trimmed[j]:
                    if _indent(lines[j]) <= _indent(lines[i]):
                        break
                    end = j
            inside = end + 1
        elif opened[i] and depth[i] > depth[i] - opened[i] + closed[i]:
            base = int(depth[i] - opened[i] + closed[i])
            end = ends.end(i, base)
            inside = end if depth[end] <= base else end + 1
            deepest = max(0, int(highest[i + 1 : end + 1].max(initial=0)) - int(depth[i]))
        else:
            end, inside = i, i + 1
        engines = [e for e, on in (("refactoring", common or more), ("coupling", common), ("performance", common and i >= free and (end > i or opened[i] > 0)), ("testing_gap", tested), ("debt_roi", common)) if on]
        if "performance" in engines:
            free = end + 1
        stop = max(i, i + (end - i))
        functions.append(
            {
                "item": "function", "name": _name(exported), "line": i + 1, "body_lines": end - i, "nesting": deepest, "cyclomatic": 1 + int(cyclomatic[inside] - cyclomatic[min(i + 1, inside)]),
                "branches": int(branches[stop] - branches[i]), "io": int(io[stop] - io[i]), "engines": engines, "definition": line,
            }
        )
    names = {f["name"] for f in functions}
    dotted = {name for _, name in m.iter(text)} if (m := _matcher(names, ".")) else set()
    coupled = [f for f in functions if "coupling" in f["engines"]]
    of_name: dict[str, int] = {}
    for f in coupled:
        of_name[f["name"]] = of_name.get(f["name"], 0) + 1
    with_dot = sum(k for name, k in of_name.items() if name in dotted)
    for f in coupled:
        own = of_name[f["name"]]
        f["fan_in"] = len(coupled) - own if f["name"] in dotted else 0
        f["fan_out"] = with_dot - (own if f["name"] in dotted else 0)
    # what a definition line calls, each pair once
    calls = _matcher(set(of_name), "(")
    seen: set[tuple[str, str]] = set()
    for f in coupled:
        for _, other in calls.iter(f["definition"]):
            if other != f["name"] and (f["name"], other) not in seen:
                seen.add((f["name"], other))
                out.append({"item": "chain", "name": f["name"], "other": other, "line": f["line"]})
    # lines of one function that name another
    refactored = [f for f in functions if "refactoring" in f["engines"]]
    mentions = _matcher({f["name"] for f in refactored})
    open_: deque[dict] = deque()  # the first that is not over is the one a line counts for
    k, before = 0, None
    for i, line in enumerate(trimmed):
        while k < len(refactored) and refactored[k]["line"] <= i + 1:
            open_.append(refactored[k])
            k += 1
        while open_ and i + 1 >= open_[0]["line"] + open_[0]["body_lines"]:
            open_.popleft()
        if not open_ or not code[i] or line.startswith(PLAIN_FUNCTIONS):
            continue
        caller = open_[0]["name"]
        for other in sorted({name for _, name in mentions.iter(line)} - {caller}):
            if (caller, other) != before:  # of pairs that follow each other the first
                out.append({"item": "coupling", "name": caller, "other": other, "line": i + 1})
            before = (caller, other)
    # loops
    nest, indents = 0, []
    python = path.endswith(".py")
    for i in np.flatnonzero(plain).tolist():
        line = trimmed[i]
        if python:
            while indents and line and _indent(lines[i]) <= indents[-1]:
                indents.pop()
            nest = len(indents)
        if line.startswith(LOOPS):
            nest += 1
            indents.append(_indent(lines[i]))
            if nest >= 2:
                out.append({"item": "loop", "line": i + 1, "nesting": nest})
        nest = max(0, nest - int(closed[i]))
    for i in np.flatnonzero(plain).tolist():
        many = sum(k in trimmed[i] for k in ALLOC)
        if many > 10:
            out.append({"item": "allocation", "line": i + 1, "branches": many})
    blocks = next((i + 1 for i, x in enumerate(trimmed) if any(k in x for k in SYNC)), None)
    if blocks and does_io.any():
        out.append({"item": "blocking", "line": blocks})
    for i, line in enumerate(trimmed):
        if line.startswith(PLAIN_FUNCTIONS) and any(k in line for k in ERRORS):
            name = _name(line)
            if not any(x in text for x in (f"{name}_error", f"{name}_fail", f"test_{name}")):
                out.append({"item": "error", "name": name, "line": i + 1})
    return out + functions


def items(files: DataFrame) -> DataFrame:
    """What the scans of source files (analysis_id, path, content) give; null keys and texts are left out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"analysis_id": a, "path": p, **x} for a, p, t in zip(*(c.to_pylist() for c in batch.columns)) for x in scan_file(t, p)]
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    rows = files.select(*KEY, "content").where("content IS NOT NULL AND analysis_id IS NOT NULL AND path IS NOT NULL")
    return spread(rows).mapInArrow(find, ITEM)


def functions(files: DataFrame) -> DataFrame:
    """Functions and classes of source files."""
    return items(files).where("item IN ('function', 'class')").select(*KEY, "name", "line", "body_lines", F.col("item").alias("kind"), "definition")


def spans(files: DataFrame) -> DataFrame:
    """Counts of each function: cyclomatic complexity, branches, lines that read or write, deepest nesting of braces."""
    return items(files).where("item = 'function'").select(*KEY, "name", "line", "body_lines", "cyclomatic", "branches", "io", "nesting")


def findings(files: DataFrame, top: int | None = None) -> DataFrame:
    """Findings of the repair rules: analysis_id, path, engine, rule, severity, line; per engine and file the first ``top`` (None: its reporting limit, 0: all).

    Every file is scanned once; the rules are conditions on what the scan gives.
    """
    every = cut(items(files))
    test = F.col("path").rlike("test|spec")
    out: list[DataFrame] = []

    def add(df: DataFrame, engine: str, rule: str, severity: Column | str, line: Column | None = None) -> None:
        level = F.lit(severity) if isinstance(severity, str) else severity
        out.append(df.select(*KEY, F.lit(engine).alias("engine"), F.lit(len(out)).alias("rule_no"), F.lit(rule).alias("rule"), level.alias("severity"), (line if line is not None else F.lit(1)).cast("int").alias("line")))

    def of(engine: str) -> DataFrame:
        return every.where((F.col("item") == "function") & F.array_contains("engines", engine))

    two = lambda c, high: F.when(c > high, "error").otherwise("warning")
    line = F.col("line")
    worst = of("refactoring").groupBy(*KEY).agg(F.max(F.struct("cyclomatic", -line)).alias("c"), F.max(F.struct("nesting", -line)).alias("n"))
    add(worst.where("c.cyclomatic > 15"), "refactoring", "REF-EXTRACT-METHOD", two(F.col("c.cyclomatic"), 30), -F.col("c.col2"))
    add(every.where("item = 'class' AND body_lines > 300"), "refactoring", "REF-EXTRACT-CLASS", two(F.col("body_lines"), 600), line)
    add(every.where("item = 'coupling'"), "refactoring", "REF-COUPLING", "warning", line)
    add(files.where("content IS NOT NULL").where(duplication_ratio(F.col("content")) > 0.2), "refactoring", "REF-DUPLICATION", "warning")
    add(worst.where("n.nesting > 5"), "refactoring", "REF-NESTING", "warning", -F.col("n.col2"))
    add(of("coupling").where("fan_in > 5 OR fan_out > 5"), "coupling", "COUP-HUB", "warning", line)
    chains = every.where("item = 'chain'").select(*KEY, F.col("name").alias("caller"), F.col("other").alias("callee"))
    add(chains.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), "coupling", "COUP-CHAIN", "warning")
    back = chains.select(*KEY, F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    add(chains.join(back, [*KEY, "caller", "callee"], "left_semi").select(*KEY).distinct(), "coupling", "COUP-CIRCULAR", "error")
    add(of("performance").where("body_lines > 50"), "performance", "PERF-LARGE-FUNC", "warning", line)
    add(of("performance").where("io > 2"), "performance", "PERF-IO-HEAVY", "warning", line)
    add(every.where("item = 'loop'"), "performance", "PERF-NESTED-LOOP", F.when(F.col("nesting") >= 3, "error").otherwise("warning"), line)
    add(every.where("item = 'blocking'"), "performance", "PERF-SYNC-IO", "warning", line)
    add(every.where("item = 'allocation'"), "performance", "PERF-ALLOC", "warning", line)
    add(of("testing_gap").where("branches = 0 AND body_lines > 3").where(~test), "testing_gap", "TEST-NO-BRANCH", "info", line)
    add(of("testing_gap").where("branches > 2").where(~test), "testing_gap", "TEST-GAP", "warning", line)
    add(every.where("item = 'error'").where(~test), "testing_gap", "TEST-ERROR-PATH", "info", line)
    add(of("debt_roi").where("cyclomatic > 15").where(~test), "debt_roi", "DEBT-COMPLEXITY", two(F.col("cyclomatic"), 25), line)
    add(of("debt_roi").where("body_lines > 80").where(~test), "debt_roi", "DEBT-LARGE-FUNC", two(F.col("body_lines"), 150), line)
    found = reduce(DataFrame.unionByName, out)
    if top == 0:
        return found.drop("rule_no")
    limit = F.lit(top) if top else reduce(lambda acc, kv: F.when(F.col("engine") == kv[0], kv[1]).otherwise(acc), LIMITS.items(), F.lit(5))
    place = F.row_number().over(Window.partitionBy(*KEY, "engine").orderBy("rule_no", "line"))
    return found.withColumn("place", place).where(F.col("place") <= limit).drop("rule_no", "place")


def recommendations(found: DataFrame) -> DataFrame:
    """What each engine recommends for an analysis: its rules by number of findings, the most frequent first."""
    per = found.groupBy("analysis_id", "engine", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("analysis_id", "engine").orderBy(F.desc("n"), "rule")))
