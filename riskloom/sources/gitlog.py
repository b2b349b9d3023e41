"""Python data source over git repositories: one row per changed file of each commit, newest commit first."""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "analysis_id string, hash string, author string, author_email string, timestamp_ms long, message string, is_merge boolean, file_path string, lines_added long, lines_deleted long, change_type string"
_FORMAT = "%x00%H%x00%P%x00%an%x00%ae%x00%at%x00%ad%x00%B%x00"
_KINDS = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Renamed", "T": "Modified"}
_STAT = re.compile(r"(\d+|-)\t(\d+|-)\t")
_BLOCK = 1 << 16


def _fields(path: str, *args: str) -> Iterator[str]:
    """NUL-separated fields of what git prints, read in blocks: no more than a block and a field are held."""
    with tempfile.TemporaryFile() as errors, subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, *args], stdout=subprocess.PIPE, stderr=errors) as run:
        try:
            rest = b""
            while block := run.stdout.read(_BLOCK):
                *whole, rest = (rest + block).split(b"\0")
                for field in whole:
                    yield field.decode("utf-8", "replace")
            yield rest.decode("utf-8", "replace")
            if run.wait():
                errors.seek(0)
                raise ValueError(f"{path} can't be read as a git repository: {errors.read(400).decode(errors='replace').strip()}")
        finally:  # a reader that stops early ends git too
            run.kill()


def _offset_minutes(date: str) -> int:
    sign, hours, minutes = date[-5], int(date[-4:-2]), int(date[-2:])
    return (-1 if sign == "-" else 1) * (hours * 60 + minutes)


def _rows(head: list[str], kinds: dict[str, str], stats: list[tuple[str, str, str]]) -> Iterator[tuple]:
    commit, parents, author, email, seconds, date, message = head
    row = (commit, author, email, int(seconds) * 1000 + _offset_minutes(date) * 60_000, message.strip(), len(parents.split()) > 1)
    any_file = False
    for added, deleted, name in stats:
        if name in kinds:
            any_file = True
            yield (*row, name, *(0 if x == "-" else int(x) for x in (added, deleted)), kinds[name])
    if not any_file:
        yield (*row, None, None, None, None)


def walk(path: str, max_commits: int | None = 10_000, renames: bool = False) -> Iterator[tuple]:
    """All commits HEAD descends from, by time and topology, those of merged branches among them, each with its differences to its first parent.

    A commit without changes gives one row without a file. timestamp_ms is seconds * 1000 plus the zone's offset.
    A renamed file is one deleted and one added; with ``renames`` it is one renamed, as are copies. Submodules are left out.
    """
    limit = [f"--max-count={max_commits}"] if max_commits else []
    fields = _fields(path, "log", "--date-order", "--diff-merges=first-parent", "--raw", "--numstat", "-z", "--no-abbrev", "-M" if renames else "--no-renames", "--date=raw", f"--format={_FORMAT}", *limit, "HEAD")
    head: list[str] | None = None
    kinds: dict[str, str] = {}
    stats: list[tuple[str, str, str]] = []
    for field in fields:
        f = field.lstrip("\n")
        if not f:
            continue
        if f.startswith(":"):
            meta = f.split()
            name = next(fields)
            if meta[4][0] in "RC":
                name = next(fields)
            if "160000" not in (meta[0][1:], meta[1]):
                kinds[name] = _KINDS.get(meta[4][0], "Modified")
        elif m := _STAT.match(f):
            name = f[m.end() :]
            if not name:
                next(fields)
                name = next(fields)
            stats.append((m[1], m[2], name))
        else:
            if head:
                yield from _rows(head, kinds, stats)
            head, kinds, stats = [f, *(next(fields) for _ in range(6))], {}, []
    if head:
        yield from _rows(head, kinds, stats)


class _Repository(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.most = int(options.get("max_commits", "10000")) or None
        self.renames = options.get("renames", "false").lower() == "true"

    def partitions(self):
        return [_Repository(p) for p in self.paths]

    def read(self, partition):
        for row in walk(partition.path, self.most, self.renames):
            yield (partition.path.rstrip("/").rsplit("/", 1)[-1], *row)


class GitLog(DataSource):
    """spark.read.format("gitlog").option("max_commits", 0 for all).option("renames", True).load("repo1,repo2"): a task for each repository."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
