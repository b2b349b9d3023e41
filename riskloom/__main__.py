"""python -m riskloom analyze PATH... [--engines a,b] [--format pretty|json|sarif] [--output FILE] [--max-commits N]"""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from . import engines, sinks
from .operators.fusion import parse_engines
from .sources.snapshot import snapshot


def analyze(spark: SparkSession, paths: list[str], names: str | None, form: str, max_commits: int | None, folder: str) -> str:
    """The analysis of repositories as text; their tables stay below folder."""
    snapshot(spark, paths, folder, max_commits)
    results = engines.orchestrator().run(spark, folder, parse_engines(names))
    if form == "sarif":
        return sinks.sarif(engines.all_findings(spark, results))
    return engines.as_text(engines.summary(results, shown=form == "pretty"), form)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="riskloom")
    parser.add_argument("command", choices=["analyze"])
    parser.add_argument("path", nargs="+")
    parser.add_argument("--engines")
    parser.add_argument("--format", choices=["pretty", "json", "sarif"], default="pretty")
    parser.add_argument("--output")
    parser.add_argument("--max-commits", type=int, default=10_000)
    parser.add_argument("--tables", help="folder for the tables; needed on a cluster, where all executors must reach it")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    if not given.tables and not spark.sparkContext.master.startswith("local["):
        parser.error("--tables must name a shared folder on a cluster")
    text = analyze(spark, given.path, given.engines, given.format, given.max_commits, given.tables or tempfile.mkdtemp(prefix="riskloom-tables-"))
    if given.output:
        with open(given.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
