"""Source files, configuration, models, feedback and layer rules from storage."""

from __future__ import annotations

import json
import os
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never searched (fixed values).
PRUNED = ("node_modules", "vendor", "target", "dist", "build", ".git", "venv", "__pycache__")

FEEDBACK = "id string, finding_id string, engine string, file_path string, line long, verdict string, actual_severity string, notes string, timestamp long, reviewer string"


def _below(path: Column, root: str) -> Column:
    """Path below the root, so that hidden folders above it don't count."""
    plain = F.regexp_replace(path, r"^[a-z]+:/*", "/")
    return F.regexp_replace(plain, "^" + re.escape(root.rstrip("/")) + "/", "")


def code_files(spark: SparkSession, root: str, endings: tuple[str, ...], pruned: tuple[str, ...] = PRUNED, hidden: bool = False) -> DataFrame:
    """Text files below root with one of the endings: path, content. Pruned and hidden folders, binary files (NUL in the first 8 KiB) and texts that are no UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = _below(F.col("path"), root)
    part = "|".join(map(re.escape, pruned))
    keep = F.lower(path).rlike(r"\.(" + "|".join(map(re.escape, endings)) + ")$") & ~path.rlike(f"(^|/)({part})/")
    if not hidden:
        keep = keep & ~path.rlike(r"(^|/)\.[^/]")
    head = F.substring("content", 1, 8192)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = raw.where(keep & (F.position(F.lit("00"), F.regexp_replace(F.hex(head), "(..)", "$1 ")) == 0)).select(path.alias("path"), text.alias("content"))
    return rows.where(F.col("content").isNotNull())


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """Text with ${NAME} and ${NAME:default} replaced; unknown names without default become empty."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)


def load_config(path: str, env: dict[str, str] | None = None) -> dict:
    with open(path, encoding="utf-8") as f:
        return tomllib.loads(substitute(f.read(), env))


def merge_config(base: dict, over: dict) -> dict:
    """base with the values of over, tables merged."""
    return {**base, **{k: merge_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def get_config(config: dict, dotted: str, default=None):
    for key in dotted.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def layers_of(toml: str) -> dict[str, list[str]]:
    """Layer rules: [[layers]] with name and allowed_deps, in order. Raises ValueError (DEP-CFG001) on bad text."""
    try:
        return {x["name"]: list(x.get("allowed_deps", [])) for x in tomllib.loads(toml).get("layers", [])}
    except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        raise ValueError(f"DEP-CFG001: {e}") from e


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback entries from JSON with the fixed schema; unknown shapes fail."""
    return spark.read.schema(FEEDBACK).option("mode", "FAILFAST").option("multiLine", True).json(path)


def request(body: str) -> dict:
    """An analysis request with defaults for what is missing; raises ValueError on bad JSON or types."""
    given = json.loads(body)
    if not isinstance(given, dict) or not isinstance(given.get("repo_path", ""), str):
        raise ValueError("a request is an object with a repo_path")
    return {"request_id": "", "repo_path": "", "commit_hash": "HEAD", "engines": [], "config": {}} | given


def github_name(url: str) -> str | None:
    """owner/name of a public repository URL, null for anything else."""
    m = re.fullmatch(r"https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?", url.strip())
    return f"{m[1]}/{m[2]}" if m else None
