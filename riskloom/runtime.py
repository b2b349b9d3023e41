"""Reading tables, cutting lineage in the shared folder, and joins whose broadcast side is measured first."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted to hold at most this many rows ...
BROADCAST_ROWS = 200_000
#: ... of at most this many bytes each (string columns are measured), 32 MB in all.
BROADCAST_BYTES = 32 << 20

_counter = itertools.count()
_folders: dict[str, str] = {}

#: Unicode white space (fixed values), as one string for trim().
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a data folder, read with only the named columns (all if none are named)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def _scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. A local temporary folder serves only a local master."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        _folders[app] = f"{shared.rstrip('/')}/riskloom-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _folders[app]


def release(spark: SparkSession) -> None:
    """Delete what cut() has written for this application; frames that read it can't be used any more."""
    try:
        folder = _folders.pop(spark.sparkContext.applicationId, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before us
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table of the shared folder and read it back.

    The plan above starts from durable files, so a lost executor costs no recomputation of what lies below,
    and the optimizer knows the size of what it reads.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/t{next(_counter)}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """A cut copy of df, and whether it is small enough to be broadcast."""
    df = cut(df)
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(16) for c, t in df.dtypes), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return df, n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_measured(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """big joined to small: by broadcast when small has been counted to be small, else by a shuffled join that AQE may split."""
    small, fits = measured(small)
    return big.join(F.broadcast(small) if fits else small, on, how)


def spread(df: DataFrame, times: int = 1) -> DataFrame:
    """df over at least ``times`` as many partitions as there are cores, for work in Python that outweighs a shuffle.

    Only an input of few partitions, hence small, is repartitioned; a large one passes as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * times
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def normal_hash(c: Column | str) -> Column:
    """A commit hash without surrounding white space and case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE)))
