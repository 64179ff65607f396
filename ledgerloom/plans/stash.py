"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}  # by application
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STORED = "_ledgerloom_path"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, one is made if all tasks run in this
    process (tests); on a cluster executors would not share it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        named = _OWN[app]
    return named.rstrip("/")


def stash(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    A lost executor costs only the unfinished tasks of the current step, and every later plan starts from a
    scan whose size the optimiser knows. The rows are as stored: sources are never evaluated a second time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")  # the shuffles of the step go when it is stored, not when the driver collects garbage
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_STORED] = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Deletes the files of stashed steps that nothing reads any more: all that was made of them must be stored."""
    for df in stashed:
        if path := df.__dict__.pop(_STORED, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of fixed width that a join may send to every executor (at 40 bytes, some 80 MB).
SMALL_ROWS = 2_000_000


def small(stashed: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table of fixed-width rows, marked for broadcast if its count allows it; else as it is, to be joined
    by a shuffle."""
    return F.broadcast(stashed) if stashed.count() <= rows else stashed
