"""Sessions and the shared working folder.

Operators that cut lineage write Parquet under the folder that the session
names in ``spark.checkpoint.dir``; only where that is unset and Spark runs in one
local process (tests, a laptop) is a temporary folder chosen.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Temporary folders of local applications that name no folder; the setting itself
#: can't be changed once the application runs.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lensframe-")
    return _LOCAL[app]


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lensframe/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Within, a finished write takes its own shuffle files with it instead of
    leaving them until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is None:  # a Spark without the setting
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within, Python workers get at most so many rows at a time: for rows that
    are whole blocks of data."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads do
    not recompute it, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables made by ``materialise`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_work_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def task_count(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows, about ``each`` of them in one, and not fewer than the
    session's own number: what a task holds then stays the same as tables grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
