"""Session helpers shared by all operators.

Lineage is cut through files in the folder the cluster names in
``spark.checkpoint.dir``; that folder is readable by the driver and every
executor, so a lost executor costs a task retry and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What each open scope, the innermost last, has written and kept.
_scopes: list[tuple[list[str], list[DataFrame]]] = []


def session(name: str = "peakmill", cores: str = "*") -> SparkSession:
    """A local session for tests and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that setting is absent."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        else:
            path = tempfile.mkdtemp(prefix="peakmill-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/peakmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a cut in the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1][0].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counting(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, int]:
    """materialize(), and in how many rows the flag column holds, seen while writing: a round of an iteration in one job."""
    seen = Observation()
    path = scratch_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1][0].append(path)
    df.observe(seen, F.count_if(F.expr(flag)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def materialize_while(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, bool]:
    """materialize(), and whether the flag column holds in any row."""
    made, n = materialize_counting(df, name, flag)
    return made, bool(n)


def replaced(df: DataFrame) -> None:
    """Remove the files of a materialized table once a later one holds all that is still needed of it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def kept(df: DataFrame) -> DataFrame:
    """df kept on executors' disks for several uses; a lost executor's part is computed anew."""
    if _scopes:
        _scopes[-1][1].append(df)
    return df.persist(StorageLevel.DISK_ONLY)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized and kept inside are removed at the end: write the result before."""
    _scopes.append(([], []))
    try:
        yield
    finally:
        paths, frames = _scopes.pop()
        for df in frames:
            df.unpersist()
        for path in paths:
            discard(spark, path)


def parts_for(rows: int, each: int) -> int:
    """Files for a table of that many rows; for coalesce(), so that a small table isn't strewn over hundreds."""
    return max(1, -(-rows // each))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores, if it comes in fewer; for rows that become many, as reads do. A table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
