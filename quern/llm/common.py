"""Shared plumbing: the shared folder, written intermediate tables and skew-safe lookups."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot groups.
HOT_SHARE = 1000
#: Rows in an Arrow batch handed to Python; bounds the memory of a worker.
BATCH_ROWS = 1024

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is missing (tests in local mode) one temporary folder is made for
    the process and removed when it ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if "at" not in _own:
        _own["at"] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _own["at"], ignore_errors=True)
    return f"file://{_own['at']}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    This cuts the lineage: a lost executor later costs a re-read and no recomputation. The
    shuffle files that the write needed go with its end. With a key (df dealt by it already, into `parts`)
    each part is a bucket of a table in the session's catalog: a join on the key shuffles its other side alone.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    table = f"quern_{uuid.uuid4().hex}" if key else None
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        to = df.write.option("compression", "zstd")
        if key:
            to.format("parquet").bucketBy(parts(spark), key).saveAsTable(table, path=path)
        else:
            to.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.table(table) if key else spark.read.schema(df.schema).parquet(path)
    out.written_at, out.written_as = path, table
    return out


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(df: DataFrame) -> None:
    """Remove a table that written() made, once nothing reads it any more."""
    if df.written_as:
        df.sparkSession.sql(f"drop table {df.written_as}")
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """df if it is a scan with projections and filters, else df written to the shared folder.

    Operators that read their input twice tell rows apart by
    monotonically_increasing_id, which a scan repeats exactly; a plan with an exchange
    may deal its rows otherwise the second time.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = set(re.findall(r"^[\s:+\-|]*(\w+)", plan, re.M))
    return df if nodes <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "View"} else written(df, "input")


def small_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def attach(base: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of base with groups (one row per key), safe against hot keys.

    base is read twice and so should be a written table; `size` counts the rows of base in
    a group. Groups with total / HOT_SHARE rows or more are at most HOT_SHARE by
    arithmetic: they are broadcast and their rows are not shuffled. In the shuffle join
    that serves the rest no key holds more than that share of the rows.
    """
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    return base.join(hot, key).unionByName(base.join(hot.select(key), key, "left_anti").join(groups.where(~is_hot), key))
