"""What several operators share: tables in the shared folder, ASCII folding, bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows in an Arrow batch at most. Texts can be long, and a batch is held whole by the JVM and by the Python worker.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scanloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/scanloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: no lineage is left, and a lost executor loses no rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to BATCH_ROWS rows in this session, unless it asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a key from which on its group is broadcast at least, and how many such groups there can be at most.
HOT_ROWS, MAX_HOT = 1 << 10, 1 << 16


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``groups`` on ``key``, of which ``groups`` has each value once, with its number of rows in ``size``.

    Groups of HOT_ROWS or ``n_rows`` / MAX_HOT rows and more are broadcast. There are MAX_HOT of them at most, as their rows
    are ``n_rows`` together, and the rows of none of them meet in a task. Only the rows of the others shuffle.
    """
    least = max(HOT_ROWS, -(-n_rows // MAX_HOT))
    hot = groups.filter(F.col(size) >= least)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) < least), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """A materialised table of a few numbers a row: to be broadcast if it has BROADCAST_ROWS rows or fewer, counted here;
    otherwise a join with it shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
