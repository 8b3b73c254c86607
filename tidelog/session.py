"""Session helpers shared by operators, tests and the bench."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not configured:
            configured = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a session without one (a local test)
    gets a temporary folder, which is never done on a cluster.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def within(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if, and only if, a count proves it has at most ``max_rows`` rows."""
    return F.broadcast(df) if within(df, max_rows) else df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of ``frames`` has (compared as Spark does, without case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, moved to all cores by a hash of ``key`` if its scan leaves most of them idle.

    A file with one row group is one task however large the cluster. Only the key column is read to see that; tables of
    many row groups are evenly spread as they are and aren't shuffled.
    """
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
    if sizes and max(sizes) > 2 * sum(sizes) / cores and sum(sizes) >= 16 * cores:
        return df.repartition(2 * cores, F.xxhash64(F.col(f"`{key}`")))
    return df
