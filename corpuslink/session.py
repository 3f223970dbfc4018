"""Session settings the jobs rely on, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that let Spark split hot keys at run time, and keep the batches of long texts that pass to Python small. Each is
# set only where the session has not set it.
WANTED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with adaptive execution and skew-join splitting on, where it has not been told otherwise."""
    said = spark.conf.getAll
    for key, value in WANTED.items():
        if key not in said:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session, whose executors share the
    driver's disk, gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-corpuslink-", dir="/tmp"))


# Whether the shuffle files of a finished execution are deleted at once, and not when the driver's memory happens to be collected.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def frozen(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` written to a table in the shared checkpoint folder and read back: lineage ends here, a lost
    executor costs nothing, and each row is computed once. Used by iterative jobs, and wherever a partition number must
    not change between two uses. ``instead_of``: the table of the round before, which nothing else reads; it is removed
    once the new one is written. What was shuffled on the way is deleted as well: nothing reads it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/frozen-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    if instead_of is not None:
        removed(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._frozen_at = path
    return out


def removed(table: DataFrame) -> None:
    """Delete a frozen table; any other table is left as it is."""
    path = getattr(table, "_frozen_at", None)
    if path is not None:
        context = table.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
