"""Incremental indexing of arriving texts (X1): a file stream whose batches append to the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslink.functions.text import normalize
from corpuslink.operators.search import trigrams, vocabulary


def _stored_ids(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The ids that other batches have stored."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/text_norm")
    if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{folder}/text_norm").where(F.col("batch") != batch_id).select("report_id")


def append_batch(batch: DataFrame, folder: str, batch_id: int) -> None:
    """One batch's new texts, folded, with their trigrams and word counts, each in a folder named by the batch: a batch done
    again after a failure writes the same folder again. Texts stored before are left out by a join with the stored ids, so
    that the stream itself keeps no state."""
    spark = batch.sparkSession
    stored = _stored_ids(spark, folder, batch_id)
    fresh = batch.dropDuplicates(["report_id"])
    fresh = fresh if stored is None else fresh.join(stored, "report_id", "left_anti")
    normed = fresh.withColumn("norm", normalize(F.col("text"))).persist()
    try:
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        kept = [c for c in ("report_id", "collection", "language", "norm") if c in normed.columns]
        write(normed.select(*kept), "text_norm")
        write(trigrams(normed), "trigrams")
        write(vocabulary(normed), "words")
    finally:
        normed.unpersist()


def index_stream(spark: SparkSession, arriving: str, schema, folder: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Index every file that has arrived since the last run, then stop (available-now). Texts seen before are left out by
    ``report_id``."""
    texts = spark.readStream.schema(schema).format(form).load(arriving)
    return (texts.writeStream.foreachBatch(lambda df, i: append_batch(df, folder, i)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def indexed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The derived tables over all batches; word counts are summed."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return {"text_norm": read("text_norm").drop("batch"), "trigrams": read("trigrams").drop("batch"),
            "words": read("words").groupBy("word").agg(F.sum("n").alias("n"))}
