"""The same classification over arriving documents, and windowed counts of its log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.operators.scoring import Model
from veilmark.plans.classify import classify
from veilmark.session import fresh_folder
from veilmark.sources import registry


def arriving(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """A stream over parquet files as they appear."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def classify_stream(stream: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Stateless: vocabulary, weights and temperature are those the model had at the start."""
    return classify(stream, model, text)


def _batch_writer(models: str, out: str, text: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept, rows = f"{out}/manifests/batch={number}", f"{out}/rows/batch={number}"
        if not registry._complete(spark, kept):
            spark.read.parquet(f"{models}/manifest").write.mode("overwrite").parquet(kept)
        model = registry.load_model(spark, models, kept)
        tag = F.lit(registry.content_hash(model))
        classify(batch, model, text).withColumn("model_hash", tag).write.mode("overwrite").parquet(rows)

    return write


def classify_under_changing_models(stream: DataFrame, models: str, out: str, text: str = "text") -> DataFrame:
    """Classify what has arrived with the model that the folder ``models`` names, and return all rows so far.

    The manifest is read once a batch, so a model saved while the stream runs, or between two runs, takes over with
    the next batch. A batch keeps the manifest that it read and writes its rows under its number: when it
    is run again after a failure, the same model scores it and its rows replace those of the broken try. ``model_hash``
    names the model of each row. State, rows and manifests lie below ``out``, which later calls go on from.
    """
    out = out.rstrip("/")
    query = (
        stream.writeStream.foreachBatch(_batch_writer(models.rstrip("/"), out, text))
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/rows").drop("batch")


def level_windows(
    log: DataFrame, window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Rows and review rate per window and level; later rows than ``late`` are dropped."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "classification")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("review_flag").cast("double")).alias("review_rate"),
        )
        .select(F.col("window.start").alias("start"), "classification", "n", "review_rate")
    )


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available into a parquet table, append mode, and return it."""
    spark = stream.sparkSession
    folder = fresh_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
