"""Output tables: log, slim log, review queue, nine-column export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.fixed_values import EXPORT_COLUMNS, LOG_COLUMNS
from veilmark.functions.reporting import csv_line
from veilmark.operators.evaluation import errors_by_status, level_counts, run_summary


def slim(log: DataFrame) -> DataFrame:
    return log.select("filename", "classification")


def review_queue(log: DataFrame) -> DataFrame:
    return log.filter("review_flag")


def export_rows(log: DataFrame) -> DataFrame:
    """The nine-column form, with a space instead of ``T`` in the time stamp."""
    renamed = log.withColumn("timestamp", F.replace("timestamp", F.lit("T"), F.lit(" "))).withColumnsRenamed(
        {"extraction_status": "status", "extraction_detail": "detail"}
    )
    return renamed.select(*EXPORT_COLUMNS)


def export_lines(log: DataFrame) -> DataFrame:
    """The export as finished CSV lines, quoted only where needed."""
    rows = export_rows(log)
    return rows.select(csv_line(*[F.col(c) for c in EXPORT_COLUMNS]).alias("line"))


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), "filepath")


def write_log(log: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Write the log, the slim log, the review queue and the summaries below ``folder``.

    The corpus is scored once: the log is stored as Parquet first, and everything else is read from it.
    The summaries are totals, rows per level, and errors per status.
    """
    stored = f"{folder.rstrip('/')}/log" + ("" if fmt == "parquet" else "_stored")
    log.select(*LOG_COLUMNS).write.mode("errorifexists").parquet(stored)
    log = log.sparkSession.read.parquet(stored)
    parts = [
        ("slim", slim(log)),
        ("review", review_queue(log)),
        ("summary", run_summary(log)),
        ("levels", level_counts(log)),
        ("errors", errors_by_status(log)),
    ]
    for name, rows in parts if fmt == "parquet" else [("log", log), *parts]:
        writer = rows.write.mode("errorifexists")
        path = f"{folder.rstrip('/')}/{name}"
        if fmt == "csv":
            writer.option("header", True).option("escape", '"').csv(path)
        else:
            writer.format(fmt).save(path)


def write_export(log: DataFrame, folder: str) -> DataFrame:
    """The nine-column CSV as one ordered file in parts; returns the list of its parts.

    Lines stand newest first, then by path, and end with CRLF; the header is the first line of the first part and of no
    other. Rows are dealt to parts by range, so the parts joined in the order of their names are the file. An
    empty log gives the header alone.
    """
    named = {"status": "extraction_status", "detail": "extraction_detail"}
    fields = [F.replace("timestamp", F.lit("T"), F.lit(" ")) if c == "timestamp" else F.col(named.get(c, c)) for c in EXPORT_COLUMNS]
    of = log.select("timestamp", "filepath", F.lit(1).alias("place"), csv_line(*fields).alias("value"))
    head = log.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("filepath"),
        F.lit(0).alias("place"), F.lit(",".join(EXPORT_COLUMNS)).alias("value"),
    )
    lines = of.unionByName(head).orderBy("place", F.desc("timestamp"), "filepath", "value")
    lines.select("value").write.option("lineSep", "\r\n").text(folder)
    return export_parts(log.sparkSession, folder)


def export_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``part, filename, bytes`` of a written export, in the order in which the parts make the file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"^part-(\d+)", 1).cast("int")
    return found.select(number.alias("part"), name.alias("filename"), F.col("length").alias("bytes")).orderBy("part")
