"""The classification run: texts or files in, log and summaries out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.fixed_values import LOG_COLUMNS
from veilmark.functions import reporting as rp
from veilmark.operators import scoring
from veilmark.operators.evaluation import errors_by_status, run_summary  # noqa: F401


def run_stamp() -> str:
    """One time stamp per run."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def with_prediction(scored: DataFrame, model: scoring.Model) -> DataFrame:
    """Turn the scorer's columns into the five prediction columns.

    Keeps ``pred`` and ``raw_confidence``, the unrounded value the flag is taken from.
    """
    names = F.array(*[F.lit(c) for c in model.classes])
    return scored.withColumns(
        {
            "classification": F.get(names, F.col("pred")),
            "confidence": rp.rounded(F.col("raw_confidence")),
            "review_flag": rp.review_flag(F.col("raw_confidence"), model.review_threshold),
            "reasoning": F.when(
                F.col("pred").isNotNull(), scoring.reasoning(F.col("signals"))
            ),
            "policy_version": F.lit(model.policy_version),
        }
    ).drop("proba", "signals")


def classify(
    df: DataFrame, model: scoring.Model, text: str = "text", on_empty: str = "score"
) -> DataFrame:
    """Replace the text column by the prediction. One narrow stage, batch or stream.

    ``on_empty='reject'`` drops rows without any visible text.
    """
    if on_empty == "reject":
        df = df.filter(F.regexp_replace(F.col(text), r"[\s\p{Z}]+", "") != "")
    return with_prediction(scoring.score_text(df, model, text), model)


def run_log(
    extracted: DataFrame,
    model: scoring.Model,
    stamp: str | None = None,
    min_confidence: float = 0.0,
    review_only: bool = False,
) -> DataFrame:
    """The 12-column log of a run over extracted files.

    ``extracted`` has path, filename, extension, length, text, extraction_status
    and extraction_detail. Rows that could not be read keep their place with a
    null prediction.
    """
    done = classify(extracted, model)
    readable = F.col("extraction_status") == "ok"
    failed = readable & F.col("pred").isNull()
    status = F.when(failed, "classification_failed").otherwise(F.col("extraction_status"))
    only = lambda c: F.when(readable, F.col(c)).alias(c)
    log = done.select(
        F.lit(stamp or run_stamp()).alias("timestamp"),
        F.col("path").alias("filepath"),
        "filename",
        "extension",
        F.col("length").alias("size_bytes"),
        *[only(c) for c in ("classification", "confidence", "review_flag", "reasoning")],
        "policy_version",
        status.alias("extraction_status"),
        F.coalesce(F.when(failed, F.col("score_error")), "extraction_detail", F.lit("")).alias("extraction_detail"),
    )
    return selected(log, min_confidence, review_only).select(*LOG_COLUMNS)


def selected(log: DataFrame, min_confidence: float = 0.0, review_only: bool = False) -> DataFrame:
    """Drop confident or unflagged rows as asked; rows with an error always stay."""
    error = F.col("extraction_status") != "ok"
    if min_confidence > 0:
        log = log.filter(error | (F.col("confidence") >= min_confidence))
    if review_only:
        log = log.filter(error | F.col("review_flag"))
    return log


def register_sql(model: scoring.Model, spark, name: str = "classify_terms") -> None:
    """Make the scorer callable from SQL on an array of terms."""
    spark.udf.register(name, scoring.scorer(spark, model))
