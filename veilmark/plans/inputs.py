"""Inputs derived from the given tables, shared by the registered queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.fixed_values import LEVELS, STARTER_PHRASES
from veilmark.operators import tfidf
from veilmark.operators.scoring import Model
from veilmark.session import spread

SIZES = [8, 4, len(LEVELS)]
#: Spreads the formula model's confidence over all histogram bins and both sides of every threshold.
TEMPERATURE = 0.07
#: The lowered limit, for the queries about the size guard; runs use the real one.
SIZE_LIMIT = 5000
#: Three of forty documents have a suffix that is refused.
SUFFIXES = ([".txt", ".md", ".html", ".htm", ".docx", ".xlsx", ".pptx"] * 6)[:37] + [".pdf", ".zip", ""]
STAMP = "2024-01-31T00:00:00Z"
PERSONAL_LINE = " Contact a.b@org.com, +44 7700 900123, DOB 5 Feb 1988, EMP-00421, budget €342M."
GRID = [round(0.05 * k, 2) for k in range(1, 201)]

_vocabularies: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", *more), "doc_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, text, y)`` with four classes."""
    y = (2 * F.col("quality") + F.col("toxic")).cast("int").alias("y")
    truth = table(spark, sf, "labels").select("doc_id", y)
    return documents(spark, sf).join(truth, "doc_id")


def guided(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """Scored rows with a truth that agrees with the prediction for seven of ten ids, so that
    calibration has a best temperature inside its bounds."""
    off = (F.col("pred") + 1 + F.col("doc_id") % 4) % len(LEVELS)
    return scored.withColumn("y", F.when(F.col("doc_id") % 10 < 7, F.col("pred")).otherwise(off).cast("int"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


def fixed_confidence(rows: DataFrame) -> DataFrame:
    """Predictions of a stand-in scorer: a formula of the id."""
    return rows.select(
        "doc_id",
        (F.col("doc_id") % len(LEVELS)).cast("int").alias("pred"),
        (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("confidence"),
    )


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with one signal phrase in front and, for every fourth, personal data."""
    level = (F.col("doc_id") % len(LEVELS)).cast("int")
    at = (F.floor(F.col("doc_id") / len(LEVELS)) % 8).cast("int")
    phrases = F.array(*[F.lit(STARTER_PHRASES[k]) for k in range(len(LEVELS))])
    tail = F.when(F.col("doc_id") % 4 == 0, F.lit(PERSONAL_LINE)).otherwise(F.lit(""))
    return documents(spark, sf).select(
        "doc_id",
        level.alias("expected"),
        F.concat(F.get(F.get(phrases, level), at), F.lit(". "), F.col("text"), tail).alias("text"),
    )


def all_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """``(y)`` of every document, null where there is no label."""
    y = (2 * F.col("quality") + F.col("toxic")).cast("int").alias("y")
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", y), "doc_id", "left").select("y")


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents seen as files: a path with one of ten suffixes and a size."""
    suffix = F.get(F.lit(SUFFIXES), (F.col("doc_id") % len(SUFFIXES)).cast("int"))
    path = F.concat(F.lit("drop/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)
    return documents(spark, sf, "source", "n_chars").select(
        "doc_id", path.alias("path"), F.col("n_chars").alias("length"), "text"
    )


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary fitted on all documents; fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _vocabularies:
        _vocabularies[key] = tfidf.fit_vocabulary(documents(spark, sf))
    return _vocabularies[key]


def formula_layers(n_inputs: int, sizes: list[int] = SIZES, shift: int = 0):
    """Weights and biases from a closed formula; all are multiples of 1/64, so sums
    of them are exact."""
    layers, wide = [], n_inputs
    for k, narrow in enumerate(sizes):
        i, j = np.arange(wide)[:, None], np.arange(narrow)[None, :]
        weight = ((i * 31 + j * 17 + (k + shift) * 7) % 101 - 50) / 64.0
        bias = ((np.arange(narrow) * 13 + k * 5) % 11 - 5) / 64.0
        layers.append((weight, bias))
        wide = narrow
    return layers


def formula_model(spark: SparkSession, sf: str, shift: int = 0, temperature: float = TEMPERATURE) -> Model:
    rows = vocabulary(spark, sf).orderBy("feature_idx").toPandas()
    return Model(
        name=f"formula{shift}", terms=rows.term.tolist(), idf=rows.idf.to_numpy(),
        layers=formula_layers(len(rows), shift=shift), temperature=temperature,
    )
