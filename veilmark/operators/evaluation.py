"""Evaluation aggregates over prediction rows ``(y, pred, confidence)``.

Every one is a single pass with partial aggregation; later steps work on at most
classes x classes counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.fixed_values import HISTOGRAM_EDGES, HISTOGRAM_LABELS, LEVELS, REVIEW_THRESHOLD
from veilmark.levels import level_name, level_table


#: Stands for a null or unknown class.
OUTSIDE = -1


def _grid(df: DataFrame, n: int) -> DataFrame:
    """All (true, predicted) class pairs, from one generated row."""
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    return df.sparkSession.range(1).select(F.explode(axis).alias("y")).select(
        "y", F.explode(axis).alias("pred")
    )


def confusion_matrix(preds: DataFrame, n: int = len(LEVELS)) -> DataFrame:
    """``(y, pred, n)`` for every pair of classes, zeros included.

    A class that is null or outside the list counts as ``OUTSIDE``; such pairs appear
    where there are any, so the cells add up to the rows.
    """
    side = lambda c: F.when(F.col(c).between(0, n - 1), F.col(c).cast("int")).otherwise(OUTSIDE).alias(c)
    counts = preds.groupBy(side("y"), side("pred")).agg(F.count(F.lit(1)).alias("n"))
    return _grid(preds, n).join(counts, ["y", "pred"], "full").select(
        "y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and averages.

    Accuracy is over all rows; a row whose class or prediction is null or unknown is a miss.
    """
    cells = confusion_matrix(preds)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("claimed"),
                         F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per = (
        sides.filter(F.col("c") != OUTSIDE).groupBy("c")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
        .withColumn("precision", _ratio(F.col("hit"), F.col("claimed")))
        .withColumn("recall", _ratio(F.col("hit"), F.col("support")))
        .withColumn(
            "f1",
            _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )
    classes = per.select(level_name(F.col("c")).alias("label"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    scores = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(s).alias(s) for s in scores], total.alias("support"))
    weighted = per.agg(
        *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
        total.alias("support"),
    )
    right = F.sum(F.when((F.col("y") == F.col("pred")) & (F.col("y") != OUTSIDE), F.col("n")).otherwise(0))
    hits = cells.agg(_ratio(right, F.sum("n")).alias("a"), F.sum("n").alias("support"))
    accuracy = hits.select(*[F.col("a").alias(s) for s in scores], "support")
    named = lambda df, label: df.select(F.lit(label).alias("label"), *scores, "support")
    return (
        classes.unionByName(named(accuracy, "accuracy"))
        .unionByName(named(macro, "macro avg"))
        .unionByName(named(weighted, "weighted avg"))
    )


def _bin(confidence: Column) -> Column:
    """Index of the half-open histogram bin; the last bin is closed."""
    edges = HISTOGRAM_EDGES
    chain = F.when(confidence < edges[0], F.lit(None))
    for k, edge in enumerate(edges[1:-1]):
        chain = chain.when(confidence < edge, F.lit(k))
    return chain.when(confidence <= edges[-1], F.lit(len(edges) - 2))


def confidence_histogram(preds: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Rows and share per confidence bin, empty bins kept, with a review mark."""
    labels = F.array(*[F.lit(x) for x in HISTOGRAM_LABELS])
    uppers = F.lit([float(x) for x in HISTOGRAM_EDGES[1:]])
    bins = preds.sparkSession.range(1).select(F.posexplode(labels).alias("bin", "label"))
    counts = preds.groupBy(_bin(F.col("confidence")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Seven rows at most: the total is a window over them, with no second scan.
    everything = Window.partitionBy(F.lit(0))
    return (
        bins.join(counts, "bin", "left")
        .withColumn("total", F.sum("n").over(everything))
        .select(
            "bin",
            "label",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            _ratio(100.0 * F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))).alias("share"),
            (F.get(uppers, F.col("bin")) <= threshold).alias("review"),
        )
    )


def accuracy(preds: DataFrame) -> DataFrame:
    """Rows, accuracy and mean confidence; a row without class or prediction is a miss."""
    return preds.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce((F.col("pred") == F.col("y")).cast("double"), F.lit(0.0))).alias("accuracy"),
        F.avg("confidence").alias("confidence_mean"),
    )


def compare_models(first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Accuracy of two models on the same rows and the signed difference."""
    both = first.select(id_col, "y", F.col("pred").alias("p1")).join(
        second.select(id_col, F.col("pred").alias("p2")), id_col
    )
    right = lambda p: F.avg((F.col(p) == F.col("y")).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), right("p1").alias("first"), right("p2").alias("second")).withColumn(
        "delta", F.col("second") - F.col("first")
    )


def class_distribution(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows per class, rows without a class, and the total, told apart by ``is_total``."""
    return df.rollup(label).agg(F.count(F.lit(1)).alias("n"), F.grouping(label).cast("int").alias("is_total"))


def golden_check(preds: DataFrame, expected: DataFrame, on: str) -> DataFrame:
    """How many predicted levels agree with the expected ones."""
    joined = preds.join(expected, on)
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("got") == F.col("expected")).cast("long")).alias("correct"),
    )


def parity(first: DataFrame, second: DataFrame, id_col: str = "doc_id", places: int = 9) -> DataFrame:
    """Compare two scorers row by row: rows on one side only, rows that differ."""
    rounded = lambda c: F.transform(c, lambda p: F.round(p, places))
    j = first.select(id_col, F.col("proba").alias("a")).join(
        second.select(id_col, F.col("proba").alias("b")), id_col, "full_outer"
    )
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("one_sided"),
        F.count_if(rounded("a") != rounded("b")).alias("different"),
    )


def level_counts(log: DataFrame) -> DataFrame:
    """All six levels in order with the number of log rows of each."""
    counts = log.groupBy(F.col("classification").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return level_table(log.sparkSession).join(counts, "name", "left").select(
        "idx", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def sufficiency(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows per class with the effect to expect from that many."""
    n = F.col("n")
    effect = (
        F.when(n < 5, "marginal").when(n < 15, "noticeable").when(n < 30, "strong").otherwise("diminishing")
    )
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("effect", effect)


def run_summary(log: DataFrame) -> DataFrame:
    """Total, classified, errors and flagged rows of a log."""
    missing = F.col("classification").isNull()
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~missing).alias("classified"),
        F.count_if(missing).alias("errors"),
        F.count_if(F.col("review_flag")).alias("flagged"),
    )


def errors_by_status(log: DataFrame) -> DataFrame:
    return (
        log.filter(F.col("classification").isNull())
        .groupBy("extraction_status")
        .agg(F.count(F.lit(1)).alias("n"))
    )
