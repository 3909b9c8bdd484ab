"""Temperature scaling: NLL per temperature, fitting, reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import probability as pr

LOW, HIGH = 0.01, 10.0
_ROWS = 4096


def true_class_nll(proba: Column, y: Column, temperature: Column) -> Column:
    """NLL of the true class after scaling by ``temperature``."""
    scaled = pr.calibrated(proba, temperature)
    return pr.negative_log_likelihood(F.get(scaled, y.cast("int")))


def nll_by_temperature(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Mean NLL for every temperature of a fixed grid: ``(t, nll, n)``.

    A task adds up its batches for all grid points, so no row is opened into lines and only
    one partial line per task and grid point is exchanged. A row without the probability of its class has
    an NLL of zero, as in :func:`true_class_nll`.
    """
    points = [float(t) for t in grid]
    eps = pr.EPS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(points)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                proba, y = part.column(0), part.column(1)
                rows += part.num_rows
                size = pc.fill_null(pc.list_value_length(proba), 0).to_numpy()
                own = pc.fill_null(y, -1).to_numpy()
                kept = (own >= 0) & (own < size)
                # The rows of one width form a table.
                for width in np.unique(size[kept]).tolist():
                    some = kept & (size == width)
                    flat = proba.filter(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    z = np.log(flat + eps)
                    z -= z.max(axis=1, keepdims=True)
                    at = z[np.arange(len(z)), own[some]]
                    for k, t in enumerate(points):
                        p = np.exp(at / t) / np.exp(z / t).sum(axis=1)
                        total[k] -= np.log(np.fmax(np.fmin(p, 1.0), eps)).sum()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(total), pa.array([rows] * len(points))], ["t", "s", "n"])

    lines = scored.select("proba", F.col("y").cast("int").alias("y")).mapInArrow(work, "t double, s double, n long")
    return lines.groupBy("t").agg((F.sum("s") / F.sum("n")).alias("nll"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Step:
    """One pass of the search: where it looked, and the mean NLL and its derivatives in ``1/T`` there."""

    t: float
    nll: float
    slope: float
    curvature: float
    n: int


def _measured(rows: DataFrame, inverse: list[float]) -> list[Step]:
    """Mean NLL, slope and curvature at each ``1/T``, as sums of one pass over ``(z, own)``.

    For a row with logits z and true class y the NLL is ``ln sum exp(bz) - b z_y``; its derivatives in b are the mean of z
    under the scaled probabilities less ``z_y``, and their variance. A task adds up its batches and sends one line.
    A place is no part of the plan, so no pass has code of its own to compile, which would fill the driver's memory.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows, known = np.zeros((len(inverse), 3)), 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                lists, own = part.column(0), part.column(1).to_numpy()
                rows += part.num_rows
                size = pc.list_value_length(lists).to_numpy()
                gaps = lists.flatten().is_null().to_numpy(zero_copy_only=False)
                whole = np.bincount(np.repeat(np.arange(len(size)), size), gaps, len(size)) == 0
                # The rows of one width form a table; a row with a gap counts, but has no NLL.
                for width in np.unique(size[whole]).tolist():
                    some = whole & (size == width)
                    z = lists.filter(pa.array(some)).flatten().to_numpy().reshape(-1, width)
                    known += len(z)
                    for k, b in enumerate(inverse):
                        e = np.exp(b * z)
                        total = e.sum(axis=1)
                        first, second = (e * z).sum(axis=1) / total, (e * z * z).sum(axis=1) / total
                        sums[k] += (np.log(total) - b * own[some]).sum(), (first - own[some]).sum(), (second - first * first).sum()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([known]), pa.array([sums.ravel().tolist()])], ["n", "known", "sums"])

    parts = rows.select("z", "own").mapInArrow(work, "n long, known long, sums array<double>").collect()
    n, known = (sum(p[c] for p in parts) for c in ("n", "known"))
    if not n:
        raise ValueError("no validation rows to fit a temperature on")
    means = np.sum([p["sums"] for p in parts], axis=0).reshape(-1, 3) / known if known else np.full((len(inverse), 3), np.nan)
    return [Step(1.0 / b, *map(float, of), n) for b, of in zip(inverse, means)]


def temperature_steps(scored: DataFrame, most: int = 8, tolerance: float = 1e-10) -> list[Step]:
    """The search for the temperature in (0.01, 10) that minimises mean NLL of ``(proba, y)``: one step a pass.

    NLL is convex in ``b = 1/T``, so the sign of its slope tells on which side the minimum lies. The first pass looks at nine
    places over the whole range; then come Newton steps in b, each inside the bracket known so far, or its geometric
    middle where a step would leave it. A minimum beyond the range ends at its border. Every row is read
    once a pass and never copied; a pass brings a few numbers to the driver.
    """
    logits = F.transform("proba", lambda p: F.log(p + F.lit(pr.EPS)))
    top = F.array_max("z")
    rows = scored.select(logits.alias("z"), F.col("y").cast("int").alias("y"))
    rows = rows.select(F.zip_with("z", F.array_repeat(top, F.size("z")), lambda z, m: z - m).alias("z"), "y")
    rows = rows.select("z", F.get("z", F.col("y")).alias("own")).filter("own is not null").persist()
    try:
        low, high = 1.0 / HIGH, 1.0 / LOW
        wide = _measured(rows, [low * (high / low) ** (k / 8) for k in range(9)])
        best = min(wide, key=lambda s: (s.nll, s.t))
        steps = [best]
        if wide[0].slope >= 0 or wide[-1].slope <= 0:
            return [wide[0] if wide[0].slope >= 0 else wide[-1]]
        at = next(k for k, s in enumerate(wide) if s.slope > 0)
        low, high = 1.0 / wide[at - 1].t, 1.0 / wide[at].t
        while len(steps) < most:
            b = 1.0 / best.t
            move = best.slope / best.curvature if best.curvature > 0 else math.inf
            if abs(move) <= tolerance * b:
                break
            b = b - move if low < b - move < high else math.sqrt(low * high)
            best = _measured(rows, [b])[0]
            steps.append(best)
            low, high = (b, high) if best.slope < 0 else (low, b)
        return steps
    finally:
        rows.unpersist()


def fit_temperature(scored: DataFrame) -> float:
    """The temperature in (0.01, 10) that minimises mean NLL of ``(proba, y)``; see :func:`temperature_steps`."""
    return temperature_steps(scored)[-1].t


def best_on_grid(scored: DataFrame, grid: list[float]) -> DataFrame:
    """One round of the search as a one-row table ``(t, nll)``; smaller T on a tie."""
    by_t = nll_by_temperature(scored, grid).withColumn("r", F.round("nll", 9))
    return by_t.agg(
        F.min_by("t", F.struct("r", "t")).alias("t"), F.min("r").alias("nll")
    )


def calibrated_prediction(scored: DataFrame, temperature: float) -> DataFrame:
    """Add ``cal`` (scaled probabilities), ``pred`` and ``confidence``."""
    return (
        scored.withColumn("cal", pr.calibrated(F.col("proba"), temperature))
        .withColumn("pred", pr.argmax(F.col("cal")))
        .withColumn("confidence", F.array_max("cal"))
    )


def calibration_report(scored: DataFrame, temperature: float) -> DataFrame:
    """Mean confidence before and after scaling, and the direction, in one row."""
    cal = pr.calibrated(F.col("proba"), temperature)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.array_max("proba")).alias("confidence_before"),
        F.avg(F.array_max(cal)).alias("confidence_after"),
    ).select(
        F.lit(float(temperature)).alias("t"),
        F.when(F.lit(temperature) < 1, "sharpening").otherwise("flattening").alias("direction"),
        "n",
        "confidence_before",
        "confidence_after",
    )
