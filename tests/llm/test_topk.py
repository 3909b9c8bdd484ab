"""Exact top-k against sorting all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilmark.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, e in good:
        if q % 20:
            continue
        scores = sorted(((sum(a * b for a, b in zip(e, w)), i) for i, w in good if i != q), key=lambda x: (-x[0], x[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, 16_384])
def test_all_scores(spark, chunk):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.1, -0.3, rng.gauss(0, 0.2)]) for _ in range(12)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 190)]
    rows += [(200, None), (220, [None] * 12), (240, [float("nan")] * 12), (None, rows[0][1]), (260, [float("inf")] * 12), (280, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("score"), F.lit(2).alias("block"))
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 20 == 0, 20, per_block=40, queries_at_once=chunk)
    assert sorted(tuple(r) for r in got.collect()) == brute(stored, 20)


def test_large_components_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1e6, -1e6]), (1, [1e6, 2.0]), (20, [3e5, 0.5])], "vec_id long, embedding array<double>")
    got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
    assert topk.top_k(topk.whole_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_components_beyond_sums_of_64_bits(spark):
    big = 2.0**27
    rows = [(0, [big, -big, big, 1.0]), (1, [5e6, 2.0, -5e6, 7.0]), (2, [big, big, 3.0, 0.5]), (3, [-big, 1.0, big, 2.0]), (20, [5e6, 0.5, 1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)
    cancel = [(0, [2.0**27] * 64), (1, [2.0**27, -(2.0**27)] * 32), (2, [1.0] + [0.0] * 63)]
    df = spark.createDataFrame(cancel, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(cancel, 20)
