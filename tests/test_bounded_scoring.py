"""Words in place of terms, batches in slices, sums without opened rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmark.functions import lists
from veilmark.operators import calibration as cal
from veilmark.operators import scoring, tfidf

TERMS = ["aa", "aa bb", "bb", "bb", "cc dd", "dd aa", "x y z"]


def test_words_give_the_weights_of_terms():
    rng = np.random.default_rng(1)
    rows = [rng.choice(["aa", "bb", "cc", "dd", "ee"], n).tolist() for n in (0, 1, 7, 0, 400, 2)]
    both = [r + [f"{a} {b}" for a, b in zip(r, r[1:])] for r in rows]
    idf = np.linspace(1, 2, len(TERMS))
    want = scoring._weigh(pa.array(both, pa.list_(pa.string())), pa.array(TERMS), idf)
    got = scoring._weigh_words(pa.array(rows, pa.list_(pa.string())), scoring._word_table(TERMS), idf)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and len(got[0]) == 8
    for terms in ([], ["aa bb"]):
        empty = scoring._weigh_words(pa.array(rows, pa.list_(pa.string())), scoring._word_table(terms), np.ones(len(terms)))
        assert len(empty[0]) == (len(np.unique(empty[0])) if terms else 0)


def test_slices_hold_every_row_once():
    rows = pa.array([[1] * n for n in (0, 3, 9, 1, 0, 2)])
    for most in (1, 4, 100):
        parts = list(lists.slices(rows, most))
        assert pa.concat_arrays(parts).equals(rows)
        assert all(len(p) == 1 or len(p.flatten()) <= most for p in parts)


def test_batches_are_small_and_pairs_are_not_made_as_strings(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        docs = spark.createDataFrame([(1, "aa bb aa bb"), (2, None)], "doc_id long, text string")
        vocab = tfidf.fit_vocabulary(docs)
        plan = scoring.vectorise_text(docs, vocab)._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan
        assert int(spark.conf.get(key).rstrip("b")) <= 8 * 1024 * 1024
    finally:
        spark.conf.set(key, before.rstrip("b"))


def test_totals_of_a_slice_are_added_before_the_shuffle(spark):
    texts = ["aa bb aa bb cc", "bb aa", "", None, "cc cc cc"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    rows = tfidf.term_rows(docs.withColumn("doc_id", F.monotonically_increasing_id()))
    want = {r["term"]: (r["n"], r["d"]) for r in rows.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("d")).collect()}
    top = tfidf.top_terms(docs)
    assert {r["term"]: (r["ctf"], r["df"]) for r in top.collect()} == want
    words = tfidf._word_totals(spark.createDataFrame([(["aa", "aa"],)] * 50, "words array<string>").coalesce(1))
    assert "Generate" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_nll_opens_no_row(spark):
    scored = spark.createDataFrame(
        [([0.7, 0.2, 0.1], 0), ([0.1, 0.1, 0.8], 1), ([0.5, 0.5], 1), (None, 0), ([0.3, 0.3, 0.4], None), ([0.5, 0.5], 5)], "proba array<double>, y int"
    )
    grid = [0.05, 1.0, 3.0]
    out = cal.nll_by_temperature(scored, grid)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in out.collect():
        one = scored.agg(F.avg(cal.true_class_nll(F.col("proba"), F.col("y"), F.lit(r["t"]))).alias("nll")).first()
        assert r["nll"] == pytest.approx(one["nll"], rel=1e-9) and r["n"] == 6
    assert out.count() == 3 and cal.nll_by_temperature(scored.limit(0), grid).count() == 0
