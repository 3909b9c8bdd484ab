"""Both scoring paths, calibration and persistence against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions import probability as pr
from veilmark.operators import calibration, evaluation, scoring, tfidf, training
from veilmark.plans import classify as run
from veilmark.plans.inputs import formula_layers
from veilmark.session import fresh_folder
from veilmark.sources import registry

TEXTS = ["aa bb cc", "aa aa aa dd", "", "qq ww", "bb cc dd ee ff aa bb", None]


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def vocab(docs):
    return tfidf.fit_vocabulary(docs.filter("doc_id <> 3"), max_features=9)


@pytest.fixture(scope="module", params=["relu", "logistic"])
def model(request, vocab):
    rows = vocab.orderBy("feature_idx").toPandas()
    return scoring.Model(
        "m", rows.term.tolist(), rows.idf.to_numpy(), formula_layers(len(rows)),
        activation=request.param, temperature=0.7,
    )


def dense_scores(docs, vocab, model):
    out = {}
    for r in tfidf.vectors(docs, vocab).collect():
        h = np.zeros(len(model.terms))
        h[r["idx"]] = r["val"]
        for k, (w, b) in enumerate(model.layers):
            h = h @ w + b
            if k < len(model.layers) - 1:
                h = np.maximum(h, 0) if model.activation == "relu" else 1 / (1 + np.exp(-h))
        out[r["doc_id"]] = softmax(h)
    return out


def test_arrow_and_join_paths_agree_with_numpy(docs, vocab, model):
    want = dense_scores(docs, vocab, model)
    for path in (scoring.score_text, scoring.score_by_join):
        got = {r["doc_id"]: r["proba"] for r in path(docs, model).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])
    row = evaluation.parity(scoring.score_text(docs, model), scoring.score_by_join(docs, model)).first()
    assert (row["n"], row["one_sided"], row["different"]) == (len(TEXTS), 0, 0)


def test_slabs_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 6, 50)
    rows = np.repeat(np.arange(50), counts)
    idx, val = rng.integers(0, 9, len(rows)), rng.random(len(rows))
    whole = scoring._forward(rows, idx, val, 50, formula_layers(9), "relu")
    for limit in (1, 17, 40, 100):
        monkeypatch.setattr(scoring, "_SLAB", limit)
        assert np.allclose(scoring._forward(rows, idx, val, 50, formula_layers(9), "relu"), whole)
    assert scoring._forward(rows[:0], idx[:0], val[:0], 0, formula_layers(9), "relu").shape == (0, 6)


def test_sql_function(spark, docs, model):
    run.register_sql(model, spark, "score_terms")
    scoring._with_terms(docs, "text").createOrReplaceTempView("term_lists")
    got = {r[0]: r[1] for r in spark.sql("SELECT doc_id, score_terms(_terms).pred FROM term_lists").collect()}
    assert got == {r["doc_id"]: r["pred"] for r in run.classify(docs, model).collect()}


def test_prediction_columns(docs, vocab, model):
    want = dense_scores(docs, vocab, model)
    for r in run.classify(docs, model).collect():
        cal = softmax(np.log(want[r["doc_id"]] + 1e-12) / 0.7)
        assert r["pred"] == cal.argmax()
        assert r["raw_confidence"] == pytest.approx(cal.max())
        assert r["review_flag"] == (cal.max() < 0.8)
        assert r["classification"] == model.classes[cal.argmax()]
    by_id = {r["doc_id"]: r["reasoning"] for r in run.classify(docs, model).collect()}
    assert by_id[2] == by_id[3] == by_id[5] == "No strong signals."
    assert by_id[0].startswith("Top signals: ") and by_id[4].count("(") == 5


def test_empty_text_can_be_rejected(docs, model):
    kept = run.classify(docs, model, on_empty="reject")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4]


def test_filter_on_scores_does_not_score_twice(docs, model):
    plan = run.classify(docs, model).filter("confidence > 0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [score(") == 1


def test_scoring_has_no_shuffle(docs, model):
    plan = run.classify(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_one_broken_row_is_null(spark, model, docs):
    broken = scoring.Model(**{**model.__dict__, "layers": [(w[:2], b) if k == 0 else (w, b) for k, (w, b) in enumerate(model.layers)]})
    rows = scoring.score_text(docs, broken).collect()
    assert any(r["pred"] is None for r in rows) and any(r["pred"] is not None for r in rows)
    assert all((r["pred"] is None) == bool(r["score_error"]) for r in rows)


def test_model_round_trip(spark, model, docs):
    folder = fresh_folder(spark, "model")
    registry.save_model(spark, model, folder)
    again = registry.load_model(spark, folder)
    assert (again.terms, again.activation, again.temperature) == (model.terms, model.activation, model.temperature)
    for (a, b), (c, d) in zip(model.layers, again.layers):
        assert np.array_equal(a, c) and np.array_equal(b, d)
    salience = [r["salience"] for r in registry.salience(registry.weight_rows(spark, model)).orderBy("in_idx").collect()]
    assert salience == pytest.approx(model.salience)


def test_argmax_takes_first_on_tie(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.45, 0.45],)], "p array<double>")
    assert [r[0] for r in df.select(pr.argmax(F.col("p"))).collect()] == [0, 1]


def test_temperature_is_recovered(spark):
    rng = np.random.default_rng(7)
    logits = rng.normal(size=(4000, 4)) * 2
    truth = [int(rng.choice(4, p=softmax(z / 2.5))) for z in logits]
    rows = [([float(x) for x in softmax(z)], y) for z, y in zip(logits, truth)]
    scored = spark.createDataFrame(rows, "proba array<double>, y int")
    grid = np.linspace(0.05, 10, 2000)

    def nll(t):
        z = np.log(np.array([p for p, _ in rows]) + 1e-12) / t
        z = z - z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(len(rows)), truth].clip(1e-12, 1)).mean()

    best = grid[int(np.argmin([nll(t) for t in grid]))]
    assert calibration.fit_temperature(scored) == pytest.approx(best, abs=0.02)
    got = {r["t"]: r["nll"] for r in calibration.nll_by_temperature(scored, [0.5, 2.0]).collect()}
    assert got == pytest.approx({0.5: nll(0.5), 2.0: nll(2.0)})


def test_network_weights_read_back(spark, docs, vocab):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    vecs = scoring.vectorise_text(docs, vocab).withColumn("y", F.col("doc_id") % 3)
    table = training.feature_table(vecs, vocab.count())
    sizes = [vocab.count(), 5, 3]
    fitted = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=sizes, maxIter=5, seed=1).fit(table)
    rows = vocab.orderBy("feature_idx").toPandas()
    model = scoring.Model("n", rows.term.tolist(), rows.idf.to_numpy(), training._layers(fitted.weights.toArray(), sizes), "logistic")
    want = {r["doc_id"]: list(r["probability"]) for r in fitted.transform(table).collect()}
    got = {r["doc_id"]: r["proba"] for r in scoring.score_text(docs, model).collect()}
    stored = {r[0]: r[1] for r in vecs.select("doc_id", scoring.vector_scorer(spark, model)("idx", "val")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k]) and stored[k] == pytest.approx(want[k])
