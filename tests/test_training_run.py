"""The network's gradient and training, the feature table, staged readers, and the run as a whole."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.operators import calibration, network, scoring, tfidf
from veilmark.plans import classify, training_run
from veilmark.sources import files, readers
from veilmark.sources.feature_table import FeatureTable

WORDS = [["alpha", "beta", "gamma"], ["delta", "epsilon", "zeta"], ["eta", "theta", "iota"]]


def make(rng, n, classes=3, first=0):
    rows = []
    for i in range(n):
        y = int(rng.integers(classes))
        own = [str(rng.choice(WORDS[y])) for _ in range(6)] + [str(rng.choice(WORDS[(y + 1) % classes])) for _ in range(2)]
        rows.append((first + i, " ".join(rng.permutation(own)) + f" n{i % 40}", y))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(make(np.random.default_rng(1), 240), "doc_id long, text string, y int").repartition(3).cache()


@pytest.fixture(scope="module")
def vocab(labelled):
    return tfidf.fit_vocabulary(labelled)


@pytest.fixture(scope="module")
def vectors(labelled, vocab):
    return scoring.vectorise_text(labelled, vocab).cache()


def dense_gradient(rows, layers):
    """Loss and gradient by textbook formulas on a dense matrix, one row after another."""
    grads = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    loss = 0.0
    for r in rows:
        x = np.zeros(layers[0][0].shape[0])
        x[r["idx"]] = r["val"]
        acts, zs = [x], []
        for k, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            zs.append(z)
            acts.append(np.maximum(z, 0) if k < len(layers) - 1 else np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        loss -= np.log(acts[-1][r["y"]])
        d = acts[-1].copy()
        d[r["y"]] -= 1
        for k in range(len(layers) - 1, -1, -1):
            grads[k][0][...] += np.outer(acts[k], d)
            grads[k][1][...] += d
            if k:
                d = (layers[k][0] @ d) * (zs[k - 1] > 0)
    return loss, grads


@pytest.mark.parametrize("parts,slots", [(1, 1), (5, 3), (11, 8)])
def test_gradient_equals_numpy(vectors, vocab, parts, slots):
    layers = network.initial_layers([vocab.count(), 256, 128, 3], 7)
    rows = vectors.withColumn("held", F.col("doc_id") % 7 == 0).repartition(parts)
    total = network.summed_gradient(rows, layers, slots)
    kept = [r for r in rows.collect() if not r["held"]]
    loss, want = dense_gradient(kept, layers)
    assert total.rows == len(kept) and total.rows + total.held == 240 and total.loss == pytest.approx(loss, abs=1e-9)
    for (g, h), (a, b) in zip(total.layers, want):
        assert np.abs(g - a).max() < 1e-9 and np.abs(h - b).max() < 1e-9
    l2 = 0.3
    mean, slopes = network.mean_gradient(total, layers, l2)
    assert mean == pytest.approx(loss / len(kept) + 0.5 * l2 * sum((w * w).sum() for w, _ in layers) / len(kept))
    assert np.allclose(slopes[1][0], (want[1][0] + l2 * layers[1][0]) / len(kept), atol=1e-12)


def test_gradient_of_kept_blocks_takes_one_stage(spark, vectors, vocab, monkeypatch):
    monkeypatch.setattr(network, "_BLOCK", 16)
    layers = network.initial_layers([vocab.count(), 32, 16, 3], 7)
    rows = vectors.withColumn("held", F.col("doc_id") % 7 == 0)
    blocks = network.kept_blocks(rows, 3).union(network.kept_blocks(rows.filter("held"), 2))
    assert sum(blocks.map(lambda payload: 1).collect()) >= 18
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("a step", "one gradient")
    total = network.batch_gradient(blocks, layers)
    jobs = seen.getJobIdsForGroup("a step")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = network.summed_gradient(rows, layers, 2)
    assert len(jobs) == 1
    assert (total.rows, total.held, total.held_right) == (want.rows, 2 * want.held, 2 * want.held_right)
    assert total.loss == pytest.approx(want.loss, abs=1e-9)
    for mine, other in zip(total.layers, want.layers):
        assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(mine, other))


def test_adam_by_hand():
    layers = [(np.array([[1.0]]), np.array([0.5]))]
    adam = network.Adam(rate=0.1)
    m = v = 0.0
    w = 1.0
    for t, g in enumerate((0.2, -0.4, 0.1), 1):
        layers = adam.moved(layers, [(np.array([[g]]), np.array([0.0]))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        assert layers[0][0][0, 0] == pytest.approx(w, abs=1e-12) and layers[0][1][0] == 0.5


def test_training_learns_stops_and_scores(spark, labelled, vectors, vocab):
    model, epochs = network.train_relu(vectors, vocab, 3, hidden=(256, 128), epochs=12, rows_per_batch=64, patience=3)
    assert [b.loss < a.loss for a, b in zip(epochs, epochs[1:])].count(True) >= len(epochs) - 2 and epochs[-1].loss < epochs[0].loss / 2
    assert [w.shape for w, _ in model.layers] == [(vocab.count(), 256), (256, 128), (128, 3)] and model.activation == "relu"
    done = classify.classify(labelled, model)
    right = done.filter(F.col("pred") == F.col("y")).count()
    assert right > 220 and done.count() == 240
    again, _ = network.train_relu(vectors, vocab, 3, hidden=(256, 128), epochs=2, rows_per_batch=300, start=model.layers)
    assert not np.array_equal(again.layers[0][0], network.initial_layers([vocab.count(), 256, 128, 3], 42)[0][0])
    with pytest.raises(ValueError):
        network.train_relu(vectors, vocab, 3, hidden=(8, 4), start=model.layers)
    one, runs = network.train_relu(vectors.limit(0), vocab, 3, hidden=(8, 4))
    assert len(runs) == 1 and runs[0].rows == 0 and one.layers[0][0].shape == (vocab.count(), 8)


def test_batches_hold_every_row_once_and_copies_on_one_side(vectors):
    twice = vectors.unionByName(vectors).withColumn("y", F.when(F.col("doc_id") == 5, None).otherwise(F.col("y")))
    stored, batches = network.stored_batches(twice, 100, 0.2, 3)
    rows = stored.collect()
    assert len(rows) == 478 and len(batches) == 5 and {r["batch"] for r in rows} == {-1, *batches}
    sides = {}
    for r in rows:
        sides.setdefault((tuple(r["idx"]), tuple(r["val"])), set()).add(r["held"])
    assert all(len(s) == 1 for s in sides.values()) and 20 < sum(r["held"] for r in rows) < 200


def scanned(df):
    """Folders that the texts of a plan are read from."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line and "text:string" in line]


def test_a_second_round_reads_no_text_of_the_first(spark, labelled, vocab, tmp_path):
    table = FeatureTable(spark, str(tmp_path))
    odd = spark.createDataFrame([(900, None, 1), (901, "", 1), (902, "alpha beta", 2), (903, "alpha beta", 0)], labelled.schema)
    table.arrive(labelled.withColumn("key", F.lit("mine")), "one")
    tag, first = table.update(vocab)
    table.arrive(odd.withColumn("key", F.lit("mine")), "two")
    table.arrive(labelled.limit(0), "two")
    fresh = table.fresh(tag)
    reads = scanned(fresh)
    assert reads and all("arrival" in line and "[two]" in line or "(two)" in line or "= two" in line for line in reads), reads
    assert sorted(r["text"] for r in fresh.collect()) == ["", "alpha beta"]
    got = table.vectors(vocab)
    assert got.filter(F.col("run") == first).count() == 240 and got.count() == 244 and "key" in got.columns
    whole = {r["doc_id"]: (r["idx"], r["val"]) for r in scoring.vectorise_text(labelled.unionByName(odd.fillna("", "text")), vocab).collect()}
    assert {r["doc_id"]: (r["idx"], r["val"]) for r in got.collect()} == whole
    assert table.fresh(tag).count() == 0 and not scanned(table.fresh(tag))
    assert table.vectors(vocab).count() == 244
    other = tfidf.fit_vocabulary(odd.fillna("", "text"))
    assert table.vectors(other).select("run").distinct().count() == 1
    with pytest.raises(ValueError):
        table.arrive(labelled.withColumn("arrival", F.lit(1)), "three")


def test_the_whole_run(spark, labelled, tmp_path):
    rng = np.random.default_rng(9)
    pool = spark.createDataFrame(make(rng, 150, first=1000), "doc_id long, text string, y int")
    run = training_run.training_run(
        spark, labelled, pool.drop("y"), str(tmp_path), 3, rounds=2, first_epochs=25, round_epochs=4, hidden=(32, 16), rate=0.01, rows_per_batch=500
    )
    rows = training_run.summary(run).orderBy("round").collect()
    assert [r["round"] for r in rows] == [0, 1, 2] and [r["percent"] for r in rows] == [None, 80, 70]
    assert rows[1]["accepted"] + rows[1]["left"] == 150 and rows[2]["accepted"] + rows[2]["left"] == rows[1]["left"]
    assert rows[1]["accepted"] >= 30 and run.taken.count() == rows[1]["accepted"] + rows[2]["accepted"]
    assert run.taken.select("doc_id").distinct().count() == run.taken.count() and rows[-1]["accuracy"] > 0.8
    assert run.comparison().first()["n"] == run.validation.count() == rows[0]["validation"]
    loaded = run.saved("self_trained")
    assert loaded.temperature == run.phases[-1].model.temperature and np.array_equal(loaded.layers[0][0], run.phases[-1].model.layers[0][0])
    assert run.saved("supervised").name == "supervised"


def counting(folder, name, answer):
    """A reader that leaves a file for every call."""

    def read(data):
        with open(os.path.join(folder, f"{name}-{data.decode()}-{os.urandom(4).hex()}"), "w"):
            pass
        return answer(data.decode())

    return readers.from_function(name, read)


def test_the_second_reader_sees_unresolved_rows_only(spark, tmp_path):
    long = "a text that is long enough"

    def first(key):
        if key == "locked":
            return readers.Refused("encrypted", "Password-protected")
        if key in ("broken", "never"):
            raise OSError("no such page")
        return {"good": long, "short": "tiny", "blank": "", "none": None}[key]

    def second(key):
        if key == "never":
            raise ValueError("worse")
        return long.upper() if key in ("short", "broken") else " " * 30

    keys = ["good", "locked", "broken", "never", "short", "blank", "none"]
    rows = spark.createDataFrame([(bytearray(k.encode()), k) for k in keys] + [(None, "null")], "content binary, _stage string").repartition(3)
    chain = [counting(str(tmp_path), "one", first), counting(str(tmp_path), "two", second)]
    done = readers.read_in_stages(rows, "content", chain)
    assert done.columns == ["content", "_stage", "outcome"]
    got = {r["_stage"]: tuple(r["outcome"]) for r in done.collect()}
    assert got["good"] == (long, "ok", None, "one") and got["locked"] == (None, "encrypted", "Password-protected", "one")
    assert got["short"] == got["broken"] == (long.upper(), "ok", None, "two")
    assert got["never"] == (None, "extraction_failed", "ValueError: worse", None)
    assert got["blank"] == got["none"] == got["null"] == (None, "no_text_layer", readers.NO_TEXT, None)
    calls = sorted(name.rsplit("-", 1)[0] for name in os.listdir(tmp_path))
    assert calls == sorted([f"one-{k}" for k in keys] + [f"two-{k}" for k in ("broken", "never", "short", "blank", "none")])


def test_a_chain_for_a_suffix(spark, tmp_path):
    one = readers.from_function("one", lambda data: readers.Refused("encrypted", "locked") if data.startswith(b"E") else "")
    two = readers.from_column("two", lambda content: content.cast("string"))
    rows = [("/a/x.pdf", b"E rest of the file which is long", 30), ("/a/y.pdf", b"readable text of some length", 30), ("/a/z.PDF", b"no", 2), ("/a/t.txt", b"plain", 5), ("/a/u.bin", b"?", 1)]
    df = spark.createDataFrame([(p, bytearray(c), n) for p, c, n in rows], "path string, content binary, length long")
    got = {r["filename"]: (r["extraction_status"], r["text"]) for r in files.extract(df, readers={".pdf": [one, two]}).collect()}
    assert got == {
        "x.pdf": ("encrypted", None), "y.pdf": ("ok", "readable text of some length"), "z.PDF": ("no_text_layer", None),
        "t.txt": ("ok", "plain"), "u.bin": ("unsupported_format", None),
    }


def test_the_fitted_temperature_is_used(spark, vectors, vocab):
    model, _ = network.train_relu(vectors, vocab, 3, hidden=(16, 8), epochs=3, rate=0.01)
    score = scoring.vector_scorer(spark, model)
    scored = vectors.select("y", score("idx", "val").alias("proba"))
    assert calibration.LOW <= calibration.fit_temperature(scored) <= calibration.HIGH
