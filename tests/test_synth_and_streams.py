"""Generated samples, streams, and the driver contract."""

import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilmark.fixed_values import BOUNDARY_TEXTS, STARTER_FILLERS, STARTER_PHRASES
from veilmark.operators import scoring, synth
from veilmark.plans import classify as run
from veilmark.plans.inputs import formula_layers
from veilmark.sources import registry
from veilmark.streaming import live


def test_generated_set_has_the_right_parts(spark):
    rows = synth.generate(spark, 30, 10).collect()
    labelled = [r for r in rows if r["label"] is not None]
    assert len(labelled) == 30 * 6 + len(BOUNDARY_TEXTS) and len(rows) - len(labelled) == 60
    again = synth.generate(spark, 30, 10).collect()
    assert [r["text"] for r in rows] == [r["text"] for r in again]
    other = synth.generate(spark, 30, 10, seed=7).collect()
    assert {r["text"] for r in rows} & {r["text"] for r in other} <= {t for t, _ in BOUNDARY_TEXTS}


def test_phrase_samples_hold_own_phrases(spark):
    ids = spark.range(600).select(F.col("id").alias("sample_id"), (F.col("id") % 6).cast("int").alias("label_idx"))
    s = synth.Sampler()
    noisy = 0
    for r in ids.select("label_idx", s.phrase_text().alias("text")).collect():
        text = r["text"].lower()
        own = sum(p.lower() in text for p in STARTER_PHRASES[r["label_idx"]])
        fill = sum(f.lower() in text for f in STARTER_FILLERS)
        noisy += any(p.lower() in text for k, ps in STARTER_PHRASES.items() if k != r["label_idx"] for p in ps)
        assert own >= 3 and 3 <= fill <= 5 and text.endswith(".") and r["text"][0] == r["text"][0].upper()
    assert 200 < noisy < 500


def test_modes_are_mixed(spark):
    ids = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit(0).alias("label_idx"))
    mode = ids.select(synth.Sampler().chance("mode").alias("m")).toPandas().m
    assert abs((mode < 0.4).mean() - 0.4) < 0.04 and abs((mode >= 0.8).mean() - 0.2) < 0.04


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"aa bb {i} cc") for i in range(40)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    model = scoring.Model("m", ["aa", "aa bb", "cc"], np.ones(3), formula_layers(3))
    stream = live.arriving(spark, str(tmp_path / "in"), rows.schema)
    got = live.drained(live.classify_stream(stream, model), "t")
    want = run.classify(rows, model)
    assert got.count() == 40 and got.exceptAll(want).count() == 0


def test_a_model_saved_meanwhile_takes_over_and_a_replay_adds_nothing(spark, tmp_path):
    folder, models = str(tmp_path), str(tmp_path / "models")
    rows = [spark.createDataFrame([(i, f"aa bb {i} cc") for i in some], "doc_id long, text string") for some in (range(30), range(30, 50))]
    used = [scoring.Model(f"m{k}", ["aa", "aa bb", "cc"], np.ones(3), formula_layers(3, shift=k)) for k in (0, 1)]
    stream = live.arriving(spark, f"{folder}/in/*", rows[0].schema)
    for k in (0, 1):
        registry.save_model(spark, used[k], models)
        rows[k].write.parquet(f"{folder}/in/{k}")
        got = live.classify_under_changing_models(stream, models, f"{folder}/out")
    shown = ["doc_id", "classification", "confidence", "model_hash"]
    want = [run.classify(r, m).withColumn("model_hash", F.lit(registry.content_hash(m))) for r, m in zip(rows, used)]
    both = want[0].select(shown).unionByName(want[1].select(shown))
    assert got.count() == 50 and got.select(shown).exceptAll(both).count() == 0
    # The first batch once more, as after a failure: the model that it began with, and no row twice.
    live._batch_writer(models, f"{folder}/out", "text")(rows[0], 0)
    again = spark.read.parquet(f"{folder}/out/rows").select(shown)
    assert again.count() == 50 and again.exceptAll(both).count() == 0
    assert live.classify_under_changing_models(stream, models, f"{folder}/out").count() == 50


def test_windows_close_after_the_watermark(spark, tmp_path):
    rows = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id*7 as int),0) AS ts, "
        "'PUBLIC' AS classification, id % 2 = 0 AS review_flag FROM range(60)"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.arriving(spark, str(tmp_path / "in"), rows.schema)
    got = sorted((r["start"].hour, r["n"]) for r in live.drained(live.level_windows(stream), "w").collect())
    # Last event at 06:53, watermark 06:43: the window from 06:00 stays open.
    assert got == [(0, 9), (1, 9), (2, 8), (3, 9), (4, 8), (5, 9)]


def test_contract(spark, sf):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(sql) == {"folder_scan", "train_logreg", "train_mlp", "selftrain_full"}
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and sum(r["n"] for r in rows) > 0


def test_queries_match_sql_on_the_smallest_tables(spark, sf):
    import sys

    sys.path.insert(0, "tools")
    import duckdb
    import pandas as pd
    from check import TABLES, canonical

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = entry.oracle_sql()
    for name in ("tfidf_vectors", "classify_log", "class_report", "policy_label", "html_text", "stratified_split", "selftrain_schedule", "synthetic_corpus"):
        df = entry.queries()[name](spark, sf)
        got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
        rel = db.execute(sql[name])
        want = pd.DataFrame(rel.fetchall(), columns=[c[0] for c in rel.description], dtype=object)
        assert canonical(got) == canonical(want), name
