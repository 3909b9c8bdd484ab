"""The SQL table functions against the DataFrame form."""

import numpy as np
from pyspark.sql import functions as F

from veilmark.operators import scoring
from veilmark.plans import classify, sql_surface
from veilmark.plans.inputs import formula_layers

TERMS = ["aa", "aa bb", "bb", "cafe", "ecole", "ss", "x1"]
TEXTS = ["aa bb", "aa bb", "Café ÉCOLE aa", None, "", "ﬁn ½ ſs ß ΑΣ İx1 X1", "a b c", "bb " * 5_000, "日本 aa"]


def test_functions_equal_the_dataframe_form(spark):
    model = scoring.Model("m", TERMS, np.linspace(1, 2, len(TERMS)), formula_layers(len(TERMS)), temperature=0.3)
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "key long, words string").repartition(3)
    rows.createOrReplaceTempView("some_texts")
    sql_surface.register(spark, model, "label_text", "why_text")
    got = spark.sql("SELECT * FROM label_text(TABLE(SELECT key, words FROM some_texts))")
    want = classify.classify(rows, model, "words")
    shown = ["classification", "review_flag", "reasoning", "policy_version"]
    a = sorted(((r["id"], *(r[c] for c in shown), round(r["confidence"], 4)) for r in got.collect()), key=repr)
    b = sorted(((r["key"], *(r[c] for c in shown), r["confidence"]) for r in want.collect()), key=repr)
    assert a == b and len(a) == len(TEXTS)
    lines = spark.sql("SELECT id, rank, term, round(weight, 9) AS weight FROM why_text(TABLE(SELECT key, words FROM some_texts))")
    opened = scoring.score_text(rows, model, "words").select(F.col("key").alias("id"), F.posexplode("signals").alias("rank", "s"))
    opened = opened.select("id", "rank", "s.term", F.round("s.weight", 9).alias("weight"))
    assert lines.count() == opened.count() > 5 and lines.exceptAll(opened).count() == 0
    assert spark.sql("SELECT * FROM label_text(TABLE(SELECT key, words FROM some_texts WHERE key > 99))").count() == 0
