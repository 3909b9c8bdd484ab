"""Rows with nulls, empty and long texts, repeats, and extra columns with clashing names."""

import random

from pyspark.sql import functions as F

CLASHES = ["key", "size", "bucket", "block", "n", "target", "cls", "comp", "h", "score", "row_key", "content", "taken", "bytes", "learn", "shard"]


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "ünïcode", "it's", "x1", "zeta,", "eta.", "theta"] + [f"w{i}" for i in range(200)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = [make(rng.randint(1, 90)) for _ in range(n)]
    base = make(80)
    near = base.split()
    near[7] = "changed"
    out += [base, base, " ".join(near), base.upper(), "", " \t\n", None, None, "a" * 9_000, make(6_000), "one two three", "one two  three"]
    out += ["line of text\nline of text\n\n\nother line", "日本語 テキスト 🙂 done\r\nnext", "a b a b a b a b a b"]
    return out


def documents(spark, n=60):
    """A table like ``documents`` with every odd case."""
    rows = []
    for i, t in enumerate(texts(n=n)):
        source = None if i % 11 == 0 else f"src{i % 3 if i % 2 else 0}"
        rows.append((None if i in (5, 6) else i, t, None if i % 13 == 0 else "en", source, None if t is None else len(t)))
    rows += [rows[1]] * 3 + [rows[8], rows[-2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("extra").alias(c) for c in CLASHES)).repartition(3)


def empty(spark):
    return documents(spark, n=1).limit(0)


def labels(spark):
    rows = [(i, 1, int(i % 5 == 0)) for i in range(70)] + [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
