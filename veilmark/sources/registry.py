"""Models as tables: vocabulary, weights, biases and a one-row manifest."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.scoring import Model


def vocabulary_hash(vocab: DataFrame) -> DataFrame:
    """One row ``(sha8)``: first 8 hex digits of SHA-256 over the vocabulary rows.

    At most the vocabulary cap's number of rows meet in the one string.
    """
    row = F.concat_ws("|", F.col("feature_idx"), F.col("term"), F.col("ctf"), F.col("df"))
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("feature_idx").alias("i"), row.alias("s")))),
        lambda x: x["s"],
    )
    return vocab.agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 8).alias("sha8"))


def content_hash(model: Model) -> str:
    """First 16 hex digits of SHA-256 over everything that decides a prediction."""
    digest = hashlib.sha256()
    say = lambda x: digest.update(repr(x).encode() + b"\n")
    for part in (model.name, model.activation, float(model.temperature), list(model.classes), model.policy_version, float(model.review_threshold)):
        say(part)
    for term, weight in zip(model.terms, model.idf):
        say((term, float(weight)))
    for weight, bias in model.layers:
        say(weight.shape)
        digest.update(np.ascontiguousarray(weight, dtype="<f8").tobytes())
        digest.update(np.ascontiguousarray(bias, dtype="<f8").tobytes())
    return digest.hexdigest()[:16]


def weight_rows(spark: SparkSession, model: Model) -> DataFrame:
    """``(layer, in_idx, w array<double>)``, one row per input unit."""
    rows = [
        (k, i, [float(x) for x in weight[i]])
        for k, (weight, _) in enumerate(model.layers)
        for i in range(weight.shape[0])
    ]
    return spark.createDataFrame(rows, "layer int, in_idx int, w array<double>")


def salience(weights: DataFrame) -> DataFrame:
    """``(in_idx, salience)``: sum of absolute first-layer weights per input."""
    return weights.filter("layer = 0").select(
        "in_idx",
        F.aggregate("w", F.lit(0.0), lambda acc, x: acc + F.abs(x)).alias("salience"),
    )


def manifest_row(spark: SparkSession, model: Model, sha8: str) -> DataFrame:
    row = [(
        model.name, f"vocab.{sha8}", model.activation, float(model.temperature),
        list(model.classes), model.policy_version, float(model.review_threshold), sha8,
    )]
    return spark.createDataFrame(
        row,
        "model string, vectorizer string, activation string, temperature double, "
        "classes array<string>, policy_version string, review_threshold double, content_hash string",
    )


def vocab_rows(spark: SparkSession, model: Model) -> DataFrame:
    rows = [
        (t, i, float(w), float(s))
        for i, (t, w, s) in enumerate(zip(model.terms, model.idf, model.salience))
    ]
    return spark.createDataFrame(rows, "term string, feature_idx int, idf double, coef_weight double")


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether an earlier write of this folder came to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def save_model(spark: SparkSession, model: Model, folder: str) -> str:
    """Store a model below ``folder`` and return its content hash.

    Its tables lie in folders named by the hash: one that is complete is used again, one left by a
    broken write is written anew. The manifest comes last, so a reader never sees half a model.
    """
    tag = content_hash(model)
    base = folder.rstrip("/")
    biases = [(k, [float(x) for x in b]) for k, (_, b) in enumerate(model.layers)]
    tables = {
        "vocab": vocab_rows(spark, model),
        "weights": weight_rows(spark, model),
        "bias": spark.createDataFrame(biases, "layer int, b array<double>"),
    }
    for name, rows in tables.items():
        path = f"{base}/{name}.{tag}"
        if not _complete(spark, path):
            rows.write.mode("overwrite").parquet(path)
    manifest_row(spark, model, tag).write.mode("overwrite").parquet(f"{base}/manifest")
    return tag


def load_model(spark: SparkSession, folder: str, manifest: str | None = None) -> Model:
    """The model that ``folder`` names now, or the one of a ``manifest`` kept elsewhere."""
    base = folder.rstrip("/")
    m = spark.read.parquet(manifest or f"{base}/manifest").first()
    tag = m["content_hash"]
    vocab = spark.read.parquet(f"{base}/vocab.{tag}").orderBy("feature_idx").toPandas()
    weights = spark.read.parquet(f"{base}/weights.{tag}").orderBy("layer", "in_idx").toPandas()
    bias = spark.read.parquet(f"{base}/bias.{tag}").orderBy("layer").toPandas()
    layers = [
        (np.stack(weights[weights.layer == k].w.to_list()), np.asarray(b))
        for k, b in zip(bias.layer, bias.b)
    ]
    return Model(
        name=m["model"], terms=vocab.term.tolist(), idf=vocab.idf.to_numpy(), layers=layers,
        activation=m["activation"], temperature=m["temperature"], classes=list(m["classes"]),
        review_threshold=m["review_threshold"], policy_version=m["policy_version"],
    )
