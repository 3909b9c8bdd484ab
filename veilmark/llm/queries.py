"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, collocations, group_join, kneser_ney, mixing, periodic_runs, pitman_yor, secrets, sharding
from veilmark.llm import substring_dedup, syncmers, topk, toxicity
from veilmark.llm.common import WORD, fold, table, word_count
from veilmark.session import written

#: Bytes a shard may hold; small, because the given tables are.
SHARD_BYTES = 1 << 20


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard of every document: hash prefix, depth, and the bytes the shard holds."""
    docs = table(spark, sf, "documents")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        sharding.hash_bits(F.col("doc_id")).alias("h"),
    )
    return sharding.shard(rows, SHARD_BYTES)


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that the mix takes, with its source's size and target."""
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("content"))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best other vectors of every twentieth vector."""
    vectors = topk.whole_vectors(table(spark, sf, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Base spans of every document, and those found through narrow ownership."""
    docs = table(spark, sf, "documents")
    found = secrets.find_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"), ["doc_id"])
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    join = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(join(base), 256).alias("base_sha256"),
        join("found").alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_sharding": op2_sharding,
    "op5_mixing": op5_mixing,
    "op8_topk": op8_topk,
    "op10_secrets": op10_secrets,
}


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document as digests, and the digest of what they decode to."""
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES["op6_bpe"] = op6_bpe


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts, perplexity and verdict of every document."""
    docs = table(spark, sf, "documents")
    grams = written(kneser_ney.count_ngrams(docs), "kn-grams")
    rows = kneser_ney.judged(written(kneser_ney.measured(docs, grams, kneser_ney.fit(grams)), "quality"))
    return rows.drop("lang")


QUERIES["op7_quality"] = op7_quality


def held_out_for_labels(column: str = "doc_id"):
    return fold(column, 5) == 0


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document; labels are learnt outside fold 0."""
    docs = table(spark, sf, "documents")
    model = toxicity.train(*toxicity.learning_sample(docs, table(spark, sf, "labels"), held_out_for_labels()))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out_for_labels().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op4_toxicity"] = op4_toxicity


def op3_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability of every document under the model learnt outside fold 2, and the add-one base."""
    docs = table(spark, sf, "documents").withColumn("learn", fold("doc_id", 7) != 2)
    return pitman_yor.score_texts(docs)


QUERIES["op3_pitman_yor"] = op3_pitman_yor


def op9_group_join(spark: SparkSession, sf: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return group_join.jaccard_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES["op9_group_join"] = op9_group_join


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of every document that an earlier document holds as well."""
    return substring_dedup.repeated_spans(table(spark, sf, "documents"))


QUERIES["op1_substring_dedup"] = op1_substring_dedup


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES["pipeline"] = pipeline


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best collocations of every language, from exact counts over all texts."""
    return collocations.collocations(table(spark, sf, "documents"))


QUERIES["op11_collocations"] = op11_collocations


def with_planted_run(docs: DataFrame) -> DataFrame:
    """Texts whose id hashes to a multiple of ten repeat a stretch of their words to the end; null ids are left alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, chosen = F.floor(h / 10), F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"), g.alias("g"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), turns)), F.lit(1), n - F.col("a"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of every document: their number, the one with most periods, and digests of all and of what stays."""
    rows = periodic_runs.find_runs(with_planted_run(table(spark, sf, "documents")))
    none = F.get("runs", F.size("runs"))
    more = lambda r, s: F.coalesce(r["length"] * s["period"] > s["length"] * r["period"], F.lit(True))
    rows = rows.withColumn("best", F.reduce("runs", none, lambda s, r: F.when(more(r, s), r).otherwise(s)))
    ordered = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(ordered, line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES["op12_runs"] = op12_runs


def op13_syncmers(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they and the next document's are."""
    rows = syncmers.compared(table(spark, sf, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES["op13_syncmers"] = op13_syncmers
