"""A corpus pipeline in five stages over ``documents``.

Toxic texts go; one text of each group of near duplicates stays; secrets are masked; sources are
mixed to their target weights; what is left is encoded. Each stage works on all rows that the one before it kept, and
all but the last return the columns of ``documents``. A stage begins with letting go of the shuffles of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, group_join, mixing, secrets, toxicity
from veilmark.llm.common import fold, table
from veilmark.session import let_go, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxicity of 0.5 or more go. Labels are learnt outside fold 0, so their effect can be measured on it."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.learning_sample(docs, labels, fold("doc_id", 5) == 0))
    return toxicity.score(docs.select(*COLUMNS), model, COLUMNS).filter("score < 0.5").drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a word five-gram similarity of 0.75 the one with the smallest id stays."""
    let_go(spark)
    return group_join.one_of_each(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text become [SECRET]; every text stays."""
    let_go(spark)
    out = secrets.masked(docs.select(*COLUMNS), F.concat_ws("/", "source", "lang"), F.col("source"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; weights 1, 2, 3 in turn, at most three times a source."""
    let_go(spark)
    out = mixing.taken_texts(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's token ids and of the bytes they decode to."""
    let_go(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, block_bytes=12_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the model nor the encoding; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
