"""Signal phrases: count them per level, take the best level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.fixed_values import LEVELS, STARTER_PHRASES
from veilmark.functions import text as tx
from veilmark.operators import automaton

#: Bound of what is sent along with the tasks.
MOST_PHRASES = 1_000_000
MOST_WORDS = 8_000_000


def starter_lexicon(spark: SparkSession) -> DataFrame:
    """``(label_idx, phrase)``; any table of this shape may be used instead."""
    rows = [(k, p) for k, phrases in STARTER_PHRASES.items() for p in phrases]
    return spark.createDataFrame(rows, "label_idx int, phrase string")


def normalised(lexicon: DataFrame) -> DataFrame:
    """``(label_idx, phrase, n)``: phrases as space-joined tokens with their length."""
    return (
        tx.with_words(lexicon, "phrase")
        .select("label_idx", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n"))
        .filter("n > 0")
        .distinct()
    )


def _counter(spark: SparkSession, rows: list[tuple[int, str]]):
    """Arrow UDF: tokens of a row -> occurrences of each level's phrases, overlapping ones too."""
    built = automaton.build([(k, p.split(" ")) for k, p in rows], len(LEVELS))
    # Plain arrays travel; the class goes with the function, so workers need not have the package.
    kind, shared = automaton.Automaton, spark.sparkContext.broadcast((built.tokens, built.keys, built.fail, built.counts, built.longest))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def count(words: pa.Array) -> pa.Array:
        found = kind(*shared.value).count(words)
        ends = np.arange(0, found.size + 1, len(LEVELS), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return count


def with_hits(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``hits``: for each of the six levels, how often its phrases occur.

    One narrow stage: a batch's tokens run through an automaton of all phrases, so the time does not depend on how many
    there are or how they overlap. Rows need no id, and equal rows are counted each on its own; ``id_col`` is not used.
    The automaton travels with the tasks, so phrases and their words are bounded by ``MOST_PHRASES`` and
    ``MOST_WORDS``; more is an error.
    """
    phrases = normalised(lexicon).limit(MOST_PHRASES + 1).collect()
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"a lexicon holds at most {MOST_PHRASES} phrases")
    if sum(r["n"] for r in phrases) > MOST_WORDS:
        raise ValueError(f"the phrases of a lexicon hold at most {MOST_WORDS} words")
    outside = {r["label_idx"] for r in phrases} - set(range(len(LEVELS)))
    if outside:
        raise ValueError(f"levels outside the list: {sorted(map(str, outside))}")
    count = _counter(df.sparkSession, [(r["label_idx"], r["phrase"]) for r in phrases])
    return tx.with_words(df, text, "_words").withColumn("hits", count("_words")).drop("_words")


def best_level(hits: Column) -> Column:
    """The level with most hits; the lower one on a tie; null without hits."""
    top = F.array_max(hits)
    return F.when(top > 0, (F.array_position(hits, top) - 1).cast("int"))
