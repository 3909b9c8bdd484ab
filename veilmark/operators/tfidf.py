"""TF-IDF over unigrams and bigrams: vocabulary, weights, unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import text as tx
from veilmark.functions.lists import slices
from veilmark.session import broadcast_if_small, written

MAX_FEATURES = 5000
# A vocabulary up to this size is held on the driver, a larger one in the work folder.
_LOCAL_ROWS = 200_000
_TOTALS = "term string, ctf long, df long"


def counted_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by ``counts``: distinct terms of the row with counts."""
    rows = tx.with_words(df, text).withColumn("_terms", tx.terms(F.col("words")))
    return tx.with_counts(rows, "_terms").drop("_terms", "words", text)


def term_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and distinct term: the other columns, ``term``, ``tf``."""
    counted = counted_terms(df, text)
    kept = [c for c in counted.columns if c != "counts"]
    return opened(counted, *kept)


def opened(df: DataFrame, *kept: str) -> DataFrame:
    """One row per element of ``counts``.

    ``inline`` would let the optimizer push its "array is not empty" test below
    the projections that build the array, and so evaluate the tokeniser again for
    each element; the outer form has no such test.
    """
    return df.select(*kept, F.inline_outer("counts")).filter(F.col("term").isNotNull())


def _totals_of(rows: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each of ``n`` things, and the rows that hold it, from the row and the number of every occurrence."""
    key, tf = np.unique(rows.astype(np.int64) * max(n, 1) + found, return_counts=True)
    at = key % max(n, 1)
    return np.bincount(at, tf, minlength=n).astype(np.int64), np.bincount(at, minlength=n)


def _word_totals(docs: DataFrame) -> DataFrame:
    """``(term, ctf, df)`` of every word of ``(words)``: each slice of rows is added up in its task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                coded = part.flatten().dictionary_encode()
                rows = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
                totals = _totals_of(rows, coded.indices.to_numpy(), len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, totals)], ["term", "ctf", "df"])

    return _added(docs.select("words").mapInArrow(work, _TOTALS))


def _pair_totals(docs: DataFrame, frequent: list[str] | None) -> DataFrame:
    """The same of the pairs of neighbours; of those of two ``frequent`` words, if such are named."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent and pa.array(frequent, pa.string()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                flat, names = part.flatten(), shared.value
                if names is None:
                    coded = flat.dictionary_encode()
                    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                else:
                    code = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
                rows = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
                near = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (rows[:-1] == rows[1:]))
                pairs, found = np.unique(code[near] * len(names) + code[near + 1], return_inverse=True)
                if not len(pairs):
                    continue
                terms = pc.binary_join_element_wise(names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), " ")
                yield pa.RecordBatch.from_arrays([terms, *map(pa.array, _totals_of(rows[near], found, len(pairs)))], ["term", "ctf", "df"])

    return _added(docs.select("words").mapInArrow(work, _TOTALS))


def _added(totals: DataFrame) -> DataFrame:
    return totals.groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))


def _ranked(totals: DataFrame, size: int) -> DataFrame:
    return totals.orderBy(F.desc("ctf"), "term").limit(size)


def top_terms(df: DataFrame, text: str = "text", max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms with corpus count and document count.

    Most distinct terms of a large corpus are rare bigrams, and shuffling them
    all only to keep a few thousand is the costliest step there is. So words are
    counted first. Let ``c`` be the count of the last word in the word-only top
    list: a term below ``c`` cannot be in the final list, and a bigram is never
    more frequent than either of its words. Bigrams with a word below ``c``
    are therefore dropped before the shuffle. The result is exact.
    """
    docs = tx.with_words(df.select(F.col(text).alias("_text")), "_text").select("words")
    words = _word_totals(docs).persist()
    leaders = _ranked(words, max_features).agg(F.count(F.lit(1)).alias("n"), F.min("ctf").alias("c")).first()
    floor = leaders["c"] if leaders["n"] == max_features else 1

    frequent = words.filter(F.col("ctf") >= floor).select(F.col("term").alias("word"))
    few = [r["word"] for r in frequent.limit(_LOCAL_ROWS + 1).collect()] if floor > 1 else []
    pairs = _pair_totals(docs, few if 0 < len(few) <= _LOCAL_ROWS else None)
    if len(few) > _LOCAL_ROWS:
        for part in (1, -1):
            pairs = pairs.join(frequent, F.substring_index("term", " ", part) == F.col("word"), "left_semi")
    totals = words.unionByName(pairs).filter(F.col("ctf") >= floor)
    best = _kept(_ranked(totals, max_features), max_features)
    words.unpersist()
    return best


def _kept(table: DataFrame, rows: int) -> DataFrame:
    """Materialise a table of at most ``rows`` rows: on the driver if that is few."""
    if rows > _LOCAL_ROWS:
        return written(table, "vocabulary")
    return table.sparkSession.createDataFrame(table.toPandas(), table.schema)


def smooth_idf(df: Column, n_docs: int | Column) -> Column:
    """``ln((1 + n) / (1 + df)) + 1``"""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def fit_vocabulary(
    df: DataFrame, text: str = "text", max_features: int = MAX_FEATURES
) -> DataFrame:
    """The vocabulary table: term, feature index (term order), counts, idf.

    The table never has more than ``max_features`` rows, which also bounds what is
    broadcast from it.
    """
    n_docs = df.count()
    best = top_terms(df, text, max_features)
    numbered = best.withColumn(
        "feature_idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")
    ).withColumn("idf", smooth_idf(F.col("df"), n_docs))
    return _kept(numbered.select("term", "feature_idx", "ctf", "df", "idf"), max_features)


def vectors(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``idx`` and ``val`` arrays, L2 norm 1.

    Unknown terms fall out of a left join with the broadcast vocabulary, so a
    document without any known term keeps its row, with empty arrays. Only the
    id and the pairs (index, weight) are shuffled.
    """
    counted = counted_terms(df.select(id_col, text), text)
    pairs = counted.select(id_col, F.inline_outer("counts"))
    weight = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    entry = F.when(
        F.col("feature_idx").isNotNull(),
        F.struct(F.col("feature_idx").alias("i"), weight.alias("w")),
    )
    grouped = (
        pairs.join(broadcast_if_small(vocab.select("term", "feature_idx", "idf")), "term", "left")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
    )
    return grouped.select(id_col, F.col("e.i").alias("idx"), unit(F.col("e.w")).alias("val"))


def unit(values: Column) -> Column:
    """Divide an array by its L2 norm. The norm is an argument of ``zip_with``, so it
    is computed once per row and not once per element."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.zip_with(values, F.array_repeat(norm, F.size(values)), lambda x, n: x / n)


def long_vectors(vecs: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sparse long form: one row per document and known term."""
    flat = vecs.select(id_col, F.inline_outer(F.arrays_zip("idx", "val"))).toDF(
        id_col, "feature_idx", "x"
    )
    return flat.join(broadcast_if_small(vocab.select("feature_idx", "term")), "feature_idx").select(
        id_col, "term", "feature_idx", "x"
    )
