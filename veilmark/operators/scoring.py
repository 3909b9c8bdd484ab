"""Forward pass of a small dense network over sparse documents, with explanations.

Two paths give the same numbers: ``score_text`` (no shuffle; Arrow batches and
NumPy against broadcast weights) for production, and ``score_by_join`` (joins and
sums only) as the relational form.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.fixed_values import LEVELS, POLICY_VERSION, REVIEW_THRESHOLD, TOP_SIGNALS
from veilmark.functions import probability as pr
from veilmark.functions import text as tx
from veilmark.functions.lists import slices
from veilmark.operators import tfidf


_SLAB = 2_000_000


@dataclass(frozen=True)
class Model:
    """Vocabulary, dense layers, temperature and policy parameters.

    Its size is bounded by the vocabulary cap times the layer widths and does
    not depend on the corpus, so it is safe to broadcast.
    """

    name: str
    terms: list[str]
    idf: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str = "relu"
    temperature: float = 1.0
    classes: list[str] = field(default_factory=lambda: list(LEVELS))
    review_threshold: float = REVIEW_THRESHOLD
    policy_version: str = POLICY_VERSION

    @property
    def salience(self) -> np.ndarray:
        """Sum of absolute first-layer weights per input term."""
        return np.abs(self.layers[0][0]).sum(axis=1)

    def with_temperature(self, temperature: float) -> "Model":
        return replace(self, temperature=float(temperature))


VECTOR = T.StructType(
    [
        T.StructField("idx", T.ArrayType(T.IntegerType())),
        T.StructField("val", T.ArrayType(T.DoubleType())),
    ]
)
SCORE = T.StructType(
    [
        T.StructField("proba", T.ArrayType(T.DoubleType())),
        T.StructField("pred", T.IntegerType()),
        T.StructField("raw_confidence", T.DoubleType()),
        T.StructField(
            "signals",
            T.ArrayType(
                T.StructType(
                    [T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]
                )
            ),
        ),
    ]
)

_SCORE_ARROW = pa.struct(
    [
        ("proba", pa.list_(pa.float64())),
        ("pred", pa.int32()),
        ("raw_confidence", pa.float64()),
        ("signals", pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))),
    ]
)
SCORE_OR_ERROR = T.StructType([*SCORE.fields, T.StructField("score_error", T.StringType())])


def _offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int32))


def _as_lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    ends = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def _list_rows(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())


def _by_slices(lists: pa.ListArray, work) -> pa.Array:
    parts = [work(part) for part in slices(lists)]
    return pa.concat_arrays(parts) if parts else work(lists)


def _weigh(tokens: pa.ListArray, known: pa.Array, idf: np.ndarray):
    """Rows, term indices and unit-norm TF-IDF values of a batch of term lists."""
    flat = pc.index_in(tokens.flatten(), value_set=known)
    hit = flat.is_valid().to_numpy(zero_copy_only=False)
    return _weights(_list_rows(tokens)[hit], flat.drop_null().to_numpy(), len(tokens), idf)


def _weights(rows: np.ndarray, found: np.ndarray, n: int, idf: np.ndarray):
    """The same from the row and the term index of every occurrence of a known term."""
    key, tf = np.unique(rows.astype(np.int64) * len(idf) + found, return_counts=True)
    rows, idx = key // max(len(idf), 1), key % max(len(idf), 1)
    val = (1.0 + np.log(tf)) * idf[idx]
    norm = np.sqrt(np.bincount(rows, val * val, minlength=n))
    return rows, idx, val / norm[rows]


def _word_table(terms: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """What finds the terms in a list of words without making the pairs of neighbours as strings.

    The distinct words of the terms; the term that is such a word alone, with a last place for words of no term; the pairs of
    word numbers that are terms, in order, and these terms. The first of equal terms counts.
    """
    number: dict[str, int] = {}
    alone: dict[int, int] = {}
    pairs: dict[tuple[int, int], int] = {}
    for k, term in enumerate(terms):
        parts = [number.setdefault(w, len(number)) for w in term.split(" ")]
        if len(parts) == 1:
            alone.setdefault(parts[0], k)
        elif len(parts) == 2:
            pairs.setdefault((parts[0], parts[1]), k)
    single = np.full(len(number) + 1, -1, np.int64)
    single[list(alone)] = list(alone.values())
    keys = np.array([a * len(number) + b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    end = np.iinfo(np.int64).max
    return pa.array(list(number), pa.string()), single, np.append(keys[order], end), np.append(np.array(list(pairs.values()), np.int64)[order], -1)


def _weigh_words(words: pa.ListArray, table, idf: np.ndarray):
    """:func:`_weigh` of the words and their pairs of neighbours, from the words alone."""
    known, single, pairs, paired = table
    code = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
    row = _list_rows(words)
    own = single[code]
    near = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
    key = code[near] * len(known) + code[near + 1]
    at = np.searchsorted(pairs, key)
    hit = pairs[at] == key
    rows = np.concatenate([row[own >= 0], row[near[hit]]])
    return _weights(rows, np.concatenate([own[own >= 0], paired[at[hit]]]), len(words), idf)


def _forward(rows, idx, val, n, layers, activation) -> np.ndarray:
    """Class probabilities of ``n`` sparse rows.

    Works through slabs of rows, so that the gathered first-layer weights stay
    near ``_SLAB`` numbers however long the documents are.
    """
    ends = np.cumsum(np.bincount(rows, minlength=n))
    room = max(_SLAB // layers[0][0].shape[1], 1)
    parts, a, at = [], 0, 0
    while a < n:
        b = min(max(int(np.searchsorted(ends, at + room, side="right")), a + 1), n)
        to = int(ends[b - 1])
        parts.append(_slab(rows[at:to] - a, idx[at:to], val[at:to], b - a, layers, activation))
        a, at = b, to
    return np.concatenate(parts) if parts else np.zeros((0, layers[-1][0].shape[1]))


def _slab(rows, idx, val, n, layers, activation) -> np.ndarray:
    weight, bias = layers[0]
    hidden = np.zeros((n, weight.shape[1]))
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else []
    if len(rows):
        hidden[rows[starts]] = np.add.reduceat(val[:, None] * weight[idx], starts, axis=0)
    hidden += bias
    for weight, bias in layers[1:]:
        if activation == "relu":
            hidden = np.maximum(hidden, 0.0)
        else:
            hidden = 1.0 / (1.0 + np.exp(-hidden))
        hidden = hidden @ weight + bias
    lifted = np.exp(hidden - hidden.max(axis=1, keepdims=True))
    return lifted / lifted.sum(axis=1, keepdims=True)


def _strongest(rows, idx, val, salience, top):
    """Positions of the ``top`` largest positive contributions of each row.

    Contributions are ranked after rounding, the smaller index first on a tie.
    """
    weight = val * salience[idx]
    order = np.lexsort((idx, -np.round(weight, 9), rows))
    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    best = order[(rank < top) & (weight[order] > 0)]
    return best, weight


def _calibrated(proba: np.ndarray, temperature: float):
    """Class index and calibrated confidence of each row; the first class wins a tie."""
    scaled = np.log(proba + pr.EPS) / temperature
    lifted = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    scaled = lifted / lifted.sum(axis=1, keepdims=True)
    return np.round(scaled, 9).argmax(axis=1), scaled.max(axis=1)


def _score_rows(
    rows, idx, val, n, layers, activation, temperature, known, salience, top
) -> pa.StructArray:
    table = _forward(rows, idx, val, n, layers, activation)
    pred, confidence = _calibrated(table, temperature) if n else (np.zeros(0), np.zeros(0))
    proba = _as_lists(table)
    best, weight = _strongest(rows, idx, val, salience, top)
    signals = pa.StructArray.from_arrays(
        [known.take(pa.array(idx[best])), pa.array(weight[best])], names=["term", "weight"]
    )
    return pa.StructArray.from_arrays(
        [
            proba,
            pa.array(pred.astype(np.int32)),
            pa.array(confidence),
            pa.ListArray.from_arrays(_offsets(rows[best], n), signals),
        ],
        names=_SCORE_ARROW.names,
    )


def vectoriser(spark: SparkSession, terms: list[str], idf: np.ndarray):
    """Arrow UDF: list of words to sparse unit vector of the terms among the words and their pairs of neighbours."""
    shared = spark.sparkContext.broadcast((_word_table(terms), np.asarray(idf)))

    def vectors(words: pa.Array) -> pa.Array:
        table, weights = shared.value
        rows, idx, val = _weigh_words(words, table, weights)
        offsets = _offsets(rows, len(words))
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(idx.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(val)),
            ],
            names=["idx", "val"],
        )

    @F.arrow_udf(VECTOR)
    def vector(words: pa.Array) -> pa.Array:
        return _by_slices(words, vectors)

    return vector


def scorer(spark: SparkSession, model: Model, top: int = TOP_SIGNALS, of: str = "terms"):
    """Arrow UDF: term list to class probabilities, calibrated class and strongest terms.

    With ``of='words'`` it takes a list of words, whose pairs of neighbours count as terms too.
    """
    known = pa.array(model.terms, pa.string())
    table = _word_table(model.terms) if of == "words" else known
    shared = spark.sparkContext.broadcast(
        (known, table, model.idf, model.layers, model.activation, model.temperature, model.salience)
    )

    def score_slice(tokens: pa.Array) -> pa.Array:
        known, table, idf, layers, activation, temperature, salience = shared.value
        rows, idx, val = (_weigh_words if of == "words" else _weigh)(tokens, table, idf)
        return _score_rows(
            rows, idx, val, len(tokens), layers, activation, temperature, known, salience, top
        )

    def score_batch(tokens: pa.Array) -> pa.Array:
        return _by_slices(tokens, score_slice)

    @F.arrow_udf(SCORE_OR_ERROR)
    def score(tokens: pa.Array) -> pa.Array:
        errors: list[str | None] = [None] * len(tokens)
        try:
            scored = score_batch(tokens)
        except Exception:  # find the row at fault; it gets its message, the others a score
            parts = []
            for k in range(len(tokens)):
                try:
                    parts.append(score_batch(tokens.slice(k, 1)))
                except Exception as error:
                    errors[k] = f"{type(error).__name__}: {error}"
                    parts.append(pa.nulls(1, _SCORE_ARROW))
            scored = pa.concat_arrays(parts)
        return pa.StructArray.from_arrays(
            [*scored.flatten(), pa.array(errors, pa.string())], names=[*_SCORE_ARROW.names, "score_error"]
        )

    return score


def vector_scorer(spark: SparkSession, model: Model):
    """Arrow UDF: stored sparse vector to class probabilities."""
    shared = spark.sparkContext.broadcast((model.layers, model.activation))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(idx: pa.Array, val: pa.Array) -> pa.Array:
        layers, activation = shared.value
        n = len(idx)
        proba = _forward(
            _list_rows(idx), idx.flatten().to_numpy(), val.flatten().to_numpy(), n, layers, activation
        )
        return _as_lists(proba)

    return score


def _with_terms(df: DataFrame, text: str) -> DataFrame:
    return (
        tx.with_words(df, text)
        .withColumn("_terms", tx.terms(F.col("words")))
        .drop("words")
    )


def _unpacked(df: DataFrame) -> DataFrame:
    """Replace the struct ``_s`` by its fields.

    The generator keeps later filters on these fields above the Python stage.
    Plain field access would let the optimizer copy the whole call into such a
    filter, and so score every row twice. Filters on other columns still pass.
    """
    kept = [c for c in df.columns if c != "_s"]
    return df.select(*kept, F.inline_outer(F.array("_s")))


def vectorise_text(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``idx`` and ``val``; no shuffle, all other columns kept."""
    rows = vocab.orderBy("feature_idx").select("term", "idf").toPandas()
    vector = vectoriser(df.sparkSession, rows.term.tolist(), rows.idf.to_numpy())
    return _unpacked(tx.with_words(df, text, "_words").withColumn("_s", vector("_words")).drop("_words", text))


def score_text(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace the text by ``proba``, ``pred``, ``raw_confidence`` and ``signals``.

    ``pred`` and ``raw_confidence`` are calibrated with the model's temperature. No
    shuffle; all other columns are kept.
    """
    score = scorer(df.sparkSession, model, of="words")
    return _unpacked(tx.with_words(df, text, "_words").withColumn("_s", score("_words")).drop("_words", text))


def _activated(x: Column, activation: str) -> Column:
    return F.greatest(x, F.lit(0.0)) if activation == "relu" else 1.0 / (1.0 + F.exp(-x))


def _dense(inputs: Column, weight: np.ndarray, bias: np.ndarray) -> Column:
    """One dense layer as array arithmetic inside the row."""
    def unit(j: int) -> Column:
        products = F.zip_with(
            inputs, F.lit([float(w) for w in weight[:, j]]), lambda x, w: x * w
        )
        return F.aggregate(products, F.lit(float(bias[j])), lambda acc, p: acc + p)

    return F.array(*[unit(j) for j in range(weight.shape[1])])


def apply_layers(df: DataFrame, inputs: str, layers, activation: str = "relu") -> DataFrame:
    """Replace an array column of features by ``proba``."""
    kept = [c for c in df.columns if c != inputs]
    first = df.select(*kept, _dense(F.col(inputs), *layers[0]).alias("_z"))
    return _upper_layers(first, kept, layers[1:], activation)


def _upper_layers(df: DataFrame, kept: list[str], layers, activation: str) -> DataFrame:
    for weight, bias in layers:
        df = df.withColumn("_in", F.transform("_z", lambda x: _activated(x, activation)))
        df = df.select(*kept, _dense(F.col("_in"), weight, bias).alias("_z"))
    return df.select(*kept, pr.softmax(F.col("_z")).alias("proba"))


def first_layer_rows(spark: SparkSession, model: Model) -> DataFrame:
    """``(term, feature_idx, idf, salience, w array<double>)``, one row per vocabulary term."""
    weight = model.layers[0][0]
    rows = [
        (t, i, float(model.idf[i]), float(s), [float(x) for x in weight[i]])
        for i, (t, s) in enumerate(zip(model.terms, model.salience))
    ]
    return spark.createDataFrame(
        rows, "term string, feature_idx int, idf double, salience double, w array<double>"
    )


def score_by_join(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Class probabilities by joins and sums: ``(id, proba)``.

    Every term row meets its weight row in a broadcast join, and each hidden unit
    is one sum per document, so rows are not multiplied by the layer width and
    partial sums are combined before the only shuffle. The norm is summed along
    with the units and divided out afterwards.
    """
    weights = first_layer_rows(df.sparkSession, model)
    hidden = len(model.layers[0][1])
    counted = tfidf.counted_terms(df.select(id_col, text), text)
    raw = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    rows = (
        counted.select(id_col, F.inline_outer("counts"))
        .join(F.broadcast(weights), "term", "left")
        .select(id_col, raw.alias("x"), "w")
    )
    sums = rows.groupBy(id_col).agg(
        F.sum(F.col("x") * F.col("x")).alias("_sq"),
        *[F.sum(F.col("x") * F.get("w", j)).alias(f"_h{j}") for j in range(hidden)],
    )
    bias = model.layers[0][1]
    norm = F.sqrt(F.coalesce(F.col("_sq"), F.lit(0.0)))
    state = sums.withColumn("_norm", norm).select(
        id_col,
        F.array(
            *[
                F.when(F.col("_norm") > 0, F.col(f"_h{j}") / F.col("_norm")).otherwise(0.0)
                + float(bias[j])
                for j in range(hidden)
            ]
        ).alias("_z"),
    )
    return _upper_layers(state, [id_col], model.layers[1:], model.activation)


def reasoning(signals: Column) -> Column:
    """``Top signals: term (0.000), ...`` or ``No strong signals.``"""
    parts = F.transform(
        signals, lambda s: F.format_string("%s (%.3f)", s["term"], s["weight"])
    )
    return F.when(
        F.size(signals) > 0, F.concat(F.lit("Top signals: "), F.array_join(parts, ", "))
    ).otherwise(F.lit("No strong signals."))
