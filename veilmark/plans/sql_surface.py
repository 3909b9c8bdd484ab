"""Classification and explanation as SQL table functions on raw text.

``SELECT * FROM classify_text(TABLE(SELECT id, text FROM notes))`` gives a row for each row, ``explain_text`` one for each of
the strongest terms of each row. Both take batches of rows, so a call costs what the DataFrame form costs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.fixed_values import TOP_SIGNALS
from veilmark.functions import text as tx
from veilmark.operators import scoring
from veilmark.session import small_batches

#: Texts that are worked on at once: memory beyond the batch itself does not grow with it.
_ROWS = 256
CLASSIFIED = "id bigint, classification string, confidence double, review_flag boolean, reasoning string, policy_version string"
EXPLAINED = "id bigint, rank int, term string, weight double"


def _words(word: str, decomposed):
    """A function from texts to their word lists, as the DataFrame form makes them."""
    # In plain ASCII the letters, numbers and underscore of the pattern are these.
    plain = re.compile("[A-Za-z0-9_]{2,}")

    def words(texts: pa.Array) -> pa.Array:
        import regex

        found = regex.compile(word)
        out = []
        for text in texts.to_pylist():
            low = (text or "").lower()
            low = low if low.isascii() else decomposed(low)
            out.append((plain if low.isascii() else found).findall(low))
        return pa.array(out, pa.list_(pa.string()))

    return words


def register(spark: SparkSession, model: scoring.Model, classify: str = "classify_text", explain: str = "explain_text") -> None:
    """Register both functions for a model. The first column of the table is a whole-number id, the second the text; a null
    text counts as empty, equal and null ids are rows like others. Confidence is not rounded."""
    known = pa.array(model.terms, pa.string())
    parts = (known, scoring._word_table(model.terms), model.idf, model.layers, model.activation, model.temperature, model.salience)
    shared = spark.sparkContext.broadcast(parts)
    classes, limit, policy = list(model.classes), model.review_threshold, model.policy_version
    words, weigh, score_rows, top = _words(tx.WORD, tx._decomposed), scoring._weigh_words, scoring._score_rows, TOP_SIGNALS

    def scored(rows: pa.RecordBatch):
        """The ids and scores of a batch, a slice of rows at a time."""
        known, table, idf, layers, activation, temperature, salience = shared.value
        texts = rows.column(1)
        for start in range(0, rows.num_rows, _ROWS):
            part = texts.slice(start, _ROWS)
            found = weigh(words(part), table, idf)
            out = score_rows(*found, len(part), layers, activation, temperature, known, salience, top)
            yield rows.column(0).slice(start, _ROWS).cast(pa.int64()), out

    class Classify:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            for ids, out in scored(rows):
                confidence, why = out.field("raw_confidence"), []
                for signals in out.field("signals").to_pylist():
                    shown = ", ".join("%s (%.3f)" % (s["term"], s["weight"]) for s in signals)
                    why.append(f"Top signals: {shown}" if shown else "No strong signals.")
                yield pa.table({
                    "id": ids, "classification": pa.array([classes[k] for k in out.field("pred").to_pylist()], pa.string()),
                    "confidence": confidence, "review_flag": pa.compute.less(confidence, limit), "reasoning": pa.array(why, pa.string()),
                    "policy_version": pa.array([policy] * len(ids), pa.string()),
                })

    class Explain:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            for ids, out in scored(rows):
                lines = [(i, r, s["term"], s["weight"]) for i, row in zip(ids.to_pylist(), out.field("signals").to_pylist()) for r, s in enumerate(row)]
                kinds = (("id", pa.int64()), ("rank", pa.int32()), ("term", pa.string()), ("weight", pa.float64()))
                columns = zip(*lines) if lines else [()] * len(kinds)
                yield pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds, columns)})

    small_batches(spark)
    spark.udtf.register(classify, F.arrow_udtf(Classify, returnType=CLASSIFIED))
    spark.udtf.register(explain, F.arrow_udtf(Explain, returnType=EXPLAINED))
