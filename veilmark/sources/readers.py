"""Readers in stages: each one sees only the rows that no earlier one could read.

A reader takes the bytes (or any other input column) of a row and gives a text, or a status with a message. A text under 20
characters, and an exception in any reader but the last, leave the row to the next reader; a status settles it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.fixed_values import MIN_TEXT_CHARS

OUTCOME = "struct<text:string,status:string,detail:string>"
_OUTCOME_ARROW = pa.struct([("text", pa.string()), ("status", pa.string()), ("detail", pa.string())])
#: What a chain of readers adds.
SETTLED = "struct<text:string,status:string,detail:string,reader:string>"
NO_TEXT = "No extractable text."


@dataclass(frozen=True)
class Refused:
    """A reader's answer in place of a text: the row is settled with this status."""

    status: str
    detail: str


#: From rows and the name of an input column to rows with one more column ``OUTCOME``; null where the input is null.
Stage = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class Reader:
    name: str
    stage: Stage


def from_function(name: str, read: Callable[[bytes], str | Refused]) -> Reader:
    """A reader from a Python function on one value; it is called for the rows of its stage only."""

    def outcome(value):
        if value is None:
            return None
        try:
            got = read(value)
        except Exception as error:  # the next reader may do better
            return {"text": None, "status": None, "detail": f"{type(error).__name__}: {error}"}
        if isinstance(got, str) or got is None:
            return {"text": got, "status": None, "detail": None}
        return {"text": None, "status": got.status, "detail": got.detail}

    @F.arrow_udf(OUTCOME)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([outcome(v.as_py()) for v in values], _OUTCOME_ARROW)

    return Reader(name, lambda rows, given, out: rows.withColumn(out, run(given)))


def from_column(name: str, read: Callable[[Column], Column]) -> Reader:
    """A reader from a column function that gives a text or null."""

    def stage(rows: DataFrame, given: str, out: str) -> DataFrame:
        null = F.lit(None).cast("string")
        text = F.struct(read(F.col(given)).alias("text"), null.alias("status"), null.alias("detail"))
        return rows.withColumn(out, F.when(F.col(given).isNotNull(), text))

    return Reader(name, stage)


def from_rows(name: str, read: Callable[[DataFrame, str, str], DataFrame]) -> Reader:
    """A reader from a function that adds a text column: ``read(rows, input, output)``."""

    def stage(rows: DataFrame, given: str, out: str) -> DataFrame:
        null = F.lit(None).cast("string")
        rows = read(rows, given, f"{out}_text")
        text = F.struct(F.col(f"{out}_text").alias("text"), null.alias("status"), null.alias("detail"))
        return rows.withColumn(out, F.when(F.col(given).isNotNull(), text)).drop(f"{out}_text")

    return Reader(name, stage)


def read_in_stages(rows: DataFrame, given: str, readers: Sequence[Reader], least: int = MIN_TEXT_CHARS, out: str = "outcome") -> DataFrame:
    """Add ``out``: text, status (``ok``, a reader's own, ``no_text_layer`` or ``extraction_failed``), detail, and the
    name of the reader that settled the row.

    Stages are columns of one pass: a stage's input is null for rows that are settled, so its reader is not called for
    them and nothing is shuffled. A null input has the status ``no_text_layer``. Where every reader failed with an exception, the last
    message stands under ``extraction_failed``; where at least one found a text, but too short, ``no_text_layer``.
    """
    own = "_stage"
    while any(c.startswith(own) for c in rows.columns):
        own = f"_{own}"
    settled = F.lit(False)
    texts, states = [], []
    for k, reader in enumerate(readers):
        name, here = f"{own}{k}", f"{own}{k}_in"
        rows = rows.withColumn(here, F.when(~settled, F.col(given)))
        rows = reader.stage(rows, here, name).drop(here)
        long = F.coalesce(F.char_length(F.trim(f"{name}.text")) >= least, F.lit(False))
        done = long | F.col(f"{name}.status").isNotNull()
        answer = F.struct(
            F.when(long, F.col(f"{name}.text")).alias("text"),
            F.when(long, F.lit("ok")).otherwise(F.col(f"{name}.status")).alias("status"),
            F.when(~long, F.col(f"{name}.detail")).alias("detail"),
            F.lit(reader.name).alias("reader"),
        )
        texts.append(F.when(done, answer))
        states.append(F.col(name))
        settled = settled | F.coalesce(done, F.lit(False))
    none = F.lit(None).cast("string")
    said = F.coalesce(*[s["detail"] for s in reversed(states)])
    failed = F.lit(True)
    for s in states:
        failed = failed & s["detail"].isNotNull()
    end = F.struct(
        none.alias("text"),
        F.when(F.coalesce(failed, F.lit(False)), F.lit("extraction_failed")).otherwise(F.lit("no_text_layer")).alias("status"),
        F.when(F.coalesce(failed, F.lit(False)), said).otherwise(F.lit(NO_TEXT)).alias("detail"),
        none.alias("reader"),
    )
    return rows.withColumn(out, F.coalesce(*texts, end)).drop(*[f"{own}{k}" for k in range(len(readers))])
