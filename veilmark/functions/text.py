"""Text to terms: case and accent folding, word tokens, bigrams, counts per row.

Everything up to the counted terms happens inside the row, with built-in
functions only, so a corpus is tokenised and counted without a shuffle.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.session import small_batches

WORD = r"[\p{L}\p{N}_]{2,}"

# Cheap first test: one look at a bit set per character. The three fractions are
# the only Latin-1 characters that fold to several characters.
_BEYOND_LATIN1 = "[^\\x{0}-\\x{BB}\\x{BF}-\\x{FF}]"
# Spans closer than this are joined: a short character class, and the few extra
# characters in it only send their rows to the exact path.
_GAP = 16


def _decomposed(text: str) -> str:
    out = unicodedata.normalize("NFKD", text)
    # A text has few distinct characters: each is looked at once.
    for c in set(out):
        if unicodedata.combining(c):
            out = out.replace(c, "")
    return out


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str]:
    """(characters to map, their images, regex class of these, regex class of the rest).

    ``translate`` drops the characters of the first string that have no partner
    in the second, so the combining marks go to its end. Characters that fold to
    several others cannot be translated; they form the regex class.
    """
    source, image, marks, several = [], [], [], []
    for point in range(128, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        folded = _decomposed(char)
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            image.append(folded)
        else:
            several.append(point)
    mapped = _char_class(sorted(ord(c) for c in source + marks))
    return "".join(source + marks), "".join(image), mapped, _char_class(several)


def _char_class(points: list[int]) -> str:
    spans: list[list[int]] = []
    for point in points:
        if spans and point - spans[-1][1] <= _GAP:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)
    # ASCII is ruled out by one look at a bit set before the ranges are tried.
    return f"[[^\\x{{0}}-\\x{{7F}}]&&[{ranges}]]"


@F.arrow_udf(T.StringType())
def _fold_any(text: pa.Array) -> pa.Array:
    if text.null_count == len(text):
        return text
    return pa.array([t and _decomposed(t) for t in text.to_pylist()], pa.string())


def with_folded(df: DataFrame, text: str, out: str = "folded") -> DataFrame:
    """Add ``out``: lower case first, then accents stripped (NFKD without marks).

    Text without any character that folds needs only ``lower``; other text goes
    through ``translate``. Rows that may hold characters folding to several others
    go to a Python worker, which receives nulls for all other rows.
    """
    small_batches(df.sparkSession)
    source, image, mapped, wide = _fold_tables()
    low, ascii_only = F.col(out), F.octet_length(out) == F.char_length(out)
    beyond = low.rlike(_BEYOND_LATIN1) & low.rlike(wide)
    return (
        df.withColumn(out, F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_wide", _fold_any(F.when(~ascii_only & beyond, low)))
        .withColumn(
            out,
            F.when(F.col("_wide").isNotNull(), F.col("_wide"))
            .when(ascii_only | ~low.rlike(mapped), low)
            .otherwise(F.translate(low, source, image)),
        )
        .drop("_wide")
    )


def words(folded: Column) -> Column:
    """All runs of two or more word characters, in order."""
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def with_words(df: DataFrame, text: str, out: str = "words") -> DataFrame:
    """Add the token array of a text column."""
    return with_folded(df, text, "_folded").withColumn(out, words(F.col("_folded"))).drop("_folded")


def adjacent_pairs(tokens: Column) -> Column:
    """``a b`` for each pair of neighbouring tokens.

    The shifted slices are arguments of ``zip_with``; indexing the token array
    inside a lambda would evaluate the tokeniser once per element.
    """
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, 1, last), F.slice(tokens, 2, last), lambda a, b: F.concat_ws(" ", a, b)
    )


def terms(tokens: Column) -> Column:
    """Unigrams followed by bigrams."""
    return F.concat(tokens, adjacent_pairs(tokens))


def runs_of(tokens: Column, longest: int) -> Column:
    """All n-grams of 1 to ``longest`` tokens, as space-joined strings."""
    grams = [tokens]
    shorter = tokens
    for n in range(2, longest + 1):
        last = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        shorter = F.zip_with(
            F.slice(shorter, 1, last), F.slice(tokens, n, last), lambda a, b: F.concat_ws(" ", a, b)
        )
        grams.append(shorter)
    return F.concat(*grams)


def with_counts(df: DataFrame, items: str, out: str = "counts") -> DataFrame:
    """Replace an array of strings by its distinct items and their counts.

    Adds ``out``: ``array<struct<term string, tf int>>`` sorted by term. The
    array is sorted and cut where neighbours differ, which needs no shuffle and
    no per-document grouping, unlike ``explode`` + ``groupBy(doc, term)``.
    """
    s, starts, n = F.col("_s"), F.col("_starts"), F.size("_s")
    first_of_run = F.transform(
        s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)
    )
    return (
        df.withColumn("_s", F.sort_array(items))
        .withColumn("_starts", F.array_compact(first_of_run))
        .withColumn(
            out,
            F.zip_with(
                starts,
                F.slice(F.concat(starts, F.array(n)), 2, F.size(starts)),
                lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf")),
            ),
        )
        .drop("_s", "_starts")
    )
