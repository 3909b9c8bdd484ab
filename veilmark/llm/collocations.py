"""Phrase collocations from exact counts, by streams in prefix and suffix order.

1. Phrases are counted level by level. A phrase of n words is only counted where both its parts of n - 1 words
   passed the level before, so the words of every level are read from the whole texts but few phrases are shuffled.
2. The counts of all levels are the streams: ordered by the first words of a phrase (prefix order) they meet the
   counts of first parts, ordered by its last words (suffix order) those of the rest. Both meetings, and those with the
   greatest extension to the right and to the left, are merge joins of sorted streams; no count is looked up in a hash table.
3. Scores are whole numbers from decimals of 38 digits.

What reaches every task is a filter of at most 2^28 bits, and one total a language where the languages are few. What it lets through by chance is counted
like the rest and falls below the limit; beyond some 16 million frequent phrases a level it lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.session import broadcast_if_small, written

#: Bytes that end a piece, and bytes that end a word within a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
NO_LANG = "und"

_KIND = bytes(2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MOST_BITS = 28
_PARTS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, phrase string, c long"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases, each continued by one word."""
    return _mix(h * _BASE + word)


def _text_hashes(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def stretches(data: np.ndarray, ends: np.ndarray, limit: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Cut the bytes of a batch, whose texts stop at ``ends``, into parts of about ``limit`` bytes.

    A part stops with a text, or, within a longer text, with a piece; only a piece above the limit makes a larger part.
    """
    start, total = 0, len(data)
    while start < total:
        stop = start + limit
        if stop < total:
            whole = np.searchsorted(ends, stop, side="right")
            if whole and ends[whole - 1] > start:
                stop = int(ends[whole - 1])
            else:
                text_end = int(ends[whole])
                inside = np.flatnonzero(_mapped(data[start:stop], _KIND) == 2)
                beyond = np.flatnonzero(_mapped(data[stop:text_end], _KIND) == 2) if not len(inside) else inside
                stop = start + int(inside[-1]) + 1 if len(inside) else stop + int(beyond[0]) + 1 if len(beyond) else text_end
        yield start, min(stop, total)
        start = stop


class _Words:
    """Words of one stretch: term (lang and word) of each, and the piece it stands in."""

    def __init__(self, data: np.ndarray, heads: np.ndarray, row_lang: np.ndarray, langs: list[str]):
        kind = _mapped(data, _KIND)
        word = kind == 0
        inside = np.concatenate(([False], word, [False]))
        # Where a text begins right after another one's last letter, one word ends and one begins.
        touching = np.unique(heads[(heads > 0) & (heads < len(data))])
        touching = touching[word[touching] & word[touching - 1]]
        edges = np.sort(np.concatenate((np.flatnonzero(inside[1:] != inside[:-1]), touching, touching)))
        begin, end = edges[::2], edges[1::2]
        row = np.searchsorted(heads, begin, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), begin) + row
        sizes = np.concatenate(([0], np.cumsum(end - begin)))
        body = _mapped(data, _LOWER)[word]
        found = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(sizes), pa.py_buffer(body)]).dictionary_encode()
        self.words, self.langs = found.dictionary, pa.array(langs, pa.string())
        key = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs) + row_lang[row]
        present = np.zeros(len(self.words) * len(langs), bool)
        present[key] = True
        self.terms = np.flatnonzero(present)
        number = np.zeros(len(present), np.int64)
        number[self.terms] = np.arange(len(self.terms))
        self.term = number[key]

    def hashes(self) -> np.ndarray:
        words = _text_hashes(self.words.cast(pa.large_binary()).to_pylist())
        langs = _text_hashes([lang.encode() for lang in self.langs.to_pylist()])
        return _follow(langs[self.terms % len(langs)], words[self.terms // len(langs)])[self.term]

    def phrases(self, n: int, passed: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """The ``n`` terms and the count of each distinct phrase; with ``passed`` (a bit table of
        phrases of n - 1 words) only of those whose two parts are in it."""
        places = max(0, len(self.term) - n + 1)
        valid = self.piece[:places] == self.piece[n - 1 :][:places]
        if passed is not None and places:
            word = self.hashes()
            h = word
            for i in range(1, n - 1):
                h = _follow(h[:-1], word[i:])
            slot = h & np.uint64(len(passed) * 64 - 1)
            hit = (passed[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            valid &= hit[:-1] & hit[1:]
        place = np.flatnonzero(valid)
        bits = max(1, len(self.terms).bit_length())
        at_once = 62 // bits
        if n <= at_once:
            key = self.term[place]
            for i in range(1, n):
                key = (key << bits) | self.term[place + i]
            key, count = np.unique(key, return_counts=True)
            return [(key >> (bits * (n - 1 - i))) & ((1 << bits) - 1) for i in range(n)], count
        key = self.term[place]
        for i in range(1, n):
            _, key = np.unique(key, return_inverse=True)
            key = (key << 32) | self.term[place + i]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return [self.term[place[first] + i] for i in range(n)], count

    def batches(self, terms: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(count), 100_000):
            some = [self.terms[t[start : start + 100_000]] for t in terms]
            parts = [self.words.take(pa.array(t // len(self.langs))) for t in some]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]
            lang = self.langs.take(pa.array(some[0] % len(self.langs)))
            yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(count[start : start + 100_000])], ["lang", "phrase", "c"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(0), "").cast(pa.large_binary())
        coded = pc.fill_null(batch.column(1), NO_LANG).dictionary_encode()
        row_lang, langs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        for start, stop in stretches(data, at[1:]):
            low = np.searchsorted(at, start, side="right") - 1
            high = np.searchsorted(at, stop)
            yield _Words(data[start:stop], np.maximum(at[low:high] - start, 0), row_lang[low:high], langs)


def _counted(rows: DataFrame, n: int, bits: np.ndarray | None = None) -> DataFrame:
    """``lang, phrase, a``: occurrences of all phrases of ``n`` words that ``bits`` lets through."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches):
            # Words of a language are added up under the empty phrase, which is no word.
            if n == 1 and len(words.term):
                total = np.bincount(words.terms[words.term] % len(words.langs), minlength=len(words.langs))
                blank = pa.array([""] * len(total), pa.string())
                yield pa.RecordBatch.from_arrays([words.langs, blank, pa.array(total, pa.int64())], ["lang", "phrase", "c"])
            yield from words.batches(*words.phrases(n, None if shared is None else shared.value))

    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "phrase").agg(F.sum("c").alias("a"))


def _bit_table(frequent: DataFrame, n: int) -> np.ndarray:
    """A bit for the hash of every frequent phrase of ``n`` words: sixteen bits a phrase, at most 2^28 in all."""
    bits = min(_MOST_BITS, max(16, (16 * frequent.count()).bit_length()))
    mask = np.uint64((1 << bits) - 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _text_hashes([x.encode() for x in batch.column(0).to_pylist()])
            words = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            word = [_follow(lang, _text_hashes([w[i] for w in words])) for i in range(n)]
            h = word[0]
            for i in range(1, n):
                h = _follow(h, word[i])
            slot = h & mask
            bit = (np.uint64(1) << (slot & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["cell", "bit"])

    found = frequent.select("lang", "phrase").mapInArrow(slots, "cell long, bit long")
    cells = found.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy().view(np.uint64)
    return out


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Exact counts of frequent phrases: ``(totals, counts)``.

    ``totals`` has ``lang, n`` (all words of a language), ``counts`` has ``lang, phrase, words, a`` for every
    phrase of one to ``longest`` words that occurs ``least`` times or more. Words of a phrase are joined by one blank.
    """
    rows = docs.select("text", "lang")
    level = written(_counted(rows, 1).filter((F.col("a") >= least) | (F.col("phrase") == "")), "phrases-1")
    totals = level.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    level = level.filter("phrase <> ''")
    counts = level.withColumn("words", F.lit(1))
    for n in range(2, longest + 1):
        bits = _bit_table(level, n - 1)
        level = written(_counted(rows, n, bits).filter(F.col("a") >= least), f"phrases-{n}")
        counts = counts.unionByName(level.withColumn("words", F.lit(n)))
    return totals, counts


def scored(totals: DataFrame, counts: DataFrame, cover: int = 100) -> DataFrame:
    """Every phrase of two words or more with its weakest cut: ``lang, phrase, a, l, r, n, score``.

    Counts need the columns of :func:`count_phrases`, closed under parts of a phrase. A phrase
    goes if a one-word extension of it has ``cover`` percent of its occurrences; counts never rise along extensions,
    so a longer one that has as many goes through such a step.
    """
    phrases = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    k = F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), k).alias("first"), part(k + 1, F.col("words") - k).alias("rest")
    )
    by_first = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    by_rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    prefix = cuts.join(by_first.hint("merge"), ["lang", "first"])
    both = prefix.join(by_rest.hint("merge"), ["lang", "rest"]).join(broadcast_if_small(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    both = both.withColumn("above", wide("a") * wide("n") * F.lit(1000).cast("decimal(38,0)")).withColumn("below", wide("l") * wide("r"))
    best = (
        both.withColumn("score", F.expr("above div below"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    longer = phrases.filter("words > 2").withColumn(
        "inner", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1)))
    )
    widest = longer.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("extended"))
    out = best.join(widest.hint("merge"), ["lang", "phrase"], "left")
    covered = F.coalesce(F.lit(100) * F.col("extended") >= F.lit(cover) * F.col("a"), F.lit(False))
    return out.filter(~covered).drop("extended")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100) -> DataFrame:
    """The ``top`` collocations of every language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` needs ``text`` and ``lang``; other columns are not read, whatever their names. A null text is empty, a null
    lang is ``und``. A-Z fall to lower case; a phrase never crosses ``.,;:!?`` or an end of line. Equal rows count
    each. A text of any length is read in stretches that end with a piece. An empty table, and
    one in which nothing occurs ``least`` times, give no rows. Ties: the first cut of the lowest score;
    then more occurrences, then the phrase by its bytes.
    """
    rows = scored(*count_phrases(docs, least, longest), cover)
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language may hold most rows: its best are found in parts first, so that the last sort sees a bounded number.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
