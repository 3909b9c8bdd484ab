"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts where it is small, so the cuts follow the
content: an insertion moves the cuts near it and no others. Equal chunks have equal digests; all but the
first text that holds a chunk repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import bit_table, in_bits, offsets, slices, texts
from veilmark.session import written

#: The gear hash has 16 bits, so it knows the last 16 bytes.
WINDOW = 16
#: A byte ends a chunk if the hash is below 65,536 / SPACING, and no other candidate lies LEAST bytes before it.
SPACING, LEAST, MOST = 22, 12, 1_024

_DDL = "doc_id long, text_key long, starts array<int>, ends array<int>, words array<int>, digests array<binary>, links array<binary>"
_OUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())),
                  ("digests", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])


def gear_table(seed: int = 2024) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(raw: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i-1) + gear[byte i], modulo 2^16, at every byte: windows double in four steps."""
    h = gear[raw]
    span = 1
    while span < WINDOW:
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint16(span)
        h, span = wider, span * 2
    return h


def cut_points(parts: list[bytes], gear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, text borders, and all chunk borders (ascending, text borders among them).

    A cut depends only on the bytes around it: texts are hashed behind a gap, and a cut never parts a character.
    """
    raw = np.frombuffer(b"".join(parts), np.uint8)
    border = offsets(parts)
    if not len(raw):
        return raw, border, np.unique(border)
    h = gear_hashes(raw, gear)
    within = np.arange(len(raw)) - np.repeat(border[:-1], np.diff(border))
    after = np.flatnonzero((h < np.uint16(65_536 // SPACING)) & (within >= WINDOW - 1)) + 1
    after = after[after < len(raw)]
    after = after[(raw[after] & 0xC0) != 0x80]
    alone = np.concatenate(([True], np.diff(after) >= LEAST)) if len(after) else np.zeros(0, dtype=bool)
    cuts = np.unique(np.concatenate((after[alone], border)))
    long = np.flatnonzero(np.diff(cuts) > MOST)
    extra = [np.arange(cuts[i] + MOST, cuts[i + 1], MOST) for i in long]
    if extra:
        more = np.concatenate(extra)
        for _ in range(3):  # not inside a character
            more = np.where((raw[more] & 0xC0) == 0x80, more - 1, more)
        cuts = np.unique(np.concatenate((cuts, more)))
    return raw, border, cuts


def _may_be(passed: np.ndarray, digests: list[bytes | None]) -> np.ndarray:
    known = np.array([d is not None for d in digests], bool)
    heads = np.frombuffer(b"".join(d or bytes(16) for d in digests), ">u8")[::2].astype(np.uint64)
    return known & in_bits(passed, heads)


def chunks(docs: DataFrame, passed: np.ndarray | None = None) -> DataFrame:
    """Each text's chunks as arrays: start and end in code points, words that begin in it, 128-bit digest,
    and ``links``: the digest of the chunk before and this one together, null for a text's first chunk. ``text_key`` is a
    hash of the text, which tells rows of the same or no id apart.

    Narrow. Null and empty texts have no chunks. With ``passed``, a bit table of the first halves of digests, digests and links that
    are not in it are null, and chunks without either are left out.
    """
    sent = None if passed is None else docs.sparkSession.sparkContext.broadcast(passed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        white = np.zeros(256, dtype=bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        for batch in slices(batches):
            parts = texts(batch)
            raw, border, cuts = cut_points(parts, gear)
            whole = raw.tobytes()
            digests = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
            space = white[raw]
            begins = ~space & np.concatenate(([True], space[:-1]))
            if len(raw):
                inside = border[:-1][border[:-1] < len(raw)]
                begins[inside] = ~space[inside]
            words = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
            owner = np.searchsorted(border, cuts[:-1], side="right") - 1
            first = chars[border[owner]]
            links = [None, *(xxhash.xxh3_128_digest(a + b) for a, b in zip(digests, digests[1:]))][: len(digests)]
            for i in np.flatnonzero(np.diff(owner, prepend=-1)).tolist():
                links[i] = None
            values = [chars[cuts[:-1]] - first, chars[cuts[1:]] - first, words[cuts[1:]] - words[cuts[:-1]]]
            if sent is not None:
                own, pair = _may_be(sent.value, digests), _may_be(sent.value, links)
                kept = np.flatnonzero(own | pair)
                owner, values = owner[kept], [v[kept] for v in values]
                digests = [digests[i] if own[i] else None for i in kept]
                links = [links[i] if pair[i] else None for i in kept]
            lists = np.searchsorted(owner, np.arange(len(parts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), *(pa.ListArray.from_arrays(pa.array(lists), pa.array(v.astype(np.int32))) for v in values),
                 *(pa.ListArray.from_arrays(pa.array(lists), pa.array(d, pa.binary())) for d in (digests, links))], schema=_OUT)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(cut, _DDL)


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, end, words, link, first_doc_id``: every chunk that an earlier document (smaller id) holds
    as well, and as ``link`` every chunk that an earlier document holds together with the chunk before it.

    One row is kept for each digest and task before the shuffle, so a chunk in a third of all texts
    costs one row a task; the join back meets its many rows with one row of the other side. Rows that share a
    doc_id count as one document, and so do rows with a null id, which own nothing and repeat what others hold.
    """
    flat = _flat(chunks(docs))
    seen = flat.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.count("doc_id").alias("k"))
    shared = written(seen.filter((F.col("first_doc_id") < F.col("last")) | (F.col("k") < F.col("n"))).select("d1", "d2", "first_doc_id"), "shared_chunks")
    # Most chunks are shared with nobody: a bit table keeps them out of the second shuffle.
    held = _flat(chunks(docs, bit_table(shared, "d1")))
    later = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_doc_id"))
    return held.join(shared, ["d1", "d2"]).filter(F.col("first_doc_id").isNotNull() & later).drop("d1", "d2")


def _flat(rows: DataFrame) -> DataFrame:
    """A row for each digest and each link, as two whole numbers."""
    rows = rows.select("doc_id", "text_key", F.explode(F.arrays_zip("starts", "ends", "words", "digests", "links")).alias("c"))
    kinds = F.array(*(F.struct(F.col(f"c.{name}").alias("d"), F.lit(link).alias("link")) for name, link in (("digests", False), ("links", True))))
    return rows.withColumn("k", F.explode(kinds)).filter("k.d is not null").select(
        "doc_id", "text_key",
        F.conv(F.hex(F.substring("k.d", 1, 8)), 16, -10).cast("long").alias("d1"),
        F.conv(F.hex(F.substring("k.d", 9, 8)), 16, -10).cast("long").alias("d2"),
        F.col("c.starts").alias("start"), F.col("c.ends").alias("end"), F.col("c.words").alias("words"), F.col("k.link").alias("link"),
    )


def _spans(docs: DataFrame, least_words: int) -> DataFrame:
    """``repeated_spans`` with ``text_key``. In a text's order a link stands before its chunk, in the run of the chunk before."""
    rows = repeats(docs).distinct()
    by = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", F.desc("link"))
    linked = F.coalesce(F.lag("link").over(by) & (F.lag("start").over(by) == F.col("start")), F.lit(False))
    runs = rows.withColumn("new", (~F.col("link") & ~linked).cast("int")).withColumn("run", F.sum("new").over(by))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.when(~F.col("link"), F.col("words"))).alias("words"),
        F.coalesce(F.max(F.when(F.col("link"), F.col("first_doc_id"))), F.min("first_doc_id")).alias("first_doc_id"),
    )
    return spans.filter(F.col("words") >= least_words).drop("run")


def repeated_spans(docs: DataFrame, least_words: int = 15) -> DataFrame:
    """``doc_id, start, end, words, first_doc_id``: adjoining repeated chunks as one span, spans of
    ``least_words`` words and more. Two chunks are joined only if an earlier document holds them side by side as well.
    ``first_doc_id`` is the largest of the ids that are the first to hold two of its neighbours, or the first to hold
    its only chunk.

    Rows are known by id and text: rows of one id or none with different texts have spans of their own; rows that repeat an id
    with its text give their spans once. A span is within one text, so its window is as large as one text's repeated chunks.
    """
    return _spans(docs, least_words).drop("text_key")


def without_repeats(docs: DataFrame, least_words: int = 15) -> DataFrame:
    """The rows of ``docs`` with their repeated spans cut out of ``text``; other columns stay, whatever their names."""
    cuts = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    spans = _spans(docs, least_words).groupBy("doc_id", "text_key").agg(cuts)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    of_row = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_key"))
    kept = F.expr(
        "aggregate(spans, struct('' as t, 0 as at), (a, s) -> struct(concat(a.t, substr(row.text, a.at + 1, s.start - a.at)) as t, s.`end` as at), "
        "a -> concat(a.t, substr(row.text, a.at + 1)))"
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(kept)
    return rows.join(spans, of_row, "left").select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
