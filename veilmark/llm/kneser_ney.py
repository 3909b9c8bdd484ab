"""Quality rules: counts per text, and perplexity under a modified Kneser-Ney model of code points.

Symbols are code points as they stand (case, marks and every script count), and each language has a model of its own.
Every text stands between edges: ``order - 1`` before it, and one more after it, which is a symbol to be guessed too.

Texts are dealt by their content to two halves and each is scored by the model of the other half, so a text
never vouches for itself and neither do its exact copies. Both models live in one table: an n-gram has a count and a
probability for each half, and backing off is a count of 0.

Spark counts n-grams and works out each level by joins on context and suffix. A context or suffix has at most as many
rows as there are symbols, so no key is hot. The finished model is a table sorted by 64-bit hash; each block of texts gets
its own share of it as a sorted hash array, and searches there.

Null and empty texts have one token (the end). Null is a language of its own, apart from the empty name. Repeated rows
count as often as they occur. Columns other than ``doc_id``, ``lang`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import offsets, slices, texts
from veilmark.session import written

ORDER = 3
#: Stands before and after every text; U+10FFFF is no character. A text that holds it has edges inside.
EDGE = "\U0010ffff"
SYMBOL_CHARS = b"#*$%&|<>"
#: Bytes of text in a block. A block asks once for each n-gram in it.
BLOCK_BYTES = 48_000_000
#: Bytes of text worked on at once; arrays of some 60 bytes a symbol stand beside them.
SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_PARTS = 256
_WHITE = b" \t\n\r\x0b\x0c"


def tongue(lang: str | None) -> str:
    """Name of a language's model; null has its own."""
    return "" if lang is None else "=" + lang


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """A 64-bit number for every code point."""
    x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """The n-grams of a slice of texts: one for each code point and one for the end of each text, in order."""

    def __init__(self, batch: pa.RecordBatch, order: int):
        parts = [t or "" for t in batch.column("text").to_pylist()]
        langs = batch.column("lang").to_pylist()
        gap = EDGE * (order - 1)
        self.order, self.tongues = order, [tongue(x) for x in langs]
        self.symbols = np.frombuffer((gap + gap.join(parts) + gap + EDGE).encode("utf-32-le"), np.uint32)
        self.tokens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.half = np.fromiter((xxhash.xxh3_64_intdigest(p) & 1 for p in parts), np.int8, len(parts))
        self.starts = np.cumsum(self.tokens) - self.tokens
        self.text = np.repeat(np.arange(len(parts)), self.tokens)
        first = (order - 1) + self.starts + np.arange(len(parts)) * (order - 2)
        self.at = np.arange(len(self.text)) + np.repeat(first - self.starts, self.tokens)
        code, key = _codes()[self.symbols], np.zeros(len(self.at), np.uint64)
        for k in range(order):
            key = key * np.uint64(_BASE) + code[self.at - (order - 1 - k)]
        # Mixed once more, so that no two languages' sums can meet by a shift.
        by_text = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in self.tongues), np.uint64, len(parts))
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ by_text[self.text]
        found = pa.array(key.view(np.int64)).dictionary_encode()
        #: Distinct keys, and for each token which of them it is.
        self.keys, self.which = found.dictionary.to_numpy(), found.indices.to_numpy()

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys with the language and the symbols of each, and its counts in either half."""
        n = len(self.keys)
        second = np.bincount(self.which, self.half[self.text], minlength=n).astype(np.int64)
        first = np.bincount(self.which, minlength=n) - second
        place = np.empty(n, np.int64)
        place[self.which[::-1]] = np.arange(len(self.which))[::-1]
        rows = self.symbols[self.at[place][:, None] + np.arange(1 - self.order, 1)]
        return self.keys, np.array(self.tongues, dtype=object)[self.text[place]], rows, first, second


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Number the slices of a partition by block. Both passes read the same partitions, so they agree; an n-gram
    without an answer would raise."""
    base, number, held = TaskContext.get().partitionId() << 32, 0, 0
    for batch in slices(batches, limit=SLICE_BYTES):
        size = int(pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0)
        if held and held + size > block_bytes:
            number, held = number + 1, 0
        held += size
        yield base + number, batch


def count_ngrams(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, key, tongue, gram, n0, n1``: the distinct n-grams of each block and how often the texts of either half
    hold them; all whole texts."""

    def packed(block: int, got: list) -> Iterator[pa.RecordBatch]:
        keys, place, group = np.unique(np.concatenate([g[0] for g in got]), return_index=True, return_inverse=True)
        names = np.concatenate([g[1] for g in got])[place]
        rows = np.concatenate([g[2] for g in got])[place]
        counts = [np.bincount(group, np.concatenate([g[k] for g in got]), minlength=len(keys)).astype(np.int64) for k in (3, 4)]
        whole = np.ascontiguousarray(rows).tobytes().decode("utf-32-le")
        grams = [whole[i : i + order] for i in range(0, len(whole), order)]
        for i in range(0, len(keys), 100_000):
            cut = slice(i, i + 100_000)
            size = len(keys[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)), pa.array(keys[cut]), pa.array(names[cut], pa.string()), pa.array(grams[cut]), *(pa.array(c[cut]) for c in counts)],
                names=["block", "key", "tongue", "gram", "n0", "n1"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for block, batch in _blocks(batches, block_bytes):
            if got and block != now:
                yield from packed(now, got)
                got = []
            now = block
            got.append(Grams(batch, order).counted())
        if got:
            yield from packed(now, got)

    return docs.select("doc_id", "lang", "text").mapInArrow(count, "block long, key long, tongue string, gram string, n0 long, n1 long")


def _discount(n: Column, cuts: list[float]) -> Column:
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.lit(cuts[0])).when(n == 2, F.lit(cuts[1])).otherwise(F.lit(cuts[2]))


def discounts(n: list[int]) -> list[float]:
    """What is taken off counts of 1, 2, and 3 and more, from how many n-grams have a count of 1, 2, 3, 4."""
    n1, n2, n3, n4 = (max(1, x or 0) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.05), top) for x, top in zip(raw, [0.95, 1.9, 2.9])]


def fit(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, log0, log1``: for every n-gram of the corpus the log10 probability of its last symbol after the others,
    under the model of either half; sorted by ``key`` within partitions.

    Modified Kneser-Ney, interpolated down to equal shares of a language's symbols. Raw counts at the highest
    order, numbers of distinct symbols to the left below. Only counts of counts reach the driver, eight numbers a level.
    """
    halves = (0, 1)
    table = written(grams.groupBy("key", "tongue", "gram").agg(*(F.sum(f"n{h}").alias(f"n{h}") for h in halves)), "kn-top")
    levels = {order: table}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].select("tongue", F.substring("gram", 2, k).alias("gram"), "n0", "n1")
        kinds = [F.sum((F.col(f"n{h}") > 0).cast("long")).alias(f"n{h}") for h in halves]
        levels[k] = written(shorter.groupBy("tongue", "gram").agg(*kinds), f"kn-{k}")
    symbols = levels[1].groupBy("tongue").agg((F.lit(1.0) / F.count("*")).alias("share"))
    lower = symbols.select("tongue", F.lit("").alias("suffix"), *(F.col("share").alias(f"q{h}") for h in halves))
    for k in range(1, order + 1):
        rows = levels[k]
        of = rows.agg(*(F.sum((F.col(f"n{h}") == c).cast("long")) for h in halves for c in (1, 2, 3, 4))).first()
        cuts = [discounts(list(of[4 * h : 4 * h + 4])) for h in halves]
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = [x for h in halves for x in (F.sum(f"n{h}").alias(f"all{h}"), F.sum(_discount(F.col(f"n{h}"), cuts[h])).alias(f"off{h}"))]
        totals = rows.groupBy("tongue", context).agg(*sums)
        rows = rows.withColumn("context", context).withColumn("suffix", F.substring("gram", 2, k - 1))
        rows = rows.join(totals, ["tongue", "context"]).join(lower, ["tongue", "suffix"])
        for h in halves:
            n, of_all, off, q = (F.col(f"{c}{h}") for c in ("n", "all", "off", "q"))
            p = (n - _discount(n, cuts[h]) + off * q) / F.when(of_all > 0, of_all)
            rows = rows.withColumn(f"p{h}", F.coalesce(p, q))
        lower = rows.select("tongue", F.col("gram").alias("suffix"), *(F.col(f"p{h}").alias(f"q{h}") for h in halves), *(["key"] if k == order else []))
    out = lower.select("key", *(F.log10(f"q{h}").alias(f"log{h}") for h in halves))
    return out.repartition("key").sortWithinPartitions("key")


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = 3) -> np.ndarray:
    """Words of each document that stand in a window found twice or more in it."""
    if len(ids) < window:
        return np.zeros(n_docs, dtype=np.int64)
    mix = np.zeros(len(ids) - window + 1, dtype=np.uint64)
    for k in range(window):
        mix = (mix ^ ids[k : len(ids) - window + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    last = len(mix)
    same = doc[:last] == doc[window - 1 :]
    mix = (mix ^ doc[:last].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(same)
    _, back, n = np.unique(mix[at], return_inverse=True, return_counts=True)
    hit = at[n[back] > 1]
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(window):
        covered[hit + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def _measure(parts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    words = [p.split() for p in parts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(parts)), n_words)
    lines = np.zeros(len(parts), dtype=np.int64)
    for i, p in enumerate(parts):
        if b"\n" in p:
            full = [x for x in p.split(b"\n") if x.strip(_WHITE)]
            lines[i] = len(full) - len(set(full))
    whole = b"".join(parts)
    raw = np.frombuffer(whole, np.uint8)
    start = offsets(parts)
    wanted = np.zeros(256, dtype=bool)
    wanted[list(SYMBOL_CHARS)] = True
    chars = np.ones(256, dtype=bool)
    chars[0x80:0xC0] = False
    chars[list(_WHITE)] = False
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[raw], dtype=np.int64)))[start])
    return {
        "n_words": n_words, "word_chars": sums(chars), "n_symbols": sums(wanted), "n_dup_lines": lines,
        "n_repeat_words": _repeated(ids, doc, len(parts)),
    }


def measured(docs: DataFrame, grams: DataFrame, model: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, lang``, the base counts, ``n_symbols_read`` (code points and the end) and ``log10_ppl`` of every whole text.

    ``grams`` are the written counts of the same ``docs`` in the same blocks. Texts travel once, compressed; a block's share of
    the model comes as rows and becomes a sorted hash array there.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), data], names=["block", "data"])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_symbols_read", "log10_ppl"]

    def score(packs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = answers.column("key").to_numpy()
        sort = np.argsort(keys)
        keys = keys[sort]
        logs = [answers.column(f"log{h}").to_numpy()[sort] for h in (0, 1)]
        done = []
        for data in packs.column("data"):
            batch = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
            found = Grams(batch, order)
            place = np.minimum(np.searchsorted(keys, found.keys), len(keys) - 1)
            if not (keys[place] == found.keys).all():
                raise ValueError("the texts of a block are not those that were counted; write the table first")
            # Learnt from the other half.
            own = np.where(found.half[found.text] == 0, logs[1][place][found.which], logs[0][place][found.which])
            ppl = -np.add.reduceat(own, found.starts) / found.tokens
            out = _measure(texts(batch)) | {"n_symbols_read": found.tokens, "log10_ppl": ppl}
            done.append(pa.Table.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(out[c]) for c in names)], names=["doc_id", "lang", *names]))
        return pa.concat_tables(done)

    packs = docs.select("doc_id", "lang", "text").mapInArrow(pack, "block long, data binary")
    answers = grams.select("block", "key").join(model, "key")
    ddl = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in names[:-1]) + ", log10_ppl double"
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, ddl)


def _tongue() -> Column:
    """Name of a row's language as :func:`tongue` gives it."""
    return F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))


def bands(measures: DataFrame, bin_size: float = 0.002, least_spread: float = 0.005) -> DataFrame:
    """``lang, middle, sigma``: the language's median of log10 perplexity and its spread (1.4826 times
    the median distance from the median).

    Medians are read from counts of bins of ``bin_size``, so a language of any size is a few
    hundred rows, and reruns agree. Null is a language of its own, apart from the empty name.
    """
    at = F.round(F.col("log10_ppl") / bin_size).cast("long")

    def median(rows: DataFrame, value: str) -> DataFrame:
        by = Window.partitionBy("lang").orderBy(value)
        whole = Window.partitionBy("lang")
        run = rows.withColumn("upto", F.sum("n").over(by)).withColumn("all", F.sum("n").over(whole))
        return run.filter(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min(value).alias("mid"))

    bins = measures.groupBy(_tongue().alias("lang"), at.alias("bin")).agg(F.count("*").alias("n"))
    middle = median(bins, "bin")
    away = bins.join(middle, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("mid")).alias("away")).agg(F.sum("n").alias("n"))
    spread = median(away, "away").withColumnRenamed("mid", "mad")
    sigma = F.greatest(F.col("mad") * bin_size * 1.4826, F.lit(least_spread))
    return middle.join(spread, "lang").select("lang", (F.col("mid") * bin_size).alias("middle"), sigma.alias("sigma"))


def judged(measures: DataFrame, width: float = 2.5, short: float = 100.0) -> DataFrame:
    """Adds ``base_failed``, ``perplexity`` and ``kept``.

    A text fails the base rule with under 50 words or with over half of its words in repeated windows.
    The others are kept if their log10 perplexity lies within the band of their language: ``width`` times the
    language's spread to either side of its middle, wider for a short text by sqrt(1 + short / words).
    Bands are measured on texts that pass the base rule; null and empty texts fail that rule.
    """
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = measures.withColumn("base_failed", failed).withColumn("key", _tongue())
    limits = bands(rows.filter(~F.col("base_failed"))).withColumnRenamed("lang", "key")
    # A language may hold most rows: its one limit meets them in parts.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "log10_ppl"), F.lit(_PARTS)))
    limits = limits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))))
    reach = F.col("sigma") * width * F.sqrt(1 + short / F.greatest(F.col("n_words"), F.lit(1)))
    inside = F.coalesce(F.abs(F.col("log10_ppl") - F.col("middle")) <= reach, F.lit(False))
    out = rows.join(limits, ["key", "part"], "left").withColumn("kept", ~F.col("base_failed") & inside)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), "log10_ppl")).drop("key", "part", "middle", "sigma", "log10_ppl")
