"""Exact top-k by inner product, one term after another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import parts_for

_OUT = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component. Vectors that are null or hold a null,
    NaN or infinite component are left out; a component whose value does not fit a long is an error."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.coalesce(
        F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False)
    )
    scaled = lambda e: F.lit(float(scale)) * e.cast("double")
    fits = lambda e: F.abs(scaled(e)) < F.lit(float(1 << 63))
    whole = F.transform(x, lambda e: F.when(fits(e), F.floor(scaled(e)).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long")))
    return vectors.filter(usable & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column.to_numpy(zero_copy_only=False)):
        out[i, : len(v)] = v
    return out


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = 64, tile: int = 1_024):
    """The k best of ``vectors`` (sorted by id) for each query, term at a time."""
    size = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    largest = size(queries) * size(vectors) * max(1, queries.shape[1])
    # Beyond 64 bits sums are Python's whole numbers, exact and slow; a score that is asked for and fits no long is an error.
    kind = np.float32 if largest < 1 << 24 else np.int64 if largest < 1 << 63 else object
    # Postings by tile: for each term the rows that hold it, with their weights.
    tiles = []
    for low in range(0, len(ids), tile):
        rows = vectors[low : low + tile]
        held = [np.flatnonzero(rows[:, t]) for t in range(rows.shape[1])]
        tiles.append((low, len(rows), [(None if len(at) * 2 > len(rows) else at, rows[slice(None) if len(at) * 2 > len(rows) else at, t].astype(kind)) for t, at in enumerate(held)]))
    scratch = np.empty((block, tile), dtype=kind)
    take = min(k, len(ids))
    for start in range(0, len(query_ids), block):
        part = queries[start : start + block].astype(kind)
        scores = np.zeros((len(part), len(ids)), dtype=kind)
        used = [np.flatnonzero(part[:, t]) for t in range(part.shape[1])]
        for low, n, postings in tiles:
            into = np.zeros((len(part), n), dtype=kind)
            for term, (at, weights) in enumerate(postings):
                if not len(used[term]) or not len(weights):
                    continue
                if at is None:
                    # Most rows hold the term: its postings are one dense column.
                    added = np.multiply(part[:, term, None], weights, out=scratch[: len(part), :n])
                    np.add(into, added, out=into)
                else:
                    with_term = used[term]
                    into[np.ix_(with_term, at)] += part[with_term, term, None] * weights
            scores[:, low : low + n] = into
        for i, row in enumerate(scores):
            mine = query_ids[start + i]
            lo, hi = np.searchsorted(ids, [mine, mine + 1])
            open_ids, row = (np.delete(ids, slice(lo, hi)), np.delete(row, slice(lo, hi))) if hi > lo else (ids, row)
            n = min(take, len(row))
            if not n:
                continue
            cut = (np.sort(row) if kind is object else np.partition(row, len(row) - n))[len(row) - n]
            above = np.flatnonzero((row > cut).astype(bool))
            level = np.flatnonzero((row == cut).astype(bool))[: n - len(above)]
            chosen = np.concatenate((above, level))
            yield int(mine), open_ids[chosen], row[chosen].astype(np.int64)


def _searcher(sent, width: int, k: int):
    def search(block):
        ids = np.asarray(block.column("vec_id"), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        found = list(_best(*sent.value, ids[order], _matrix(block.column("v"), width)[order], k))
        return pa.table([[f[0] for f in found], [f[1] for f in found], [f[2] for f in found]], schema=_OUT)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, per_block: int = 8_192, queries_at_once: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k candidates with the largest inner product.

    ``vectors`` has ``vec_id, v``. Every row is compared with every query but the one with its own id; ties go
    to the smaller id. Rows that repeat an id are the query's own as well; such an id is asked once,
    with the smallest of its vectors. Vectors of different
    length are compared as if filled up with zeros.

    Candidates are dealt into blocks. Queries go out in chunks of ``queries_at_once`` rows,
    a bound on what is broadcast; each chunk is one pass over the blocks. Within a block each query row scatters its weighted
    postings into a dense score array, partition selection keeps k, and the blocks'
    lists are merged by a window over at most k rows a block.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width, blocks = size["w"] or 0, parts_for(size["n"], per_block)
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = parts_for(queries.count(), queries_at_once)
    parts = []
    for chunk in range(chunks):
        mine = queries.filter(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(chunks)) == chunk).toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(mine.column("vec_id"), dtype=np.int64), _matrix(mine.column("v"), width)))

        parts.append(dealt.groupBy("block").applyInArrow(_searcher(sent, width, k), "query_id long, vec_ids array<long>, scores array<long>"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    rows = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select(
        "query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
