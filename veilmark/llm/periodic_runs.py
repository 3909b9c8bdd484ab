"""Periodic runs of words, found as maximal pairs.

A maximal pair is two places of a text that share the next ``l`` words, but neither the word before nor the one
after. Where the places are ``d`` apart and ``l`` is at least a few times ``d``, the pair covers a stretch of period ``d``
that no neighbouring word extends: it is a run as it stands. The pairs are found bottom-up in the tree of
LCP intervals: every node keeps its places in order and in one list for each left word; where a child joins,
its places look for places of the others within reach and with another left word.

The suffix order of all texts of a block is made at once, by doubling, on the places that still have a
double within their text; nodes with less common words than any run needs are never built. Texts are
independent, so no row is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilmark.llm.common import offsets, slices, texts

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_common(length: int, exponent: int) -> int:
    """Least number of common words of a pair that makes a run of ``length`` words and ``exponent`` periods."""
    return min(max(length - d, (exponent - 1) * d) for d in range(1, max(2, length)))


class _Doubling:
    """Classes of the places of a block by their next 1, 2, 4, ... words, for places with a double only."""

    def __init__(self, code: np.ndarray, end: np.ndarray):
        n = len(code)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        # A place is known by its text (the place where the text ends) and its word.
        rank, live = self._split(np.arange(n), end * np.int64(n + 1) + code, np.zeros(n, np.int64), np.zeros(n, np.int64))
        step = 1
        while len(live):
            self.levels.append((live, rank[live].copy()))
            follow = live + step
            second = np.where(follow < end[live], rank[np.minimum(follow, n - 1)] + 1, 0)
            rank, live = self._split(live, rank[live] * np.int64(n + 1) + second, rank[live], rank)
            step *= 2
        self.rank = rank

    @staticmethod
    def _split(places: np.ndarray, key: np.ndarray, old: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give places of one class and different keys different ranks; returns ranks, and places that share one."""
        order = np.argsort(key, kind="stable")
        key, old, places = key[order], old[order], places[order]
        at = np.arange(len(key))
        new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        new_old = np.concatenate(([True], old[1:] != old[:-1])) if len(key) else np.zeros(0, bool)
        first, group = np.maximum.accumulate(np.where(new_key, at, 0)), np.maximum.accumulate(np.where(new_old, at, 0))
        rank[places] = old + first - group
        single = new_key & np.concatenate((new_key[1:], [True])) if len(key) else new_key
        return rank, np.sort(places[~single])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of common words from each place of ``a`` and its partner in ``b``."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            places, rank = self.levels[k]
            x, y = np.searchsorted(places, a), np.searchsorted(places, b)
            x, y = np.minimum(x, len(places) - 1), np.minimum(y, len(places) - 1)
            same = (places[x] == a) & (places[y] == b) & (rank[x] == rank[y])
            step = same * np.int64(1 << k)
            a, b, out = a + step, b + step, out + step
        return out


class _Node:
    """Places below a node of the tree: all in order, and in order for each left word."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}


def _joined(a: _Node, b: _Node, common: int, left: dict[int, int], length: int, exponent: int, found: dict) -> _Node:
    """Report the pairs between two children of a node with ``common`` words, and join them."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = common // (exponent - 1)
    for p in b.places:
        low, high = bisect_left(a.places, p - reach), bisect_right(a.places, p + reach)
        if low == high:
            continue
        own = left[p]
        if high - low <= len(a.classes):
            others = [q for q in a.places[low:high] if left[q] != own]
        else:
            others = []
            for word, places in a.classes.items():
                if word != own:
                    others += places[bisect_left(places, p - reach) : bisect_right(places, p + reach)]
        for q in others:
            apart = abs(p - q)
            if apart + common >= length:
                key = (min(p, q), apart + common)
                if apart < found.get(key, apart + 1):
                    found[key] = apart
    for word, places in b.classes.items():
        mine = a.classes.setdefault(word, places)
        for p in places:
            insort(a.places, p)
            if mine is not places:
                insort(mine, p)
    return a


def _runs_of_group(places: list[int], common: list[int], left: list[int], length: int, exponent: int, found: dict) -> None:
    """Bottom-up over the LCP intervals of ``places`` in suffix order; ``common[i]`` is shared by i - 1 and i."""
    options = (dict(zip(places, left)), length, exponent, found)
    node, stack = _Node(places[0], left[0]), []
    for i in range(1, len(places)):
        here = common[i]
        while stack and stack[-1][0] > here:
            depth, earlier = stack.pop()
            node = _joined(earlier, node, depth, *options)
        if stack and stack[-1][0] == here:
            stack[-1][1] = _joined(stack[-1][1], node, here, *options)
        else:
            stack.append([here, node])
        node = _Node(places[i], left[i])
    while stack:
        depth, earlier = stack.pop()
        node = _joined(earlier, node, depth, *options)


def runs_of_block(code: np.ndarray, start: np.ndarray, length: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of every text, by start; texts are stretches of ``code`` that begin at
    ``start`` (with the end of the last one added)."""
    sizes = np.diff(start)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    end = np.repeat(start[1:], sizes)
    floor = least_common(length, exponent)
    order = _Doubling(code, end)
    doubled = min(len(order.levels) - 1, floor.bit_length() - 1)
    if doubled < 0 or (1 << len(order.levels)) <= floor:
        return out
    places = order.levels[doubled][0]
    places = places[np.argsort(order.rank[places], kind="stable")]
    common = order.common(places[:-1], places[1:])
    left = np.where(np.isin(places, start), -1, code[places - 1])
    cuts = np.flatnonzero(np.concatenate(([True], common < floor, [True])))
    found: dict[tuple[int, int], int] = {}
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if high - low > 1:
            shared = [0, *common[low : high - 1].tolist()]
            _runs_of_group(places[low:high].tolist(), shared, left[low:high].tolist(), length, exponent, found)
    for (first, size), period in sorted(found.items()):
        text = int(np.searchsorted(start, first, side="right")) - 1
        out[text].append((first - int(start[text]), size, period))
    return out


def kept(size: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``size`` words stays when every run is cut to its first period."""
    change = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), length: int = 6, exponent: int = 4) -> DataFrame:
    """``keep`` of every row with ``runs`` and ``collapsed``, the text with every run cut to its first period.

    A run is a stretch of words with smallest period q, of ``length`` words and ``exponent`` times q or more, that no
    neighbouring word extends; ``runs`` holds ``start`` (word number from 0), ``length`` and ``period`` by start,
    then length. Words stand between ASCII blanks; ``collapsed`` joins those that stay by one blank.

    A null or empty text has no runs and an empty collapsed text. Ids are not read: null ids and equal rows are
    rows like others. Columns outside ``keep`` and ``text`` are not read, whatever their names; a kept column may not
    be called ``runs`` or ``collapsed``. An empty table gives no rows. A text is worked on whole, in one task.
    """
    if {"runs", "collapsed"} & set(keep) or exponent < 2:
        raise ValueError("kept columns may not be called runs or collapsed; a run has two periods at least")
    keep = list(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", runs {RUNS}, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            words = [t.split() for t in texts(part, "__text")]
            start = offsets(words)
            flat = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode()
            runs = runs_of_block(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), start, length, exponent)
            collapsed = []
            for text, own in zip(words, runs):
                if own:
                    stays = kept(len(text), own)
                    text = [text[i] for i in np.flatnonzero(stays)]
                collapsed.append(b" ".join(text))
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
            arrays = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(listed, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], [*keep, "runs", "collapsed"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(work, schema)
