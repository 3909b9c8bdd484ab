"""Language model scores from a hierarchical Pitman-Yor model over all words.

A token is a word or the end of a text. Every token of the texts to learn from is a dish, and every token that
precedes another has a context restaurant. All context restaurants share one parent, the root, whose base has no atoms: each
known word sits there at one table, and every new table is an unknown word. All probabilities of known words and of
"unknown" add up to one, in every context.

Seatings come from Gibbs sweeps in which cells (context, word) are independent of each other: the parent's weights are
drawn from their Dirichlet distribution, and one gamma variable a context takes the place of its strength term. So
a frequent context needs no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cogrouped, grouped, mapped, parts_for, slices, texts
from veilmark.session import forget, let_go, small_batches, written

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The token that ends every text; no word holds a blank.
END = b" "
#: Packed arrays on their way between blocks, word shards and pair shards. ``origin`` is who is to be answered.
_ROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("origin", pa.int32()), *((c, pa.binary()) for c in "abcde"),
                  ("customers", pa.int64()), ("types", pa.int64()), ("mass", pa.float64())])
_DDL = "kind int, shard int, origin int, a binary, b binary, c binary, d binary, e binary, customers long, types long, mass double"
WORDS, PAIRS, CELLS, MESSAGE, REPLY, STATE, WORD_PLACES, PAIR_PLACES = range(8)


#: So many packed rows go from a task to Spark at once, or fewer of about so many bytes.
_CHUNK = 8
_CHUNK_BYTES = 1_000_000
#: A block's pairs are sorted in so many parts.
_RANGES = 8
#: So many of them are dealt to shards at once.
_SLAB = 500_000


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split() + [END]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _unpack(payload: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), kind)


def _row(kind: int, shard: int, origin: int, *arrays: np.ndarray, sums: tuple = (None, None, None)) -> tuple:
    return (kind, shard, origin, *map(_pack, arrays), *[None] * (5 - len(arrays)), *sums)


def _table(rows: list[tuple]) -> pa.Table:
    """The rows in chunks of a few, each of which goes back as a batch of its own."""
    chunks, room = [], 0
    for row in rows:
        size = sum(len(x) for x in row if isinstance(x, bytes))
        if not chunks or size > room or len(chunks[-1]) == _CHUNK:
            chunks.append([])
            room = _CHUNK_BYTES
        chunks[-1].append(row)
        room -= size
    return pa.concat_tables(pa.table([list(c) for c in zip(*part)], schema=_ROW) for part in chunks) if chunks else _ROW.empty_table()


def _plain(column: pa.ChunkedArray) -> list:
    """The values of a column; packed arrays stay where they lie."""
    return [x.as_buffer() for x in column] if pa.types.is_binary(column.type) else column.to_pylist()


def _listed(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(_plain(table.column(c)) for c in names)))


# --- counts ---------------------------------------------------------------------------


@dataclass
class Block:
    """A block's distinct tokens (sorted hashes), its distinct pairs of neighbours, and both as they follow in the texts."""

    hashes: np.ndarray
    token: np.ndarray  # number of each token of the texts
    ends: np.ndarray  # where each text ends among the tokens
    context: np.ndarray  # of each distinct pair
    word: np.ndarray
    pair: np.ndarray  # number of the pair that each token ends


def _block(parts: list[bytes]) -> Block:
    known: dict[bytes, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in mine), np.int32, len(mine)) for mine in map(tokens, parts)]
    hashes = np.fromiter(map(word_hash, known), np.uint64, len(known))
    del known
    hashes, place = np.unique(hashes, return_inverse=True)
    del parts
    ends = np.cumsum([len(i) for i in ids])
    token = place.astype(np.int32)[np.concatenate(ids)]
    del ids, place
    key = np.empty(len(token), dtype=np.int64)
    key[0], key[1:] = np.searchsorted(hashes, np.uint64(word_hash(END))), token[:-1]  # every text ends with END
    key *= len(hashes)
    key += token
    # Pairs are sorted a range of contexts at a time: what sorting needs besides the pairs is a fraction of them.
    back, pairs, before = np.empty(len(key), dtype=np.int32), [np.zeros(0, np.int64)], 0
    lines = np.linspace(0, len(hashes), _RANGES + 1).astype(np.int64) * len(hashes)
    for low, high in zip(lines, lines[1:]):
        at = np.flatnonzero((key >= low) & (key < high))
        own, number = np.unique(key[at], return_inverse=True)
        back[at] = number + before
        before += len(own)
        pairs.append(own)
    del key
    pairs = np.concatenate(pairs)
    return Block(hashes, token, ends, (pairs // len(hashes)).astype(np.int32), (pairs % len(hashes)).astype(np.int32), back)


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(shards)


def _pair_shard(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """By both tokens, so the pairs of a frequent context or word are spread over all shards."""
    mix = context * np.uint64(0x9E3779B97F4A7C15)
    mix = ((mix ^ (mix >> np.uint64(29))) + word) * np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(32)) % np.uint64(shards)


def _slabs(n: int) -> list[slice]:
    return [slice(i, i + _SLAB) for i in range(0, n, _SLAB)]


def _pair_shards(hashes: np.ndarray, context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair of a block, a slab at a time."""
    out = np.empty(len(context), dtype=np.uint32)
    for part in _slabs(len(context)):
        out[part] = _pair_shard(hashes[context[part]], hashes[word[part]], shards)
    return out


def _block_of(blocks: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal rows out to blocks by id and text; equal rows by their number as well."""
        for batch in slices(batches):
            ids, seen, dealt = batch.column("doc_id").to_pylist(), {}, {}
            for i, text, learn in zip(ids, texts(batch), batch.column("learn").to_pylist()):
                key = (i, word_hash(text))
                seen[key] = copy = seen.get(key, -1) + 1
                dealt.setdefault(word_hash(f"{key}{copy}".encode()) % blocks, []).append((i, learn, text))
            packed = []
            for rows in dealt.values():
                body = pa.table([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]],
                                schema=pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("text", pa.binary())]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, body.schema) as out:
                    out.write_table(body)
                packed.append(zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int32()), pa.array(packed, pa.binary())], names=["block", "payload"])

    return deal


def _rows(payloads: list[bytes]) -> tuple[list[int | None], list[bool], list[bytes]]:
    ids, learn, parts = [], [], []
    for payload in payloads:
        body = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
        ids += body.column("doc_id").to_pylist()
        learn += body.column("learn").to_pylist()
        parts += body.column("text").to_pylist()
    return ids, learn, parts


def _ask(shards: int):
    """A block's distinct tokens and distinct pairs with their counts in the texts to learn from, by shard."""

    def ask(block):
        number, rows = block.column("block")[0].as_py(), list(_rows(_plain(block.column("payload")))[1:])
        mine = _block(rows.pop())  # which lets go of the texts as soon as it has their tokens
        used = np.repeat(np.array(rows.pop(), dtype=bool), np.diff(mine.ends, prepend=0))
        n = np.bincount(mine.token[used], minlength=len(mine.hashes)).astype(np.uint32)
        m = np.bincount(mine.pair[used], minlength=len(mine.context)).astype(np.uint32)
        hashes, context, word = mine.hashes, mine.context, mine.word
        del mine, used
        of_word, of_pair = _word_shard(hashes, shards), _pair_shards(hashes, context, word, shards)
        out = []
        for s in range(shards):
            w, p = of_word == s, of_pair == s
            if w.any():
                out.append(_row(WORDS, s, number, hashes[w], n[w]))
            if p.any():
                out.append(_row(PAIRS, s, number, hashes[context[p]], hashes[word[p]], m[p]))
        return _table(out)

    return ask


def _joined(asked: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a shard in order of context and word, their counts, and the place of each asked pair."""
    context, word, n = (np.concatenate([np.zeros(0, k), *(_unpack(r[i], k) for r in asked)]) for i, k in ((0, np.uint64), (1, np.uint64), (2, np.uint32)))
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    # Whole numbers below 2^53 add up exactly in float64.
    return context[new], word[new], np.bincount(back, n, minlength=int(new.sum())).astype(np.int64), back


def _messages(shard: int, shards: int, context: np.ndarray, word: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """Tables of cells added up by context and by word, for the word shards."""
    (us, at_u), (ws, at_w) = np.unique(context, return_inverse=True), np.unique(word, return_inverse=True)
    t, c = np.bincount(at_u, tables, minlength=len(us)).astype(np.int64), np.bincount(at_w, tables, minlength=len(ws)).astype(np.int64)
    of_u, of_w = _word_shard(us, shards), _word_shard(ws, shards)
    out = []
    for s in np.unique(np.concatenate((of_u, of_w))).tolist():
        u, w = of_u == s, of_w == s
        out.append(_row(MESSAGE, int(s), shard, us[u], t[u], ws[w], c[w]))
    return out


def _steps(places: np.ndarray) -> np.ndarray:
    """Differences of growing numbers, which pack well; undone by a running sum."""
    return np.diff(places, prepend=0).astype(np.uint32)


def _count(shards: int):
    """A shard's distinct tokens and counts, and its cells of two customers and more at one table each. Messages have the origin
    -1 for cells of one customer, which always sit at one table, and the shard's own for the others. Each block's
    tokens and pairs are kept as places among them, in the order asked."""

    def count(asked):
        shard, rows = asked.column("shard")[0].as_py(), _listed(asked, "kind", "origin", "a", "b", "c")
        words, pairs = ([r[1:] for r in rows if r[0] == k] for k in (WORDS, PAIRS))
        lists = [_unpack(r[1], np.uint64) for r in words]
        every, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]), return_inverse=True)
        n = np.bincount(back, np.concatenate([np.zeros(0, np.uint32), *(_unpack(r[2], np.uint32) for r in words)]), minlength=len(every)).astype(np.int64)
        out = [_row(WORDS, shard, 0, every, n)]
        for (block, *_), at in zip(words, np.split(back, np.cumsum([len(x) for x in lists])[:-1])):
            out.append(_row(WORD_PLACES, shard, block, _steps(at)))
        context, word, n, back = _joined([r[1:] for r in pairs])
        one, live = n == 1, n > 1
        number, ones = np.cumsum(live) - 1, np.ones(int(live.sum()), dtype=np.int64)
        sizes = [len(_unpack(r[3], np.uint32)) for r in pairs]
        for (block, *_), at in zip(pairs, np.split(back, np.cumsum(sizes)[:-1])):
            out.append(_row(PAIR_PLACES, shard, block, n[at].astype(np.uint32), _steps(number[at[live[at]]])))
        out.append(_row(CELLS, shard, shard, context[live], word[live], n[live], ones, 0 * ones))
        out += _messages(shard, shards, context[live], word[live], ones)
        out += [(*r[:2], -1, *r[3:]) for r in _messages(shard, shards, context[one], word[one], np.ones(int(one.sum()), dtype=np.int64))]
        return _table(out)

    return count


def _add(keys: np.ndarray, messages: list[tuple], tables: np.ndarray, customers: np.ndarray) -> None:
    for us, t, ws, c in messages:
        tables[np.searchsorted(keys, _unpack(us, np.uint64))] += _unpack(t, np.int64)
        customers[np.searchsorted(keys, _unpack(ws, np.uint64))] += _unpack(c, np.int64)


def _vocabulary(words, messages):
    """A word shard: tokens, their counts, and what cells of one customer add to tables (as context) and customers (as dish)."""
    ((shard, every, n),) = _listed(words, "shard", "a", "b")
    every, n = _unpack(every, np.uint64), _unpack(n, np.int64)
    t, c = np.zeros((2, len(every)), dtype=np.int64)
    _add(every, _listed(messages, "a", "b", "c", "d"), t, c)
    return _table([_row(WORDS, shard, 0, every, n, t, c, sums=(int(n.sum()), int((n > 0).sum()), None))])


# --- the model ------------------------------------------------------------------------


@dataclass
class Restaurant:
    """Discount and strength of one level."""

    discount: float
    strength: float


@lru_cache(4)
def stirling(discount: float, most: int) -> np.ndarray:
    """Logs of generalised Stirling numbers S(c, t) for c, t up to ``most``: the weight of
    all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * np.arange(most + 1), 1e-300))
        out[c + 1] = stay
        out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers."""
    y = x + 10.0
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(10):
        out = out - np.log(x + k)
    return out


def log_stirling(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """Logs of S(c, t) for one large c, from S(c, t) = c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t.

    The coefficient is a sum over powers of (1 - z)^d while its terms cancel little, that is for small t / c^d, and
    otherwise an integral along the vertical line through the saddle point, which is smooth there.
    """
    t = np.asarray(t, dtype=np.float64)
    out = np.zeros(len(t))
    few = t <= 2.4 * c**d
    if few.any():
        x = t[few][:, None]
        j = np.arange(1.0, min(x.max(), 120.0, c - 1.0) + 1)[None, :]
        inside = j <= x
        start = int(max(0, x.min() - j.size))
        factorials = _log_gamma(np.arange(start, int(x.max()) + 1) + 1.0)
        rest = factorials[np.where(inside, x - j, x).astype(np.int64) - start]
        size = factorials[x.astype(np.int64) - start] - rest + (_log_gamma(1 + d * j) - _log_gamma(j + 1) + _log_gamma(c - d * j) - _log_gamma(np.array(c + 1.0)))
        top = np.where(inside, size, -np.inf).max(axis=1, keepdims=True)
        signed = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * d * j) / np.pi
        out[few] = top[:, 0] + np.log((np.where(inside, np.exp(size - top), 0.0) * signed).sum(axis=1))
    many = ~few & (t < c)
    if many.any():
        x = t[many]

        def mean(p):  # of the tilted summands
            q = -np.expm1(-p)
            return d * q ** (d - 1) * np.exp(-p) / (1 - q**d)

        low, high = np.full(len(x), np.log(1e-14)), np.full(len(x), np.log(34.0))
        for _ in range(50):
            mid = (low + high) / 2
            over = mean(np.exp(mid)) > c / x
            low, high = np.where(over, mid, low), np.where(over, high, mid)
        p = np.exp(low)
        spread = x * (mean(p * 0.999) - mean(p * 1.001)) / (0.002 * p)
        reach = np.minimum(np.pi, 30 / np.sqrt(np.maximum(spread, 1e-9)))
        z = p[:, None] + 1j * reach[:, None] * np.linspace(0, 1, 161)[None, :]
        logs = x[:, None] * np.log(1 - (1 - np.exp(-z)) ** d) + z * c
        top = logs[:, 0].real
        weight = np.full(161, 1.0)
        weight[[0, -1]] = 0.5
        out[many] = top + np.log((np.exp(logs - top[:, None]).real * weight).sum(axis=1) * reach / 160 / np.pi)
    known = few | many
    out[known] += _log_gamma(np.array(c + 1.0)) - _log_gamma(t[known] + 1) - t[known] * np.log(d)
    return out


def _pick(logs: np.ndarray, rng) -> np.ndarray:
    """One index of each row, with probability proportional to exp."""
    run = np.cumsum(np.exp(logs - logs.max(axis=-1, keepdims=True)), axis=-1)
    return (run < rng.random(len(run))[:, None] * run[:, -1:]).sum(axis=1)


def _large_window(c: int, log_a: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """All t whose weight S(c, t) a^t is not below e^-32 of the largest, and the logs. The weights are log-concave, and
    fall off faster than those of one more than a Poisson number of mean a / d, to which they tend for large c."""
    weigh = lambda t: log_stirling(c, t, d) + t * log_a
    mean = np.exp(log_a) / d
    low, high = 1, int(min(c, mean + 2))
    most = int(min(c, mean + 10 * np.sqrt(mean) + 40))
    while high - low > 16:
        grid = np.unique(np.linspace(low, high, 13).astype(np.int64))
        best = int(np.argmax(weigh(grid)))
        low, high = int(grid[max(0, best - 1)]), int(grid[min(len(grid) - 1, best + 1)])
    t = np.arange(low, high + 1)
    mode = int(t[np.argmax(w := weigh(t))])
    ends = []
    for way, last in ((-1, mode - 1), (1, most - mode)):
        step = np.unique(np.minimum(last, 2 ** np.arange(0, 1 + int(np.log2(max(1, last))) + 1)))
        far = step[weigh(mode + way * step) < w.max() - 32] if last else step[:0]
        ends.append(mode + way * int(far[0] if len(far) else last))
    t = np.arange(ends[0], ends[1] + 1)
    return t, weigh(t)


def draw_tables(n: np.ndarray, a: np.ndarray, d: float, rng, most: int = 2_000) -> np.ndarray:
    """Numbers of tables of cells of n customers, each t with probability proportional to S(n, t) a^t. Up to ``most``
    customers S is tabulated; beyond that it is computed where the weight lies."""
    out = np.ones(len(n), dtype=np.int64)
    table, log_a = stirling(d, most), np.log(np.maximum(a, 1e-300))
    order = np.argsort(n, kind="stable")
    values, first = np.unique(n[order], return_index=True)
    for c, at in zip(values.tolist(), np.split(order, first[1:])):
        if c < 2:
            continue
        if c <= most:
            for i in range(0, len(at), max(1, 2_000_000 // c)):
                part = at[i : i + max(1, 2_000_000 // c)]
                out[part] = 1 + _pick(table[c, 1 : c + 1] + np.arange(1, c + 1) * log_a[part][:, None], rng)
        else:
            for i in at:
                t, logs = _large_window(c, log_a[i], d)
                out[i] = t[_pick(logs[None, :], rng)[0]]
    return out


def seat(n: np.ndarray, tables: np.ndarray, parent: np.ndarray, level: Restaurant, logs: np.ndarray, rng) -> np.ndarray:
    """One Gibbs sweep over a restaurant, dish after dish: what ``draw_tables`` does for all cells at once.

    Given the other dishes' tables, the number of tables of a dish of c customers has probability proportional to
    S(c, t) (strength + discount * others)^(rising t steps of discount) parent^t; seatings of the same t are summed by
    S, which ``logs`` tabulates up to its size.
    """
    out = tables.copy()
    most, d, theta = len(logs) - 1, level.discount, level.strength
    whole = tables.sum()
    prior = np.log(np.maximum(parent, 1e-300))
    for i in np.flatnonzero(n > 1):
        others, c = whole - out[i], int(n[i])
        w = (logs[c, 1 : c + 1] if c <= most else log_stirling(c, np.arange(1, c + 1), d)) + np.arange(1, c + 1) * prior[i] + np.cumsum(np.log(theta + d * (others + np.arange(c))))
        run = np.cumsum(np.exp(w - w.max()))
        new = min(c, 1 + int(np.searchsorted(run, rng.random() * run[-1])))
        whole += new - out[i]
        out[i] = new
    return out


def predictive(n: np.ndarray, tables: np.ndarray, parent: np.ndarray, level: Restaurant) -> np.ndarray:
    """Probability of each dish for the next customer."""
    new = level.strength + level.discount * tables.sum()
    return (n - level.discount * tables + new * parent) / (level.strength + n.sum())


def _sweep_words(turn: int, seed: int, low: Restaurant, root: Restaurant):
    """Tables of each context and customers of each root dish under the cells' seating; the gamma variable of
    each context and the root's weight of each dish (up to their common sum) go back to the cells that asked."""

    def sweep(vocabulary, messages):
        shard = vocabulary.column("shard")[0].as_py()
        ((every, fixed_t, fixed_c),) = _listed(vocabulary, "a", "c", "d")
        every, t, c = _unpack(every, np.uint64), _unpack(fixed_t, np.int64).copy(), _unpack(fixed_c, np.int64).copy()
        asked = _listed(messages, "origin", "a", "b", "c", "d")
        _add(every, [r[1:] for r in asked], t, c)
        rng = np.random.default_rng((seed, turn, 0, shard))
        x = rng.standard_gamma(low.strength / low.discount + t)
        g = np.where(c > 0, rng.standard_gamma(np.maximum(c, 1) - root.discount), 0.0)
        out = [_row(REPLY, origin, shard, x[np.searchsorted(every, _unpack(us, np.uint64))].astype(np.float32), g[np.searchsorted(every, _unpack(ws, np.uint64))].astype(np.float32))
               for origin, us, _, ws, _ in asked]
        out.append(_row(STATE, shard, turn, t.astype(np.uint32), c.astype(np.uint32), sums=(int(c.sum()), int((c > 0).sum()), float(g.sum()))))
        return _table(out)

    return sweep


def _sweep_cells(turn: int, seed: int, shards: int, low: Restaurant, mass: float, keep: bool):
    """New tables of all cells of a shard, given the contexts' gamma variables and the root's weights."""

    def sweep(cells, replies):
        shard = cells.column("shard")[0].as_py()
        ((context, word, n, _, total),) = _listed(cells, "a", "b", "c", "d", "e")
        context, word, n, total = _unpack(context, np.uint64), _unpack(word, np.uint64), _unpack(n, np.int64), _unpack(total, np.int64)
        (us, at_u), (ws, at_w) = np.unique(context, return_inverse=True), np.unique(word, return_inverse=True)
        of_u, of_w = _word_shard(us, shards), _word_shard(ws, shards)
        x, g = np.zeros(len(us)), np.zeros(len(ws))
        for s, a, b in _listed(replies, "origin", "a", "b"):
            x[of_u == s], g[of_w == s] = _unpack(a, np.float32), _unpack(b, np.float32)
        t = draw_tables(n, low.discount * x[at_u] * g[at_w] / mass, low.discount, np.random.default_rng((seed, turn, 1, shard)))
        out = [_row(CELLS, shard, shard, context, word, n, t, total + t if keep else total)]
        return _table(out + _messages(shard, shards, context, word, t))

    return sweep


@dataclass
class Model:
    """What is left of one sample of the seatings besides the tables: the root's sums."""

    contexts: Restaurant
    turn: int
    root: Restaurant
    customers: int
    types: int

    def rare_log10(self, n: np.ndarray) -> np.ndarray:
        """log10 of the root's probability of a word with n customers; 0 stands for any unknown word."""
        whole = self.root.strength + self.customers
        unknown = self.root.strength + self.root.discount * self.types
        return np.log10(np.where(n > 0, n - self.root.discount, unknown) / whole)


def fit(counted: DataFrame, shards: int, burn_in: int = 3, samples: int = 3, seed: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, list[Model]]:
    """Seat all training tokens by Gibbs sweeps: vocabulary, the cells' tables added up over the later sweeps, the
    sums of contexts and root dishes after each of these, and the root's totals.

    Only sums of a shard come to the driver. Cells lie in written tables, dealt by context and word; a sweep's table
    goes when the next one is written.
    """
    low, root = Restaurant(0.75, 5.0), Restaurant(0.5, 5.0)
    rng = np.random.default_rng(seed)
    words, message = counted.filter(F.col("kind") == WORDS), F.col("kind") == MESSAGE
    fixed = counted.filter(message & (F.col("origin") == -1))
    vocabulary = written(words.groupBy("shard").cogroup(fixed.groupBy("shard")).applyInArrow(cogrouped(_vocabulary), _DDL), "vocabulary", packed=True)
    cells = counted.filter((F.col("kind") == CELLS) | message & (F.col("origin") >= 0))
    states, models = [], []
    for turn in range(burn_in + samples + 1):
        sent = cells.filter(F.col("kind") == MESSAGE)
        sat = written(vocabulary.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(cogrouped(_sweep_words(turn, seed, low, root)), _DDL), "words_seated", packed=True)
        state = sat.filter(F.col("kind") == STATE)
        sums = state.agg(F.sum("customers").alias("c"), F.sum("types").alias("v"), F.sum("mass").alias("g")).first()
        customers, types = sums["c"] or 0, sums["v"] or 0
        if turn > burn_in:
            states.append(state)
            models.append(Model(low, turn, root, customers, types))
        if turn < burn_in + samples:
            mass = (sums["g"] or 0.0) + rng.standard_gamma(root.strength + root.discount * types)
            step = _sweep_cells(turn, seed, shards, low, mass, turn >= burn_in)
            mine, answers = cells.filter(F.col("kind") == CELLS), sat.filter(F.col("kind") == REPLY)
            seated = written(mine.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(cogrouped(step), _DDL), "cells", packed=True)
            if turn:
                forget(cells)
            if turn <= burn_in:
                forget(sat)
            cells = seated
    kept = states[0]
    for more in states[1:]:
        kept = kept.unionByName(more)
    return vocabulary, cells.filter(F.col("kind") == CELLS), kept, models


# --- scores ---------------------------------------------------------------------------

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _answer_words(places, known):
    """For each block's tokens: counts, and per sample tables as context and customers as dish."""
    rows = {(k, o): r for k, o, *r in _listed(known, "kind", "origin", "a", "b")}
    n = _unpack(rows.pop((WORDS, 0))[1], np.int64)
    states = [[_unpack(x, np.uint32) for x in rows[key]] for key in sorted(rows)]
    out = []
    for shard, block, steps in _listed(places, "shard", "origin", "a"):
        at = np.cumsum(_unpack(steps, np.uint32))
        out.append(_row(WORDS, shard, block, n[at], *(np.concatenate([s[i][at] for s in states]) for i in (0, 1))))
    return _table(out)


def _answer_pairs(samples: int, low: Restaurant):
    def answer(places, cells):
        """For each block's pairs: n - discount * tables, averaged over the samples; 0 for pairs that were not seen."""
        ((total,),) = _listed(cells, "e")
        seated, out = _unpack(total, np.int64) / samples, []
        for shard, block, n, steps in _listed(places, "shard", "origin", "a", "b"):
            n = _unpack(n, np.uint32)
            tables = (n > 0).astype(np.float64)
            tables[n > 1] = seated[np.cumsum(_unpack(steps, np.uint32))]
            out.append(_row(PAIRS, shard, block, (n - low.discount * tables).astype(np.float32)))
        return _table(out)

    return answer


def _scorer(sent, shards: int):
    def score(docs, answers):
        models, whole, types = sent.value
        rows = list(_rows(_plain(docs.column("payload"))))
        block = _block(rows.pop())
        ids, learn = rows
        of_word = _word_shard(block.hashes, shards)
        of_pair = _pair_shards(block.hashes, block.context, block.word, shards)
        n, p = np.zeros(len(block.hashes), dtype=np.int64), np.zeros(len(block.context))
        tables, customers = np.zeros((2, len(models), len(n)))
        for kind, s, a, b, c in _listed(answers, "kind", "shard", "a", "b", "c"):
            if kind == PAIRS:
                p[of_pair == s] = _unpack(a, np.float32)
            else:
                mine = of_word == s
                n[mine] = _unpack(a, np.int64)
                tables[:, mine], customers[:, mine] = (_unpack(x, np.uint32).reshape(len(models), -1) for x in (b, c))
        low = models[0].contexts
        new, rare = low.strength + low.discount * tables, [10 ** model.rare_log10(c) for model, c in zip(models, customers)]
        del of_pair, tables, customers
        for part in _slabs(len(p)):
            context, word = block.context[part], block.word[part]
            for t, c in zip(new, rare):
                p[part] += (t[context] * c[word]) / len(models)
            p[part] = np.log10(p[part] / (low.strength + n[context]))
        starts = np.concatenate(([0], block.ends[:-1])).astype(np.int64)
        size = np.diff(block.ends, prepend=0)
        known, base = (n > 0).astype(np.int64), np.log10((n + 1) / (whole + types + 1))
        sums = [np.add.reduceat(x[at], starts) for x, at in ((known, block.token), (base, block.token), (p, block.pair))]
        columns = [ids, [not use for use in learn], size, sums[0], [whole] * len(ids), sums[1], sums[2]]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return score


def score_texts(docs: DataFrame, block_bytes: int = 24_000_000, **fit_options) -> DataFrame:
    """Score all whole texts of ``doc_id, text, learn``; null texts read as empty.

    ``learn`` marks the texts to learn from. Texts travel once, compressed, to blocks of about
    ``block_bytes``; a block asks the word shards for its distinct tokens and the pair shards for its distinct pairs, so
    a frequent word or pair costs one entry a block. Words are known by 64-bit hashes. The block of a row depends
    on its id, text and, for equal rows, their number. What is broadcast is a few sums. Without training tokens
    every token is unknown.
    """
    docs = docs.select("doc_id", F.col("text"), F.coalesce("learn", F.lit(False)).alias("learn"))
    spark = docs.sparkSession
    small_batches(spark, 2 * _CHUNK_BYTES)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = shards = parts_for(size, block_bytes, spark.sparkContext.defaultParallelism)
    pieces = docs.mapInArrow(mapped(_block_of(blocks)), "block int, payload binary")
    asked = pieces.groupBy("block").applyInArrow(grouped(_ask(shards)), _DDL)
    counted = written(asked.groupBy("shard").applyInArrow(grouped(_count(shards)), _DDL), "counted", packed=True)
    del asked
    let_go(spark)
    vocabulary, cells, states, models = fit(counted, shards, **fit_options)
    sums = vocabulary.agg(F.sum("customers").alias("n"), F.sum("types").alias("v")).first()
    sent = spark.sparkContext.broadcast((models, sums["n"] or 0, sums["v"] or 0))
    words, pairs = counted.filter(F.col("kind") == WORD_PLACES), counted.filter(F.col("kind") == PAIR_PLACES)
    known = vocabulary.unionByName(states)
    answers = words.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(cogrouped(_answer_words), _DDL)
    answers = answers.unionByName(pairs.groupBy("shard").cogroup(cells.groupBy("shard")).applyInArrow(cogrouped(_answer_pairs(len(models), models[0].contexts)), _DDL))
    answers = written(answers.withColumnRenamed("origin", "block"), "answers", packed=True)
    forget(counted, known, cells)
    return pieces.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cogrouped(_scorer(sent, shards)), _SCORES)
