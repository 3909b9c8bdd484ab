"""N-gram Jaccard self-join through a token-group matrix.

1. Texts become sets of hashed shingles; equal sets are one class from there on.
2. Every class sends the rarest-first prefix of its set to token shards. Classes that share too few
   prefix tokens with other classes for any link are done.
3. The others are partitioned into groups of similar sets (same smallest hash), each of bounded size, with the
   group key's most typical class in every part of a split group. Members are compared, linked classes fall
   to their root, and roots are partitioned again by other hashes.
4. The components reached are the groups of the token-group matrix, in parts of bounded
   size. A class that shares a prefix token with a part of another component is held against the
   part's token union; only where that bound allows a link is the part opened and compared exactly.
5. Components are merged over the links found there.

Shingles and sets are known by 64-bit hashes. What a step has written goes as soon as
nothing reads it any more. Nothing but 2^18 frequent tokens, a bit table and counts reaches the driver; a frequent token only changes the order in which prefixes are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cogrouped, grouped, mapped, parts_for, slices, texts
from veilmark.session import checkpointed, forget, let_go, written

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FREQUENT = 1 << 18
_BITS = 24
_MEMBERS = 64
_SEEDS = (0, 0x51ED270B27B4F3CF, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(parts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``words`` words each, or all words if there are fewer."""
    known: dict[bytes, int] = {}
    out = []
    for part in parts:
        mine = part.translate(_LOWER).split()
        for w in set(mine).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, mine), np.uint64, len(mine))
        n = min(words, len(h))
        key = np.zeros(len(h) - n + 1 if n else 0, dtype=np.uint64)
        for k in range(n):
            key = key * _BASE + h[k : len(h) - n + 1 + k]
        out.append(np.unique(_mix(key + np.uint64(n))))
    return out


def set_class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of a and b elements with Jaccard of at least ``percent``."""
    return -(-(percent * (a + b)) // (100 + percent))


def extra_tokens(n):
    """How many prefix tokens two sets must share, when the smaller one has n elements: 12 percent, 1 at least."""
    return np.maximum(1, -(-12 * n // 100))


def least_size(n, percent: int):
    """Size of the smallest set that can link with one of n elements."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    """Two linked sets share ``extra_tokens`` of the smaller one's size within such prefixes: of the
    elements of a set, at most n - least_size(n) are missing from the other."""
    return int(n - least_size(n, percent) + extra_tokens(n))


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpack(payload: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), kind)


# --- 1. sets --------------------------------------------------------------------------

_CENSUS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_CENSUS_DDL = "doc_id long, row_key long, n_shingles long, cls long, tokens array<long>"


def _census(words: int):
    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text; the first of a slice also has the tokens that three or more of its classes hold."""
        for batch in slices(batches):
            sets = shingle_sets(texts(batch), words)
            classes = [set_class(s) if len(s) else None for s in sets]
            once = {c: s for c, s in zip(classes, sets) if c is not None}
            tokens, n = np.unique(np.concatenate([*once.values(), np.empty(0, np.uint64)]), return_counts=True)
            often = np.repeat(tokens[n > 2], np.minimum(n[n > 2], 64)).view(np.int64)
            lists = [often.tolist() if i == 0 else None for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), pa.array(list(map(len, sets)), pa.int64()), pa.array(classes, pa.int64()),
                 pa.array(lists, pa.list_(pa.int64()))], schema=_CENSUS)

    return census


# --- 2. prefixes ------------------------------------------------------------------------

_PREFIX = pa.schema([("shard", pa.int32()), ("tokens", pa.binary()), ("cls", pa.binary()), ("size", pa.binary()), ("pos", pa.binary())])
_PREFIX_DDL = "shard int, tokens binary, cls binary, size binary, pos binary"
_RUNS = pa.schema([*_PREFIX, ("met", pa.binary()), ("times", pa.binary()), ("met_size", pa.binary())])
_RUNS_DDL = _PREFIX_DDL + ", met binary, times binary, met_size binary"


def _weights(tokens: np.ndarray, often: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if not len(often):
        return np.zeros(len(tokens), dtype=np.int64)
    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
    return np.where(often[at] == tokens, weight[at], 0)


def _prefixes(words: int, percent: int, shards: int, sent):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, weight = sent.value
        for batch in slices(batches):
            once = {set_class(s): s for s in shingle_sets(texts(batch), words) if len(s)}
            tokens, cls, size, pos = [], [], [], []
            for c, s in once.items():
                p = prefix_size(len(s), percent)
                w = _weights(s, often, weight)
                first = s[np.argsort(w, kind="stable")[:p]] if w.any() else s[:p]
                tokens.append(first)
                cls.append(np.full(p, c, dtype=np.int64))
                size.append(np.full(p, len(s), dtype=np.uint32))
                pos.append(np.arange(p, dtype=np.uint32))
            if not once:
                continue
            tokens, cls, size, pos = map(np.concatenate, (tokens, cls, size, pos))
            shard = (tokens % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, order[cut[s] : cut[s + 1]]) for s in range(shards) if cut[s] < cut[s + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), *(pa.array([_pack(x[o]) for _, o in rows], pa.binary()) for x in (tokens, cls, size, pos))],
                schema=_PREFIX)

    return prefixes


def _shared(percent: int):
    def shared(block):
        """The entries of tokens that two or more classes hold, where sizes and positions allow a link;
        and how many such tokens each class has here, whatever their positions."""
        col = lambda name, kind: np.concatenate([_unpack(p, kind) for p in block.column(name).to_pylist()])
        tokens, cls, size, pos = col("tokens", np.uint64), col("cls", np.int64), col("size", np.uint32), col("pos", np.uint32)
        order = np.lexsort((cls, tokens))
        tokens, cls, size, pos = tokens[order], cls[order], size[order].astype(np.int64), pos[order].astype(np.int64)
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])))
        tokens, cls, size, pos = tokens[new], cls[new], size[new], pos[new]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        length = np.diff(np.concatenate((start, [len(tokens)])))
        keep = np.repeat(length > 1, length)
        met, at, times = np.unique(cls[keep], return_index=True, return_counts=True)
        met_size = size[keep][at].astype(np.uint32)
        two = start[length == 2]
        room = 1 + np.minimum(size[two] - pos[two], size[two + 1] - pos[two + 1]) - 1
        never = room < least_overlap(size[two], size[two + 1], percent)
        keep[two[never]] = keep[two[never] + 1] = False
        tokens, cls, size, pos = tokens[keep], cls[keep], size[keep].astype(np.uint32), pos[keep].astype(np.uint32)
        number = block.column("shard")[0].as_py()
        return pa.table([[number], *([_pack(x)] for x in (tokens, cls, size, pos, met, times.astype(np.uint32), met_size))], schema=_RUNS)

    return shared


#: Least number of shards that classes are dealt to where their shared tokens are added up, and how many classes one may hold.
_CLASS_SHARDS = 64
_CLASSES_PER_SHARD = 2_000_000
_MET_DDL = "slot int, met binary, times binary, met_size binary"


def _live(runs: DataFrame, percent: int, classes: int) -> DataFrame:
    """``cls`` of the classes that share enough prefix tokens with others for any link.

    What a token shard knows of its classes goes out packed, one row for each shard of classes, so rows do
    not multiply by the number of classes; a shard of classes adds up and names those that reach the least number.
    """
    shards = parts_for(classes, _CLASSES_PER_SHARD, _CLASS_SHARDS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in zip(*(batch.column(n).to_pylist() for n in ("met", "times", "met_size"))):
                met, times, size = (_unpack(p, kind) for p, kind in zip(payload, (np.int64, np.uint32, np.uint32)))
                slot = (met.view(np.uint64) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(slot, kind="stable")
                cut = np.searchsorted(slot[order], np.arange(shards + 1))
                own = [(s, order[cut[s] : cut[s + 1]]) for s in range(shards) if cut[s] < cut[s + 1]]
                if own:
                    packed = (pa.array([_pack(x[o]) for _, o in own], pa.binary()) for x in (met, times, size))
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int32()), *packed], names=["slot", "met", "times", "met_size"])

    def added(block: pa.Table) -> pa.Table:
        col = lambda name, kind: np.concatenate([_unpack(p, kind) for p in block.column(name).to_pylist()])
        cls, at, back = np.unique(col("met", np.int64), return_index=True, return_inverse=True)
        times = np.bincount(back, col("times", np.uint32), len(cls)).astype(np.int64)
        smallest = -(-col("met_size", np.uint32)[at].astype(np.int64) * percent // 100)
        return pa.table([cls[times >= np.maximum(1, -(-smallest * 12 // 100))]], names=["cls"])

    met = runs.select("met", "times", "met_size").mapInArrow(dealt, _MET_DDL)
    return met.groupBy("slot").applyInArrow(added, "cls long")


# --- 3. groups ----------------------------------------------------------------------------

_SETS = pa.schema([("cls", pa.int64()), ("rank", pa.float64()), *((f"m{i}", pa.int64()) for i in range(len(_SEEDS))), ("tokens", pa.binary())])
_SETS_DDL = "cls long, rank double, " + ", ".join(f"m{i} long" for i in range(len(_SEEDS))) + ", tokens binary"


def _live_sets(words: int, bits, sent):
    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8))
        often, weight = sent.value
        for batch in slices(batches):
            once = {set_class(s): s for s in shingle_sets(texts(batch), words) if len(s)}
            rows = []
            for c, s in once.items():
                if not table[c & ((1 << _BITS) - 1)]:
                    continue
                least = [int(s[0])] + [int(_mix(s ^ np.uint64(seed)).min()) for seed in _SEEDS[1:]]
                rank = float((_weights(s, often, weight) > 0).mean())
                rows.append((c, rank, *(int(np.uint64(m).view(np.int64)) for m in least), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SETS)], schema=_SETS)

    return live


def _bit_table(classes: DataFrame) -> bytes:
    """One bit for each class of ``cls``, at the lowest bits of its hash: 2^24 bits, whatever the input."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << _BITS, dtype=np.uint8)
        for batch in batches:
            table[np.asarray(batch.column("cls")) & ((1 << _BITS) - 1)] = 1
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(np.packbits(table).tobytes())], pa.binary())], names=["bits"])

    out = np.zeros(1 << (_BITS - 3), dtype=np.uint8)
    for row in classes.select("cls").coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= _unpack(row["bits"], np.uint8)
    return out.tobytes()


def _marked(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets whose class may be among ``classes``, by a bit table: what a join need not move."""
    bits = sets.sparkSession.sparkContext.broadcast(_bit_table(classes))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(table[np.asarray(batch.column("cls")) & ((1 << _BITS) - 1)]))

    return sets.mapInArrow(keep, sets.schema)


def overlaps(sets: list[np.ndarray], width: int = 16_384) -> np.ndarray:
    """Intersection sizes of all pairs of a bounded group."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, back, n = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    shared = n[back] > 1
    owner, column = owner[shared], column[back][shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        out += held @ held.T
    return out.astype(np.int64)


_LINK = pa.schema([("cls", pa.int64()), ("root", pa.int64())])


def _cluster(percent: int):
    def cluster(block):
        """Links of one group: each linked class to its root, which is the group key's pivot where it takes part."""
        found: dict[int, tuple] = {}
        for c, r, p, t in zip(*(block.column(n).to_pylist() for n in ("cls", "rank", "pivot", "tokens"))):
            found[c] = (c == p, r, c, np.frombuffer(t, np.uint64))
        rows = sorted(found.values(), key=lambda x: (not x[0], -x[1], x[2]))
        if len(rows) < 2:
            return _LINK.empty_table()
        size = np.array([len(r[3]) for r in rows])
        both = overlaps([r[3] for r in rows])
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        out, left = [], list(range(len(rows)))
        while left:
            root, todo, rest = left[0], [left[0]], set(left[1:])
            while todo:
                at = todo.pop()
                near = [i for i in rest if linked[at, i]]
                rest.difference_update(near)
                todo += near
                out += [(rows[i][2], rows[root][2]) for i in near]
            left = sorted(rest)
        return pa.table([list(c) for c in zip(*out)], schema=_LINK) if out else _LINK.empty_table()

    return cluster


def _grouped(active: DataFrame, sets: DataFrame, key: str, percent: int) -> DataFrame:
    """One round: ``cls, root`` for classes linked within their group, as a written table. ``active`` has cls, rank and the key."""
    keys = active.groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("n"), F.max_by("cls", F.struct("rank", "cls")).alias("pivot")
    ).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / _MEMBERS))
    keys = written(keys, "group_keys")
    placed = active.select("cls", F.col(key).alias("key")).join(keys, "key")
    own = placed.select("cls", "key", "pivot", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    pivots = keys.select(F.col("pivot").alias("cls"), "key", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    places = written(own.unionByName(pivots).distinct(), "group_places")
    full = _marked(sets.select("cls", "rank", "tokens"), places).join(places, "cls")
    links = written(full.groupBy("key", "part").applyInArrow(grouped(_cluster(percent)), "cls long, root long").distinct(), "links")
    del full
    forget(keys, places)
    return links


# --- 4. token-group matrix --------------------------------------------------------------


def _asked(bits):
    """The live classes of each shard, without those that the bit table rules out."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            for number, payload in zip(batch.column("shard").to_pylist(), batch.column("cls").to_pylist()):
                cls = np.unique(_unpack(payload, np.int64))
                cls = cls[table[cls & ((1 << _BITS) - 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), number, np.int32)), pa.array(cls)], names=["shard", "cls"])

    return asked


_PAIR = pa.schema([("cls", pa.int64()), ("comp", pa.int64()), ("part", pa.int64())])


def _candidates(percent: int, tile: int = 512):
    def candidates(runs, known):
        """(class, part of another component) that meet at a token where sizes and positions allow a link."""
        if not runs.num_rows or not known.num_rows:
            return _PAIR.empty_table()
        col = lambda name, kind: np.concatenate([_unpack(p, kind) for p in runs.column(name).to_pylist()])
        tokens, cls = col("tokens", np.uint64), col("cls", np.int64)
        size, pos = col("size", np.uint32).astype(np.int64), col("pos", np.uint32).astype(np.int64)
        names = np.asarray(known.column("cls"))
        order = np.argsort(names)
        near = order[np.minimum(np.searchsorted(names, cls, sorter=order), len(names) - 1)]
        live = names[near] == cls
        if not live.any():
            return _PAIR.empty_table()
        tokens, cls, size, pos, at = tokens[live], cls[live], size[live], pos[live], near[live]
        comp, part, amount = (np.asarray(known.column(n))[at] for n in ("comp", "part", "amount"))
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        end = np.concatenate((start[1:], [len(tokens)]))
        mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start) if len(tokens) else []
        found: set[tuple[int, int, int]] = set()
        for a, b in zip(start[mixed].tolist(), end[mixed].tolist()):
            for low in range(a, b, tile):
                q, d = slice(low, min(b, low + tile)), slice(a, b)
                # The class of the smaller component asks.
                asks = (amount[q, None] < amount[None, d]) | ((amount[q, None] == amount[None, d]) & (comp[q, None] < comp[None, d]))
                room = np.minimum((size - pos)[q, None], (size - pos)[None, d])
                ok = asks & (comp[q, None] != comp[None, d]) & (room >= least_overlap(size[q, None], size[None, d], percent))
                i, j = np.nonzero(ok)
                found.update(zip(cls[q][i].tolist(), comp[d][j].tolist(), part[d][j].tolist()))
        return pa.table([list(c) for c in zip(*found)], schema=_PAIR) if found else _PAIR.empty_table()

    return candidates


def _open(percent: int):
    def opened(block):
        """Links of asking classes into one part, after the bound by the part's token union."""
        rows = list(zip(*(block.column(n).to_pylist() for n in ("asks", "cls", "tokens"))))
        members = {c: np.frombuffer(t, np.uint64) for asks, c, t in rows if not asks}
        if not members:
            return _LINK.empty_table()
        union = np.unique(np.concatenate(list(members.values())))
        out = []
        for q, t in {c: t for asks, c, t in rows if asks}.items():
            mine = np.frombuffer(t, np.uint64)
            at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
            inside = mine[union[at] == mine]
            if 100 * len(inside) < percent * len(mine):
                continue
            for c, theirs in members.items():
                if 100 * min(len(theirs), len(mine)) < percent * max(len(theirs), len(mine)):
                    continue
                both = len(np.intersect1d(inside, theirs, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    out.append((q, c))
                    break
        return pa.table([list(c) for c in zip(*out)], schema=_LINK) if out else _LINK.empty_table()

    return opened


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every end of ``a, b``: the smallest node reachable. Labels fall along links and
    then jump to their label's label, so a chain of n links takes about log n rounds."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = checkpointed(lower.join(up, "comp").select("node", F.least("comp", "above").alias("comp"), "was"))
        changed = jumped.filter("comp <> was").limit(1).count()
        labels = jumped.select("node", "comp")
        if not changed:
            return labels


def _residual(runs: DataFrame, comps: DataFrame, sets: DataFrame, bits, percent: int) -> DataFrame | None:
    """Links between components (``a, b`` are classes) as a written table, or None if no part had to be opened."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("amount"))
    known = written(
        comps.join(sizes, "comp").withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("amount") / _MEMBERS))), "component_parts"
    )
    told = runs.select("shard", "cls").mapInArrow(_asked(bits), "shard int, cls long").join(known, "cls")
    pairs = runs.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(cogrouped(_candidates(percent)), "cls long, comp long, part long")
    pairs = written(pairs.distinct(), "open_parts")
    if pairs.limit(1).count() == 0:
        forget(known, pairs)
        return None
    load = written(pairs.groupBy("comp", "part").agg(F.ceil(F.count("*") / 256).alias("turns")), "open_load")
    asking = pairs.join(load, ["comp", "part"]).select(
        "cls", "comp", "part", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("turns")).alias("turn"), F.lit(True).alias("asks")
    )
    members = known.join(load, ["comp", "part"]).select(
        "cls", "comp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks")
    )
    places = written(asking.unionByName(members), "open_places")
    full = _marked(sets.select("cls", "tokens"), places).join(places, "cls")
    links = full.groupBy("comp", "part", "turn").applyInArrow(grouped(_open(percent)), "cls long, root long")
    links = written(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), "opened_links")
    del full
    forget(known, pairs, load, places)
    return links


# --- the join -------------------------------------------------------------------------------


def row_key() -> Column:
    """Equal for rows of one id and text."""
    return F.xxhash64("doc_id", "text")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, row_key, n_shingles, comp, component_id`` of each row of ``doc_id, text``.

    Two texts link where 100 * intersection >= percent * union; ``component_id`` is the smallest doc_id reachable,
    ``comp`` another name of the component, null for empty sets.
    Null texts and texts without words have an empty set and their own id. Repeated rows are each
    returned; a null id takes part and never names a component unless it stands alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", row_key().alias("row_key"))
    census = written(docs.mapInArrow(mapped(_census(words)), _CENSUS_DDL), "census")
    rows = census.select("doc_id", "row_key", "n_shingles", "cls")
    top = census.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(_FREQUENT).toArrow()
    often, weight = np.asarray(top.column("t"), np.int64).view(np.uint64), np.asarray(top.column("n"), np.int64)
    order = np.argsort(often)
    sent = spark.sparkContext.broadcast((often[order], weight[order]))
    total, classes = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("cls")).first()
    shards = parts_for(total, 4_000_000, spark.sparkContext.defaultParallelism)
    prefixes = docs.select("text").mapInArrow(mapped(_prefixes(words, percent, shards, sent)), _PREFIX_DDL)
    runs = written(prefixes.groupBy("shard").applyInArrow(grouped(_shared(percent)), _RUNS_DDL), "runs", packed=True)
    del prefixes
    let_go(spark)
    alive = written(_live(runs, percent, classes), "live_classes")
    bits = spark.sparkContext.broadcast(_bit_table(alive))
    forget(alive)
    sets = written(docs.select("text").mapInArrow(mapped(_live_sets(words, bits, sent)), _SETS_DDL), "live_sets")

    marks = [f"m{i}" for i in range(len(_SEEDS))]
    live = checkpointed(sets.groupBy("cls").agg(F.max("rank").alias("rank"), *(F.max(m).alias(m) for m in marks)))
    active, comps = live, live.select("cls", F.col("cls").alias("comp"))
    for mark in marks:
        links = _grouped(active, sets, mark, percent)
        active = checkpointed(active.join(links.select("cls"), "cls", "left_anti"))
        moved = links.select(F.col("cls").alias("comp"), "root")
        comps = checkpointed(comps.join(moved, "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp")))
        forget(links)
    between = _residual(runs, comps, sets, bits, percent)
    forget(runs, sets)
    if between is not None:
        at = lambda side: comps.select(F.col("cls").alias(side), F.col("comp").alias(f"{side}_comp"))
        ends = between.join(at("a"), "a").join(at("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        final = components(ends).withColumnRenamed("comp", "final")
        comps = comps.join(final, F.col("comp") == F.col("node"), "left").select("cls", F.coalesce("final", "comp").alias("comp"))
    first = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = first.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = written(named.join(lowest, "comp").select("cls", "comp", "component_id"), "class_components")
    if between is not None:
        forget(between)
    names = ["doc_id", "row_key", "n_shingles", "comp"]
    full = rows.filter("cls is not null").join(of_class, "cls").select(*names, F.coalesce("component_id", "doc_id").alias("component_id"))
    bare = rows.filter("cls is null").withColumn("comp", F.lit(None).cast("long"))
    return full.unionByName(bare.select(*names, F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: the one with the smallest id, a null id last.
    Rows that repeat an id and its text are one document. Texts without words all stay."""
    found = jaccard_components(docs, words, percent)
    own = "kept_key"
    while own in docs.columns:
        own = f"_{own}"
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("row_key"))
    kept = found.filter("comp is not null").groupBy("comp").agg(F.min_by("row_key", order).alias(own)).select(own)
    kept = kept.union(found.filter("comp is null").select("row_key")).distinct()
    kept = written(kept, "kept")
    forget(found)
    return docs.withColumn(own, row_key()).join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
