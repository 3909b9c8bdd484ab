"""Byte-level BPE over a whole corpus: every distinct pre-token is encoded once."""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cogrouped, grouped, mapped, parts_for, slices

_PACKED = "block int, shard int, payload binary"
_PACKED_ARROW = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary())])


@lru_cache(maxsize=2)
def rank_table(path: str) -> list[bytes]:
    """Bytes of each token id, from a rank file; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count up from 0 without gaps")
    return [token for _, token in pairs]


def _squeeze(*parts: bytes) -> bytes:
    head = struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _spread_out(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<Q", raw)
    sizes = struct.unpack_from(f"<{n}Q", raw, 8)
    ends = list(itertools.accumulate(sizes, initial=8 * (n + 1)))
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _pack_strings(items: list[str]) -> tuple[bytes, bytes]:
    raw = [s.encode() for s in items]
    return np.fromiter(map(len, raw), np.uint32, len(raw)).tobytes(), b"".join(raw)


def _strings(sizes: bytes, body: bytes) -> list[str]:
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64))).tolist()
    return [body[a:b].decode() for a, b in zip(ends, ends[1:])]


def _cut(text: str, lengths: np.ndarray) -> list[str]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip(itertools.chain((0,), ends), ends)]


def _splitter(pattern: str, blocks: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for batch in slices(batches):
            ids, seen, dealt = batch.column("doc_id").to_pylist(), {}, {}
            for i, text in zip(ids, batch.column("text").to_pylist()):
                text = text or ""
                key = (i, xxhash.xxh3_64_intdigest(text))
                seen[key] = copy = seen.get(key, -1) + 1
                block = xxhash.xxh3_64_intdigest(f"{key}{copy}") % blocks
                words = find(text)
                if sum(map(len, words)) != len(text):
                    raise ValueError("the pattern must match every character")
                dealt.setdefault(block, []).append((i, text, np.fromiter(map(len, words), np.uint32, len(words))))
            out = []
            for block, docs in dealt.items():
                known = np.array([d[0] is not None for d in docs], dtype=np.uint8)
                numbers = np.array([d[0] or 0 for d in docs], dtype=np.int64)
                counts = np.array([len(d[2]) for d in docs], dtype=np.uint32)
                lengths = np.concatenate([d[2] for d in docs])
                out.append((block, _squeeze(known.tobytes(), numbers.tobytes(), counts.tobytes(), lengths.tobytes(), *_pack_strings([d[1] for d in docs]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int32()), pa.array([0] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())],
                schema=_PACKED_ARROW,
            )

    return split


def _documents(payloads: list[bytes]) -> Iterator[tuple[int | None, list[str]]]:
    """Id and pre-tokens of each document of a block."""
    for payload in payloads:
        known, numbers, counts, lengths, sizes, body = _spread_out(payload)
        lengths, start = np.frombuffer(lengths, np.uint32), 0
        for k, i, n, text in zip(
            known, np.frombuffer(numbers, np.int64).tolist(), np.frombuffer(counts, np.uint32).tolist(), _strings(sizes, body)
        ):
            yield (i if k else None), _cut(text, lengths[start : start + n])
            start += n


def _by_shard(words: Iterable[str], shards: int) -> dict[int, list[str]]:
    """The words in an order that depends on them alone."""
    dealt: dict[int, list[str]] = {}
    for word in words:
        dealt.setdefault(xxhash.xxh3_64_intdigest(word) % shards, []).append(word)
    for part in dealt.values():
        part.sort()
    return dealt


def _wanted(shards: int):
    def wanted(block):
        words: set[str] = set()
        for _, pieces in _documents(block.column("payload").to_pylist()):
            words.update(pieces)
        number = block.column("block")[0].as_py() if block.num_rows else 0
        dealt = _by_shard(words, shards)
        return pa.table(
            [[number] * len(dealt), list(dealt), [_squeeze(*_pack_strings(part)) for part in dealt.values()]], schema=_PACKED_ARROW
        )

    return wanted


def _encoder(ranks_path: str):
    def encode(shard):
        import tiktoken

        # One pattern that takes a whole pre-token, so that merges alone decide.
        ranks = {token: i for i, token in enumerate(rank_table(ranks_path))}
        merge = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        known: dict[str, list[int]] = {}
        out = []
        for payload in shard.column("payload").to_pylist():
            ids = []
            for word in _strings(*_spread_out(payload)):
                if word not in known:
                    known[word] = merge(word)
                ids.append(known[word])
            counts = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum()))
            out.append(_squeeze(counts.tobytes(), flat.tobytes()))
        return pa.table([shard.column("block"), shard.column("shard"), pa.chunked_array([out], pa.binary())], schema=_PACKED_ARROW)

    return encode


def _joiner(shards: int, finish, schema: pa.Schema):
    def join(docs, encoded):
        # Texts are cut once; from then on a text is the numbers of its pre-tokens.
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        texts = [
            (i, np.fromiter(map(number.__getitem__, pieces), np.uint32, len(pieces)))
            for i, pieces in _documents(docs.column("payload").to_pylist())
        ]
        dealt = _by_shard(number, shards)
        starts, sizes, ids, end = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [np.zeros(0, np.uint32)], 0
        for part, payload in zip(encoded.column("shard").to_pylist(), encoded.column("payload").to_pylist()):
            counts, flat = (np.frombuffer(p, np.uint32) for p in _spread_out(payload))
            at = np.fromiter(map(number.__getitem__, dealt[part]), np.int64, len(counts))
            starts[at], sizes[at] = end + np.cumsum(counts, dtype=np.int64) - counts, counts
            ids.append(flat)
            end += len(flat)
        flat = np.concatenate(ids)
        rows = finish((i, _ids_at(places, starts, sizes, flat)) for i, places in texts)
        return pa.table([list(c) for c in zip(*rows)] if rows else [[] for _ in schema], schema=schema)

    return join


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, finish, schema: pa.Schema, ddl: str, block_bytes: int) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = parts_for(total, block_bytes, docs.sparkSession.sparkContext.defaultParallelism)
    shards = blocks
    pieces = docs.select("doc_id", "text").mapInArrow(mapped(_splitter(pattern, blocks)), _PACKED)
    words = pieces.groupBy("block").applyInArrow(grouped(_wanted(shards)), _PACKED)
    ids = words.groupBy("shard").applyInArrow(grouped(_encoder(ranks_path)), _PACKED)
    return pieces.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(cogrouped(_joiner(shards, finish, schema)), ddl)


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = 24_000_000) -> DataFrame:
    """``doc_id, ids`` of every whole text; null and empty texts have no ids, repeated rows stay.

    The texts are split once, where they lie, and travel with the positions of their
    pre-tokens, compressed, to blocks of about ``block_bytes``. Each block sends its distinct
    pre-tokens to a shard chosen by the word's hash; the shard encodes each distinct word of the corpus
    once and answers with ids in the order asked; the block puts them back by position. A frequent
    word costs one entry a block. The block of a row depends only on its id, its text and, for
    equal rows, their count, so a third of all rows being equal still spreads evenly, and lost
    tasks rebuild the same blocks.
    """

    def finish(texts):
        return [(i, ids.tolist()) for i, ids in texts]

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _encoded(docs, ranks_path, pattern, finish, schema, "doc_id long, ids array<int>", block_bytes)


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, bytes`` of each row of ``doc_id, ids``; null ids give empty bytes. The token
    table is as large as the vocabulary file, which every worker reads once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank_table(ranks_path)
        for batch in batches:
            out = [decode_ids(ids or [], table) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(read, "doc_id long, bytes binary")


def put_back(words: list[str], ids: dict[str, list[int]]) -> list[int]:
    """The ids of a text: those of its pre-tokens, by position."""
    return list(itertools.chain.from_iterable(map(ids.__getitem__, words)))


def _ids_at(places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """:func:`put_back` by the numbers of the pre-tokens. Pre-token ``k`` has the ``sizes[k]`` of ``ids`` from ``starts[k]``."""
    n = sizes[places]
    ends = np.cumsum(n)
    return ids[np.arange(n.sum()) + np.repeat(starts[places] - ends + n, n)]


def _one_by_one(values: pa.LargeBinaryArray, ids: np.ndarray) -> memoryview:
    """The value of each id, one after another."""
    found = values.take(pa.array(ids))
    ends = np.frombuffer(found.buffers()[1], np.int64)
    return memoryview(found.buffers()[2] or b"")[: ends[len(ids)]] if len(ids) else memoryview(b"")


def digests(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = 24_000_000) -> DataFrame:
    """``encode`` followed by ``decode`` in the same block: the number of ids, and digests of
    the ids and of the bytes they decode to.

    Every text's ids are put back by position first; what is decoded is that list, id by id, through the
    token-byte table. Null and empty texts have no ids; repeated rows stay."""

    def finish(texts):
        table = rank_table(ranks_path)
        tokens, digits = pa.array(table, pa.large_binary()), pa.array([b"%d," % k for k in range(len(table))], pa.large_binary())
        rows = []
        for i, ids in texts:
            numbers, text = _one_by_one(digits, ids)[:-1], _one_by_one(tokens, ids)
            rows.append((i, len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(text).hexdigest()))
        return rows

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, ranks_path, pattern, finish, schema, ddl, block_bytes)
