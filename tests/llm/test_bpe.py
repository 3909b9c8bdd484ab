"""Byte-level BPE against the tokenizer library, and the round trip."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken

from tests.llm import edge
from veilmark.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_digests_equal_the_library(spark, library):
    df = edge.documents(spark)
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode())] += 1
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN, block_bytes=4_000)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_encode_then_decode(spark, library):
    df = edge.documents(spark, n=10).dropDuplicates(["doc_id"])
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    text = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
    for r in encoded.collect():
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, RANKS).collect()} == text


def test_no_rows(spark):
    assert bpe.digests(edge.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decoding_reads_the_ids_in_their_order(spark):
    """Two ids of one row change places, and the decoded bytes change with them."""
    df = spark.createDataFrame([(1, "stone river garden"), (2, None), (3, "")], "doc_id long, text string")
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    right = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, RANKS).collect()}
    assert right == {1: b"stone river garden", 2: b"", 3: b""}
    turned = encoded.selectExpr("doc_id", "reverse(ids) AS ids")
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(turned, RANKS).collect()}[1] != right[1]
    table = bpe.rank_table(RANKS)
    known = {"stone": [17, 40], " river": [300]}
    put = bpe.put_back(["stone", " river", "stone"], known)
    assert put == [17, 40, 300, 17, 40] and bpe.decode_ids(put, table) == table[17] + table[40] + table[300] + table[17] + table[40]


def test_a_block_cuts_each_text_once(monkeypatch):
    texts = ["one two  three", "", None, "two two\nthree Straße 12,5", "one two  three"]
    rows = pa.RecordBatch.from_arrays([pa.array([3, 1, None, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    block = pa.Table.from_batches(list(bpe._splitter(public_tokenizers.PATTERN, 1)(iter([rows]))))
    wanted = bpe._wanted(2)(block)
    shards = [wanted.filter(pc.equal(wanted["shard"], s)) for s in (1, 0)]
    encoded = pa.concat_tables(bpe._encoder(path)(shard) for shard in shards)
    cuts, cut = [], bpe._cut
    monkeypatch.setattr(bpe, "_cut", lambda text, lengths: cuts.append(text) or cut(text, lengths))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    out = bpe._joiner(2, lambda docs: [(i, ids.tolist()) for i, ids in docs], schema)(block, encoded)
    assert sorted(cuts) == sorted(t or "" for t in texts)
    table = bpe.rank_table(path)
    decoded = {(i, bpe.decode_ids(ids, table).decode()) for i, ids in zip(out["doc_id"].to_pylist(), out["ids"].to_pylist())}
    assert out.num_rows == 5 and decoded == {(i, t or "") for i, t in zip([3, 1, None, 2, 3], texts)}
