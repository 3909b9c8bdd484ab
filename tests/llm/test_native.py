"""Sharding and mixing."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from veilmark.llm import mixing, sharding
from veilmark.llm.common import word_count


def shard_rows(df):
    return df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), sharding.hash_bits(F.col("doc_id")).alias("h"))


def brute_shards(rows, limit):
    """(id, bytes) -> prefix of the bucket, splitting one bit at a time."""
    out = {}

    def split(members, prefix):
        if sum(b for _, b, _ in members) <= limit or len({h for _, _, h in members}) == 1:
            out.update({i: prefix for i, _, _ in members})
            return
        depth = len(prefix)
        for bit in "01":
            part = [m for m in members if format(m[2], "060b")[depth] == bit]
            if part:
                split(part, prefix + bit)

    members = [(i, b, int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)) for i, b in rows]
    split(members, "")
    return out


@pytest.mark.parametrize("limit", [200, 3_000, 10**9])
def test_shards_split_only_where_needed(spark, limit):
    df = edge.documents(spark)
    got = sharding.shard(shard_rows(df), limit).collect()
    assert len(got) == df.count()
    want = brute_shards([(r["doc_id"], r["bytes"]) for r in shard_rows(df).collect()], limit)
    assert all(want[r["doc_id"]] == r["shard"] and r["depth"] == len(r["shard"]) for r in got)
    held = defaultdict(list)
    for r in got:
        held[r["shard"], r["part"]].append(r["bytes"])
    for r in got:
        mine = held[r["shard"], r["part"]]
        assert sum(mine) == r["shard_bytes"]
        assert sum(mine) <= limit or (len(mine) == 1 and r["oversized"])


def test_a_repeated_key_is_dealt_out(spark):
    df = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit(10).cast("long").alias("bytes"), sharding.hash_bits(F.lit(7)).alias("h"))
    got = sharding.shard(df, 100).groupBy("shard", "part").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("s")).collect()
    assert sum(r["b"] for r in got) == 5_000 and max(r["b"] for r in got) <= 100 and all(r["b"] == r["s"] for r in got)


def test_empty_tables(spark):
    assert sharding.shard(shard_rows(edge.empty(spark)), 100).count() == 0
    assert mixing.mix(mix_rows(edge.empty(spark))).count() == 0
    assert mixing.taken_texts(edge.empty(spark)).count() == 0


def mix_rows(df):
    return df.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("content"))


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        level = (total - sum(cap * sizes[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= more


def test_mix_meets_targets(spark):
    df = edge.documents(spark)
    got = mixing.mix(mix_rows(df)).collect()
    assert len(got) == df.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
    again = mixing.mix(mix_rows(df.repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(i, "a", 10, str(i)) for i in range(20)] + [(100, "b", 4, "x"), (101, "c", 0, "y")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, content string")).collect()
    b = [r for r in got if r["source"] == "b"][0]
    assert b["taken"] == 12 and b["target"] == 12.0
    assert sum(r["taken"] for r in got) == 204
    assert [r["taken"] for r in got if r["source"] == "c"] == [0]


def test_taken_texts_follow_the_decisions(spark):
    df = edge.documents(spark)
    out = mixing.taken_texts(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.select("source", "text").collect():
        words[r["source"]] += len(r["text"].split())
    want = Counter()
    for r in mixing.mix(mix_rows(df)).collect():
        want[r["source"]] += r["taken"]
    assert words == want
