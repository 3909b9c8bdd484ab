"""Periodic runs against a search of every start and period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import edge
from veilmark.llm import periodic_runs
from veilmark.llm.queries import QUERIES


def brute(words, length=6, exponent=4):
    found = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(length, exponent * q):
                found.setdefault((i, size), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def block(texts, **options):
    names = {}
    code = np.array([names.setdefault(w, len(names)) for t in texts for w in t], np.int64)
    start = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return periodic_runs.runs_of_block(code, start, options.get("length", 6), options.get("exponent", 4))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=60), max_size=5))
def test_blocks_of_few_words(texts):
    for length, exponent in ((6, 4), (2, 2), (9, 3)):
        assert block(texts, length=length, exponent=exponent) == [brute(t, length, exponent) for t in texts]


def test_planted_runs_at_both_ends_and_inside_each_other():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abcx") for _ in range(rng.randint(1, 7))] * rng.randint(1, 3)
            at = rng.randint(0, len(text))
            text[at:at] = (unit * rng.randint(2, 9))[: rng.randint(1, 80)]
        texts.append(text)
    got = block(texts)
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 100


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], ["a"] * 9 + ["b"]])
def test_one_long_run(unit):
    text = (unit * 30_000)[:30_000]
    assert (0, 30_000, len(unit)) in block([["x"], text, text[:7]])[1]


def test_repeats_without_a_period_cost_little():
    rng = random.Random(1)
    line = [f"w{i}" for i in range(40)]
    text = [w for _ in range(2_000) for w in (*line, f"x{rng.random()}")]
    assert block([text]) == [[]]


def planted(doc_id, words):
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    stays = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha(lines.encode()), sha(b" ".join(stays)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_runs"](spark, sf).select(*COLUMNS).collect()
    assert edge.pairs(spark.createDataFrame(got), *COLUMNS) == sorted((row(*d) for d in docs), key=repr)


def test_odd_rows(spark, tmp_path):
    docs = edge.documents(spark).unionByName(edge.documents(spark, 3).withColumn("text", edge.F.repeat(edge.F.lit("go on "), 9)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_runs"](spark, str(tmp_path))
    want = sorted((row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert edge.pairs(got, *COLUMNS) == want
    found = periodic_runs.find_runs(docs, keep=["key", "n", "text"])
    assert found.columns == ["key", "n", "text", "runs", "collapsed"] and found.filter("key = 'extra'").count() == len(want)
    assert periodic_runs.find_runs(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs.withColumn("runs", edge.F.lit(1)), keep=["runs"])
