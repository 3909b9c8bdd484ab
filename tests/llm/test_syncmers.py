"""Closed syncmers against plain Python, and what they are good for."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from veilmark.llm import syncmers
from veilmark.llm.queries import QUERIES

MASK = (1 << 60) - 1


def number(word):
    crc = zlib.crc32(word.encode())
    (f1, p1), (f2, p2) = syncmers.HASHES
    return (crc * f1 % p1) << 30 | (crc * f2 % p2)


def rolled(numbers):
    out = 0
    for i, x in enumerate(numbers):
        by = 11 * i % 60
        out ^= (x << by & MASK) | (x >> (60 - by))
    return out


def anchors(text, k=5, s=2):
    words = re.findall(r"[^\x20\x09-\x0D]{1,32}", text or "")
    h = [number(w) for w in words]
    out = []
    for i in range(len(h) - k + 1):
        inner = [rolled(h[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, rolled(h[i : i + k])))
    return out or ([(0, number(" ".join(words)))] if words else [])


def print_of(text):
    return " ".join(f"{a & 0xFFFFFFFF:08x}" for _, a in anchors(text))


def like(a, b):
    a, b = ({x for _, x in anchors(t)} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def rows_of(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashlib.md5((d[1] or "").encode()).hexdigest()))
    out = []
    for (doc_id, text), (_, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), sha, print_of(text), print_of(edited), round(like(text, edited), 9), round(like(text, other), 9)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def got_of(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got_of(QUERIES["op13_syncmers"](spark, sf)) == rows_of(docs)


def test_odd_rows_null_ids_and_repeats(spark, tmp_path):
    docs = edge.documents(spark)
    many = spark.createDataFrame([(None, "same text for one id of all")] * 40 + [(7, None)] * 5, "doc_id long, text string")
    docs = docs.unionByName(many, allowMissingColumns=True).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = rows_of([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got_of(QUERIES["op13_syncmers"](spark, str(tmp_path))) == want
    for few in (edge.empty(spark), docs.limit(1)):
        assert syncmers.compared(few).count() == few.count()


@pytest.mark.parametrize("k,s", [(5, 2), (4, 1), (6, 3), (9, 2), (2, 1), (3, 2)])
def test_any_size_of_anchors(spark, k, s):
    rows = edge.documents(spark).select("text", "key", F.lit(1).alias("_w")).distinct()
    got = syncmers.with_anchors(rows, "text", "found", words=k, inner=s)
    assert got.columns == ["text", "key", "_w", "found"]
    for r in got.collect():
        assert [tuple(a) for a in r["found"]] == anchors(r["text"], k, s)


def test_anchors_stand_wherever_a_passage_stands(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage, f"some other words before {passage}", f"{passage} and after it"]
    rows = syncmers.with_anchors(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "a").collect()
    own = [{(a["place"], a["id"]) for a in r["a"]} for r in rows]
    assert own[0] <= own[2] and {(p + 4, i) for p, i in own[0]} <= own[1]
    assert 10 < len(own[0]) < 50


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op13_syncmers"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"MapIn|ArrowEval|BatchEval|FlatMapGroups", plan)
