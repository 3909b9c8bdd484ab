"""Text functions against plain Python."""

import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmark.functions import text as tx
from veilmark.operators import tfidf

TEXTS = [
    "Élan vital, naïve CAFÉ straße 12 a b_c",
    "ﬁnal ½ ² ａｂｃ 한국어 … ǆ Ελλάς",
    "x",
    "",
    None,
    "one two one two one",
    "Ünïcödé 中文字 日本 й Ё",
    "in\tin in in-in in's",
]


def folded(text):
    parts = unicodedata.normalize("NFKD", (text or "").lower())
    return "".join(c for c in parts if not unicodedata.combining(c))


def tokens(text):
    return re.findall(r"\b\w\w+\b", folded(text))


def grams(text):
    u = tokens(text)
    return u + [f"{a} {b}" for a, b in zip(u, u[1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_folding_and_words_match_python(docs):
    rows = tx.with_words(tx.with_folded(docs, "text"), "text").collect()
    for r in rows:
        assert r["folded"] == folded(r["text"])
        assert r["words"] == tokens(r["text"])


def test_counts_match_counter(docs):
    rows = tfidf.counted_terms(docs).collect()
    for r in rows:
        want = Counter(grams(TEXTS[r["doc_id"]]))
        assert {c["term"]: c["tf"] for c in r["counts"]} == dict(want)
        assert [c["term"] for c in r["counts"]] == sorted(want)


def test_runs_of_tokens(spark):
    df = spark.createDataFrame([(["aa", "bb", "cc"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(tx.runs_of(F.col("w"), 3)).collect()]
    assert got == [["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"], []]


@pytest.mark.parametrize("size", [1, 3, 5, 8, 1000])
def test_top_terms_exact_with_ties(spark, size):
    texts = ["aa bb aa bb cc", "aa bb dd", "cc dd cc dd", "ee ff gg hh", "aa bb", "zz yy zz yy zz yy"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ctf, docs_with = Counter(), Counter()
    for t in texts:
        ctf.update(grams(t))
        docs_with.update(set(grams(t)))
    want = sorted(((t, n, docs_with[t]) for t, n in ctf.items()), key=lambda x: (-x[1], x[0]))[:size]
    got = [tuple(r) for r in tfidf.top_terms(df, max_features=size).collect()]
    assert sorted(got) == sorted(want)


def test_tfidf_matches_brute_force(spark, docs):
    vocab = tfidf.fit_vocabulary(docs, max_features=12)
    known = {r["term"]: r for r in vocab.collect()}
    assert [r["feature_idx"] for _, r in sorted(known.items())] == list(range(12))
    for r in tfidf.vectors(docs, vocab).collect():
        counts = {t: n for t, n in Counter(grams(TEXTS[r["doc_id"]])).items() if t in known}
        raw = {
            known[t]["feature_idx"]: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + known[t]["df"])) + 1)
            for t, n in counts.items()
        }
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert r["idx"] == sorted(raw)
        assert r["val"] == pytest.approx([raw[i] / norm for i in sorted(raw)])
