"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import edge
from veilmark.llm import collocations
from veilmark.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000, cover=100):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    chosen = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), a in chosen.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) and 100 * a >= cover * counts[lang, p[i:j]]:
                    hidden.add((lang, p[i:j]))
    scored = []
    for (lang, p), a in chosen.items():
        if (lang, p) not in hidden:
            n = totals[lang]
            cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_odd_rows_as_by_hand(spark):
    docs = edge.documents(spark)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    for options in ({"least": 4}, {"least": 3, "longest": 3, "cover": 70}, {"least": 3, "top": 5}):
        got = collocations.collocations(docs, **options).select(*COLUMNS).collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows, **options))
    assert any(lang is None for _, lang in rows)


def test_ties_repeats_and_phrases_that_overlap_themselves(spark):
    rows = [("a a a a b. A a b", "en"), ("a a a a b. A a b", "en"), ("x y\tx  y, x y", None), ("x y", "und"), (None, "en"), ("", None), ("... ,", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, least=2).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2))


def test_empty_and_too_rare(spark):
    assert collocations.collocations(edge.empty(spark)).count() == 0
    docs = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    assert collocations.collocations(docs).count() == 0


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, n long")
    counts = spark.createDataFrame(
        [("en", "a", 2 * big, 1), ("en", "b", 3 * big + 1, 1), ("en", "a b", big, 2)], "lang string, phrase string, a long, words int"
    )
    row = collocations.scored(totals, counts).first()
    assert row["score"] == 1000 * big * 7 * big // (2 * big * (3 * big + 1))


def test_long_texts_are_read_in_stretches():
    text = "one two. three four five\nsix " * 50 + "x" * 500 + " y z. end"
    parts = [text, "", "and more, after it", "a b c d"]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    at = np.cumsum([0] + [len(p) for p in parts])
    for limit in (7, 40, 333, 10_000):
        cuts = list(collocations.stretches(data, at[1:], limit))
        assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == len(data)
        assert all(stop in at or data[stop - 1] in collocations.BREAKS for _, stop in cuts)
        assert limit == 10_000 or len(cuts) > 3
        found = Counter()
        for start, stop in cuts:
            low = np.searchsorted(at, start, side="right") - 1
            high = np.searchsorted(at, stop)
            words = collocations._Words(data[start:stop], np.maximum(at[low:high] - start, 0), np.zeros(high - low, np.int64), ["en"])
            for batch in words.batches(*words.phrases(2, None)):
                found.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
        want = Counter()
        for part in parts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", part):
                w = piece.split()
                want.update(" ".join(p) for p in zip(w, w[1:]))
        assert found == want


def test_a_word_in_several_languages_of_one_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["a b a b", "a b", None, "b a"], "lang": ["en", "de", "de", None]})
    (words,) = collocations._words(iter([batch]))
    rows = [r for b in words.batches(*words.phrases(2, None)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(rows) == [("de", "a b", 1), ("en", "a b", 2), ("en", "b a", 1), ("und", "b a", 1)]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    got = QUERIES["op11_collocations"](spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute([tuple(r) for r in docs], 100))


def test_counts_do_not_depend_on_partitions(spark):
    docs = edge.documents(spark)
    one, many = (edge.pairs(collocations.collocations(docs.repartition(n), least=3), *COLUMNS) for n in (1, 7))
    assert one == many and one
    assert docs.filter(F.col("text").isNull()).count()


def test_a_stretch_of_a_full_batch_is_small():
    """Memory of a worker follows the stretch, of which an executor has one a core."""
    text = np.frombuffer(b"some words of a text. " * 100, np.uint8)
    data, ends = np.tile(text, 10_000), np.arange(1, 10_001) * len(text)
    cuts = list(collocations.stretches(data, ends))
    assert cuts[-1][1] == len(data) and max(stop - start for start, stop in cuts) <= 8_000_000
