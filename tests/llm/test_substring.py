"""Chunks, their repeats, and the spans cut out."""

import random

import numpy as np
from tests.llm import edge
from veilmark.llm import substring_dedup as sd


def rolled(raw, gear):
    """The gear recurrence, byte by byte."""
    out, h = [], 0
    for b in raw:
        h = (2 * h + int(gear[b])) % 65_536
        out.append(h)
    return out


def test_hash_is_the_recurrence():
    gear, raw = sd.gear_table(), np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    assert sd.gear_hashes(raw, gear).tolist() == rolled(raw.tolist(), gear)


def test_chunks_cover_each_text_and_resist_shifts(spark):
    df = edge.documents(spark)
    for r in sd.chunks(df).join(df.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        text = r["text"] or ""
        assert "".join(text[a:b] for a, b in zip(r["starts"], r["ends"])) == text
        assert sum(r["words"]) == len(text.split())
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2_000)).encode()
    def pieces(t):
        cuts = sd.cut_points([t], sd.gear_table())[2]
        return {t[a:b] for a, b in zip(cuts, cuts[1:])}

    a, b = pieces(text), pieces(text[:5_000] + b"an insertion" + text[5_000:])
    assert len(a) > 200 and len(a - b) <= 3


def test_spans_of_shared_passages(spark):
    rng = random.Random(4)
    make = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passages = [make(60) for _ in range(20)]
    rows = [(i, f"{make(40)} {passages[i % 20]} {make(30)}") for i in range(60)] + [(100 + i, make(150)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = dict(rows)
    spans = sd.repeated_spans(df).collect()
    assert {r["doc_id"] for r in spans} == set(range(20, 60))
    for r in spans:
        piece = text[r["doc_id"]][r["start"] : r["end"]]
        assert r["first_doc_id"] == r["doc_id"] % 20 and piece in passages[r["doc_id"] % 20] + " " or piece.strip() in text[r["first_doc_id"]]
    left = {r["doc_id"]: r["text"] for r in sd.without_repeats(df).collect()}
    assert all(left[i] == text[i] for i in [*range(20), *range(100, 140)])
    assert all(len(left[i]) < len(text[i]) - 100 for i in range(20, 60))


def test_edge_cases(spark):
    df = edge.documents(spark)
    spans = sd.repeated_spans(df).collect()
    text = {r["doc_id"]: r["text"] for r in df.filter("doc_id is not null").collect()}
    for r in spans:
        if r["doc_id"] is not None:
            assert r["first_doc_id"] < r["doc_id"]
            assert text[r["doc_id"]][r["start"] : r["end"]].strip() in text[r["first_doc_id"]]
    assert sd.without_repeats(df).count() == df.count()
    assert sd.repeated_spans(edge.empty(spark)).count() == 0


def test_chunks_of_different_documents_are_not_one_span(spark):
    rng = random.Random(8)
    make = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    phrases = [make(10) for _ in range(40)]
    rows = [(i, f"{make(30)} {p} {make(30)}") for i, p in enumerate(phrases)]
    rows += [(100 + i, f"{make(30)} {phrases[i]} {phrases[i + 20]} {make(30)}") for i in range(20)]
    # Chunks of all their own that earlier documents hold, but never side by side.
    text = make(400).encode()
    cuts = sd.cut_points([text], sd.gear_table())[2].tolist()
    pieces = [text[a:b].decode() for a, b in zip(cuts, cuts[1:])]
    chunks = [r["digests"] for r in sd.chunks(spark.createDataFrame([(1, text.decode())], "doc_id long, text string")).collect()][0]
    assert len(chunks) == len(pieces) > 40
    rows += [(200 + k, "".join(pieces[k::2]) + " " + make(3)) for k in range(2)] + [(300, text.decode())]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in sd.repeated_spans(df).collect():
        assert any(texts[r["doc_id"]][r["start"] : r["end"]].strip() in texts[i] for i in texts if i < r["doc_id"])


def test_texts_without_id_and_of_one_id(spark):
    rng = random.Random(9)
    make = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passages = [make(60) for _ in range(12)]
    rows = [(i, f"{make(20)} {p} {make(20)}") for i, p in enumerate(passages)]
    later = [(i, f"{make(15 + 3 * k)} {p} {make(20)}") for k, p in enumerate(passages) for i in (None, 50)]
    spans = sd.repeated_spans(spark.createDataFrame(rows + later, "doc_id long, text string"))
    for want in (None, 50):
        got = [r for r in spans.collect() if r["doc_id"] == want]
        assert len(got) == 12 and all(r["words"] >= 40 for r in got)
        assert {r["first_doc_id"] for r in got} <= {*range(12), 50 if want is None else 0}  # texts without id also repeat those of id 50
    left = [r["text"] for r in sd.without_repeats(spark.createDataFrame(rows + later, "doc_id long, text string")).collect() if r["doc_id"] in (None, 50)]
    assert len(left) == 24 and all(len(t.split()) < 60 + 15 + 33 + 20 - 40 for t in left)
    for k, p in enumerate(passages):
        mine = [t for t in left if t.split()[0] in {x[1].split()[0] for x in later[2 * k : 2 * k + 2]}]
        assert len(mine) == 2 and all(p not in t and len(t.split()) < 15 + 3 * k + 20 + 20 for t in mine)


def test_columns_of_any_name_stay(spark):
    docs = edge.documents(spark)
    named = docs
    for name in ("spans", "span_id", "span_text", "text_key", "row", "start"):
        named = named.withColumn(name, edge.F.lit(f"own {name}"))
    out = sd.without_repeats(named)
    assert out.columns == named.columns and out.filter("spans = 'own spans' and row = 'own row' and text_key = 'own text_key'").count() == named.count()
    assert edge.pairs(out, "doc_id", "text") == edge.pairs(sd.without_repeats(docs), "doc_id", "text")
