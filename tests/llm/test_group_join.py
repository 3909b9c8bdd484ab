"""Near-duplicate components against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
from tests.llm import edge
from veilmark import session
from veilmark.llm import group_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Component of each row: smallest id over rows that share a set or link."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    first = lambda i: min((d for d in ids[find(i)] if d is not None), default=None)
    return sorted(((d, len(s), first(i) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = group_join.jaccard_components(df)
    assert edge.pairs(got, "doc_id", "n_shingles", "component_id") == brute(rows)


def test_edge_cases(spark):
    df = edge.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    check(spark, rows)
    kept = group_join.one_of_each(df)
    assert kept.columns == df.columns
    want = {(d, c) for d, n, c in brute(rows) if n}
    assert {r["doc_id"] for r in kept.filter("doc_id is not null").collect() if shingles(r["text"])} == {c for d, c in want if d == c and d is not None}
    assert group_join.jaccard_components(edge.empty(spark)).count() == 0
    assert group_join.one_of_each(edge.empty(spark)).count() == 0


def test_many_near_copies_and_a_common_passage(spark, monkeypatch):
    """Groups larger than a part, chains just around the threshold, and a passage that unrelated texts share."""
    monkeypatch.setattr(group_join, "_MEMBERS", 6)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, passage = [], [word() for _ in range(60)]
    for g in range(4):
        base = [word() for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(40)]
    rows += [" ".join(word() for _ in range(50)) for _ in range(20)]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_overlaps_of_a_group():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(12)]
    got = group_join.overlaps(sets, width=64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(set(a.tolist()) & set(b.tolist()))


def test_a_column_of_any_name_is_kept(spark):
    docs = edge.documents(spark).withColumn("kept_key", edge.F.lit("mine")).withColumn("_kept_key", edge.F.lit(5))
    out = group_join.one_of_each(docs)
    assert out.columns == docs.columns and out.filter("kept_key = 'mine' and _kept_key = 5").count() == out.count() > 0


def test_what_is_no_longer_read_is_deleted(spark, tmp_path, monkeypatch):
    """Of all written tables the rows and their classes stay for the join's result, and the kept keys for the filter's."""
    docs = edge.documents(spark)
    left = lambda folder: {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if any(p.glob("*.parquet"))}
    for name, call, stays in (("join", group_join.jaccard_components, {"census", "class_components"}), ("keep", group_join.one_of_each, {"kept"})):
        folder = tmp_path / name
        folder.mkdir()
        monkeypatch.setattr(session, "work_folder", lambda spark: f"file://{folder}")
        out = call(docs)
        assert left(folder) == stays
        assert out.count() > 0
