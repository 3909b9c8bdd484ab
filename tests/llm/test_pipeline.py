"""The pipeline's stages on the smallest tables, each against what it should decide."""

import hashlib
import shutil

import pytest

import corpus_pipeline
from tests.llm import edge
from veilmark.session import written


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    planted = [(90_000 + i, f"some harmless words number {i} and token = \"{i}0123456789abcdef0123456789abcdef0123456\" end", "en", "src1", 80) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_columns_stay(steps, spark, sf):
    want = dict(spark.read.parquet(f"{sf}/documents.parquet").dtypes)
    for name, (_, after) in list(steps.items())[:-1]:
        assert dict(after.dtypes) == want, name


def test_near_duplicates_leave_one_of_each(steps):
    from tests.llm.test_group_join import brute

    before, after = steps["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, c in brute(rows) if d == c)


def test_secrets_go_and_texts_stay(steps):
    from tests.llm.test_secrets import brute

    before, after = steps["secrets"]
    assert edge.pairs(before, "doc_id") == edge.pairs(after, "doc_id")
    assert any(brute(r["text"]) for r in before.collect())
    assert not any(brute(r["text"]) for r in after.collect())


def test_encoding_covers_what_the_mix_took(steps):
    mixed, encoded = steps["mixing"][1], steps["bpe"][1]
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in encoded.collect()) == want


def test_edge_rows_pass_every_stage(spark, sf, tmp_path):
    folder = str(tmp_path)
    shutil.copy(f"{sf}/labels.parquet", folder)
    for name, docs in (("odd", edge.documents(spark)), ("none", edge.empty(spark))):
        for step, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, folder), f"{name}_{step}")
        assert (docs.count() > 0) == (name == "odd")
