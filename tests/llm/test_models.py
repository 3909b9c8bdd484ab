"""The three models: language model, perplexity, toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import edge
from veilmark import session
from veilmark.llm import common
from veilmark.llm import kneser_ney as kn
from veilmark.llm import pitman_yor as py
from veilmark.llm import toxicity as tox
from veilmark.llm.common import fold
from veilmark.session import written


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality ------------------------------------------------------------------------------


def base_counts(text):
    w = words(text)
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)


def assessed(spark, df, **kw):
    grams = written(kn.count_ngrams(df, **kw), "test-grams")
    return kn.judged(kn.measured(df, grams, kn.fit(grams, **{k: v for k, v in kw.items() if k == "order"}), **kw))


def test_base_counts_and_verdicts(spark):
    df = edge.documents(spark)
    got = assessed(spark, df, block_bytes=20_000).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_symbols_read"]
    want = Counter((r["doc_id"], *base_counts(r["text"]), len(r["text"] or "") + 1) for r in df.collect())
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["perplexity"] > 0
    none = edge.empty(spark)
    assert assessed(spark, none).count() == 0


def brute_kneser_ney(rows, order):
    """``half, lang -> probability(context, symbol)`` of dictionaries, straight from the formula."""
    edge_ = chr(0x10FFFF)
    half = lambda t: xxhash.xxh3_64_intdigest(t or "") & 1
    top = {0: Counter(), 1: Counter()}
    for text, lang in rows:
        padded = edge_ * (order - 1) + (text or "") + edge_
        for i in range(order - 1, len(padded)):
            top[half(text)][lang, padded[i - order + 1 : i + 1]] += 1
    models, symbols = {}, {}
    for h in (0, 1):
        for lang, gram in top[h]:
            symbols.setdefault(lang, set()).add(gram[-1])
    for h in (0, 1):
        level, levels = top[h], {}
        for k in range(order, 0, -1):
            levels[k] = level
            level = Counter((lang, gram[1:]) for lang, gram in level)
        cuts = {k: kn.discounts([sum(n == c for n in levels[k].values()) for c in (1, 2, 3, 4)]) for k in levels}
        follow = {}
        for k in levels:
            for (lang, gram), n in levels[k].items():
                follow.setdefault((lang, k, gram[:-1]), []).append(n)

        def probability(lang, gram, h=h, levels=levels, cuts=cuts, follow=follow):
            k = len(gram)
            if not k:
                return 1 / len(symbols[lang])
            lower, after = models[h](lang, gram[1:]), follow.get((lang, k, gram[:-1]))
            if not after:
                return lower
            n, take = levels[k][lang, gram], lambda c: cuts[k][min(c, 3) - 1] if c else 0.0
            return (n - take(n)) / sum(after) + sum(map(take, after)) / sum(after) * lower

        models[h] = probability

    def log10_ppl(text, lang):
        padded = edge_ * (order - 1) + (text or "") + edge_
        p = models[1 - half(text)]
        logs = [math.log10(p(lang, padded[i - order + 1 : i + 1])) for i in range(order - 1, len(padded))]
        return -sum(logs) / len(logs)

    return log10_ppl, models, symbols


@pytest.mark.parametrize("order", [2, 5])
def test_perplexity_and_verdict_by_brute_force(spark, order):
    df = edge.documents(spark, n=25)
    df = df.filter("text is null or length(text) < 3000").withColumn("lang", F.when(F.col("doc_id") % 7 == 1, "").otherwise(F.col("lang")))
    rows = [(r["text"], r["lang"]) for r in df.collect()]
    ppl, models, symbols = brute_kneser_ney(rows, order)
    for h in (0, 1):
        for lang, context in (("en", "lph"), ("en", "xx"), ("en", "qqq")):
            assert sum(models[h](lang, (context + c)[-order:]) for c in symbols["en"]) == pytest.approx(1)
    got = assessed(spark, df, order=order, block_bytes=2_000).collect()
    key = lambda i, v, k: (str(i), round(math.log10(v), 9), k)
    all_rows = df.collect()
    value = {(r["doc_id"], r["text"], r["lang"]): ppl(r["text"], r["lang"]) for r in all_rows}

    def median(values):  # of bins, the lower one where two are in the middle
        values = sorted(values)
        return values[(len(values) + 1) // 2 - 1]

    passing = {}
    failed = lambda t: base_counts(t)[0] < 50 or 100 * base_counts(t)[4] > 50 * base_counts(t)[0]
    for r in all_rows:
        if not failed(r["text"]):
            passing.setdefault(r["lang"], []).append(math.floor(value[r["doc_id"], r["text"], r["lang"]] / 0.002 + 0.5))
    want = []
    for r in all_rows:
        v, kept = value[r["doc_id"], r["text"], r["lang"]], False
        if not failed(r["text"]):
            middle = median(passing[r["lang"]])
            sigma = max(median([abs(b - middle) for b in passing[r["lang"]]]) * 0.002 * 1.4826, 0.005)
            kept = abs(v - middle * 0.002) <= sigma * 2.5 * math.sqrt(1 + 100 / base_counts(r["text"])[0])
        want.append((str(r["doc_id"]), round(v, 9), kept))
    assert sorted(key(r["doc_id"], r["perplexity"], r["kept"]) for r in got) == sorted(want)


def test_blocks_and_reruns_change_nothing(spark):
    df = edge.documents(spark)
    one = edge.pairs(assessed(spark, df), "doc_id", "perplexity", "kept")
    assert one == edge.pairs(assessed(spark, df, block_bytes=3_000), "doc_id", "perplexity", "kept")


def test_odd_text_leaves_its_band(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["stone", "river", "window", "garden", "letter", "summer", "morning"]) for _ in range(120 + i)) + f" v{i}" for i in range(80)]
    clean = [c.replace("stone", rng.choice(["stone", "light", "paper"]), 5) for c in clean]
    odd = ["".join(rng.choice("qxzjkv#%&|09") + (" " if i % 6 == 0 else "") for i in range(900)) for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in assessed(spark, docs).collect()}
    assert not any(got[i]["kept"] for i in (80, 81))
    assert sum(got[i]["kept"] or got[i]["base_failed"] for i in range(80)) >= 79


# --- Pitman-Yor -----------------------------------------------------------------------------


def test_base_columns_and_better_scores(spark):
    rng = random.Random(2)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(3)] for i in range(60)}

    def chain():
        w, out = "w0", []
        for _ in range(rng.randint(0, 80)):
            w = rng.choice(follow[w])
            out.append(w)
        return " ".join(out + ([f"rare{rng.randrange(10**6)}"] if rng.random() < 0.3 else []))

    rows = [(i, chain()) for i in range(300)] + [(400, None), (401, ""), (None, "W1 w2"), (402, "ZZ zz"), (402, "ZZ zz"), (403, "w1 " * 4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    got = py.score_texts(df.withColumn("learn", fold("doc_id", 7) != 2), block_bytes=20_000).collect()
    out_of = lambda i: (zlib.crc32(str(i).encode()) % 7 if i is not None else 0) == 2
    tokens = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
    c = Counter(w for i, t in rows if not out_of(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, out_of(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in got)


def test_no_rows_and_no_training(spark):
    empty = edge.empty(spark).withColumn("learn", F.lit(True))
    assert py.score_texts(empty).count() == 0
    row = py.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("learn", F.lit(False))).first()
    assert row["n_tokens"] == 3 and row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


def seatings(c, d):
    """Weight of all seatings of c customers by number of tables, one customer after another."""
    out = {1: 1.0}
    for i in range(1, c):
        more = Counter()
        for t, w in out.items():
            more[t] += w * (i - d * t)
            more[t + 1] += w
        out = more
    return out


def test_stirling_numbers_and_the_seating_distribution():
    d, c = 0.6, 6
    logs = py.stirling(d, 10)
    want = seatings(c, d)
    assert all(math.isclose(math.exp(logs[c, t]), want[t]) for t in want)
    level, rng = py.Restaurant(d, 2.0), np.random.default_rng(0)
    n, parent = np.array([c]), np.array([0.3])
    weight = {t: w * 0.3**t * math.prod(2.0 + d * k for k in range(t)) for t, w in want.items()}
    total = sum(weight.values())
    drawn = Counter(int(py.seat(n, np.array([1]), parent, level, logs, rng)[0]) for _ in range(6_000))
    for t, w in weight.items():
        assert drawn[t] / 6_000 == pytest.approx(w / total, abs=0.03)
    p = py.predictive(np.array([5, 3, 0]), np.array([2, 1, 0]), np.array([0.5, 0.3, 0.2]), level)
    assert p.sum() == pytest.approx(1)


def test_pairs_of_rare_words_are_learnt(spark):
    """No word is too rare to be a context: 3,000 words of equal frequency, each with one successor."""
    rng = random.Random(6)
    follow = list(range(3_000))
    rng.shuffle(follow)

    def chain(k):
        w, out = rng.randrange(3_000), []
        for _ in range(k):
            out.append(f"w{w}")
            w = follow[w]
        return " ".join(out)

    rows = [(i, chain(100)) for i in range(400)]
    got = py.score_texts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("learn", fold("doc_id", 7) != 2)).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)


@pytest.mark.parametrize("a", [0.05, 4.0, 300.0, 4_000.0])
def test_tables_of_large_dishes_follow_the_exact_distribution(a):
    d, c = 0.75, 3_000
    logs, t = py.stirling(d, c), np.arange(1, c + 1)
    assert np.allclose(py.log_stirling(c, t, d), logs[c, 1:], rtol=0, atol=1e-7)
    weight = logs[c, 1:] + t * math.log(a)
    weight = np.exp(weight - weight.max())
    weight /= weight.sum()
    window, mine = py._large_window(c, math.log(a), d)
    mine = np.exp(mine - mine.max())
    got = np.zeros(c)
    got[window - 1] = mine / mine.sum()
    assert np.abs(got - weight).sum() < 1e-6
    drawn = py.draw_tables(np.full(200, c), np.full(200, a), d, np.random.default_rng(1), most=40)
    mean = (t * weight).sum()
    assert abs(drawn.mean() - mean) < 5 * math.sqrt((t**2 * weight).sum() - mean**2) / math.sqrt(200) + 1e-9


def test_known_and_unknown_words_add_up_to_one():
    counts = np.array([1, 1, 2, 5])
    model = py.Model(None, None, py.Restaurant(0.6, 1.0), int(counts.sum()), len(counts))
    assert (10 ** model.rare_log10(counts)).sum() + 10 ** model.rare_log10(np.array([0]))[0] == pytest.approx(1)


# --- toxicity ---------------------------------------------------------------------------------


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(3)
    calm = [f"{a}{b}" for a in ("gar", "win", "let", "sum", "mor") for b in ("den", "dow", "ter", "mer", "ning", "lo", "ta")]

    def text(bad):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 300))]
        for x in bad:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)

    insults = ["horribleperson", "dreadfulbeing", "nastycreature"]
    parts = [text([]) for _ in range(300)] + [text(rng.sample(insults, 2)) for _ in range(120)]
    model = tox.train([p.encode() for p in parts], np.array([0] * 300 + [1] * 120))
    rows = [(i, text([])) for i in range(50)] + [(100 + i, text(["horriblepersn", "DreadfulBeing!"])) for i in range(50)] + [(200, None), (201, ""), (None, "den"), (202, "gar " * 9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in tox.score(df, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum(got[i] >= 0.5 for i in range(50)) <= 1 and sum(got[100 + i] >= 0.5 for i in range(50)) >= 45
    assert got[200] < 0.5 and got[200] == got[201] and got[202] < 0.5


def test_toxicity_without_labels_or_rows(spark):
    df = edge.documents(spark)
    parts, truth = tox.learning_sample(df, edge.labels(spark), fold("doc_id", 5) == 0)
    assert len(parts) == len(truth) and set(truth.tolist()) == {0, 1}
    model = tox.train(*tox.learning_sample(df, edge.labels(spark).limit(0), fold("doc_id", 5) == 0))
    scores = {r["score"] for r in tox.score(df, model, ["doc_id"]).collect()}
    assert len(scores) == 1
    assert tox.score(edge.empty(spark), model, ["doc_id"]).count() == 0


def test_a_block_is_the_same_in_any_number_of_ranges(monkeypatch):
    parts = [" ".join(f"w{(i * i + k) % 31}" for k in range(i % 17)).encode() for i in range(60)]
    monkeypatch.setattr(py, "_RANGES", 1)
    whole = py._block(list(parts))
    monkeypatch.setattr(py, "_RANGES", 7)
    cut = py._block(list(parts))
    for name in ("hashes", "token", "ends", "context", "word", "pair"):
        assert getattr(whole, name).tolist() == getattr(cut, name).tolist(), name
    assert (whole.hashes[whole.word][whole.pair] == whole.hashes[whole.token]).all()


def test_scores_leave_only_the_answers_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(py, "_SLAB", 7)
    docs = spark.createDataFrame([(i, f"a b c w{i % 5} d", i % 3 > 0) for i in range(40)], "doc_id long, text string, learn boolean")
    out = py.score_texts(docs)
    assert {f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir() if any(f.glob("*.parquet"))} == {"answers"}
    assert out.count() == 40 and out.filter("score is null or score >= 0").isEmpty()
    table = py._table([py._row(py.WORDS, 0, k, np.arange(3)) for k in range(20)])
    assert max(b.num_rows for b in table.to_batches()) == py._CHUNK < 20 == table.num_rows


def test_packed_rows_travel_and_lie_in_small_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_folder", lambda spark: f"file://{tmp_path}")
    rng = np.random.default_rng(3)
    table = py._table([py._row(py.WORDS, k, 0, rng.integers(0, 2**63, 90_000)) for k in range(12)])
    assert max(b.num_rows for b in table.to_batches()) == 1 and table.num_rows == 12
    rows = spark.range(24, numPartitions=1).select("id", F.expr("repeat(char(65 + id), 1000000)").cast("binary").alias("body"))
    assert session.written(rows, "packed", packed=True).distinct().count() == 24
    (file,) = tmp_path.glob("packed-*/*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_row_groups > 4 and max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) < 6


def test_scoring_keeps_batches_small_and_gives_memory_back(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(64 << 20))
    try:
        docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
        model = tox.train([b"good words here", b"bad words here"], np.array([0, 1]), rounds=1)
        assert tox.score(docs, model, ["doc_id"]).count() == 2
        assert int(spark.conf.get(limit)) == 8 << 20
    finally:
        spark.conf.set(limit, before)
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.mapped(lambda batches: (b for b in batches))(iter([1, 2]))) == [1, 2] and calls == [1]
    assert common.grouped(lambda g: g + 1)(1) == 2 and common.cogrouped(lambda a, b: a + b)(1, 2) == 3 and calls == [1] * 3
