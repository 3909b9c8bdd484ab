"""The phrase automaton against plain search, and the temperature, percentile and HTML repairs."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark.functions import html
from veilmark.operators import automaton, calibration, rank_select


def brute(phrases, rows, levels):
    out = np.zeros((len(rows), levels), int)
    for r, row in enumerate(rows):
        for level, p in phrases:
            out[r, level] += sum(bool(p) and row[i : i + len(p)] == p for i in range(len(row or [])))
    return out.tolist()


def lists(rows):
    return pa.array(rows, pa.list_(pa.string()))


tokens = st.lists(st.sampled_from("abc"), max_size=7)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), tokens), max_size=12), st.lists(st.lists(st.sampled_from("abcd"), max_size=40), max_size=6))
def test_small_cases(phrases, rows):
    assert automaton.build(phrases, 3).count(lists(rows)).tolist() == brute(phrases, rows, 3)


def test_stretches_and_null_rows():
    rng = random.Random(2)
    phrases = [(rng.randrange(6), [rng.choice("ab") for _ in range(rng.randint(1, 120))]) for _ in range(300)]
    rows = [[rng.choice("ab") for _ in range(n)] for n in (0, 1, 900, 1500)] + [["a"] * 700, ["x"], ["b", "x", "a"]]
    built = automaton.build(phrases, 6)
    assert built.longest > 64 and built.count(lists(rows)).tolist() == brute(phrases, rows, 6)
    assert built.count(lists([None, ["a"], None])).tolist() == brute(phrases, [[], ["a"], []], 6)
    assert built.count(lists(rows).slice(3, 2)).tolist() == brute(phrases, rows[3:5], 6)


def test_a_hundred_thousand_overlapping_phrases():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    phrases = list({(rng.randrange(6), tuple(rng.choice(words) for _ in range(rng.randint(1, 6)))) for _ in range(160_000)})[:100_000]
    row = [rng.choice(words) for _ in range(60_000)]
    began = time.time()
    got = automaton.build([(k, list(p)) for k, p in phrases], 6).count(lists([row, row[:17]]))
    assert len(phrases) == 100_000 and time.time() - began < 30
    for r, tokens_ in enumerate((row, row[:17])):
        seen = Counter(tuple(tokens_[i : i + n]) for n in range(1, 7) for i in range(len(tokens_) - n + 1))
        want = [sum(seen[p] for k, p in phrases if k == level) for level in range(6)]
        assert got[r].tolist() == want


@pytest.mark.parametrize(
    "values",
    [[0.1, 0.2, 0.3, math.inf], [0.1, 0.2, 0.3, math.nan], [-math.inf, 1.0, 2.0], [-math.inf, math.inf], [math.nan] * 3, [math.inf] * 2,
     [-1.7e308, 0.0, 1.7e308], [5e-324, 0.0, 1e-323], [7.5], [1.0, None, math.nan, -math.inf, math.inf, 3.0]],
)
def test_percentile_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "confidence double").repartition(2)
    order = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
    for percent in (0, 25, 50, 80, 100):
        place = (len(order) - 1) * percent / 100
        a, b, share = order[int(place)], order[min(int(place) + 1, len(order) - 1)], place % 1
        if share == 0 or a == b:
            want = a
        elif math.isnan(b) or math.isinf(a) and math.isinf(b):
            want = math.nan
        else:
            want = a if math.isinf(a) else b if math.isinf(b) else a * (1 - share) + b * share
        assert rank_select.exact_percentile(df, "confidence", percent).first()["cut"] == pytest.approx(want, nan_ok=True, abs=0 if abs(want) < 1 else None)


@pytest.mark.parametrize("true_t,seed", [(0.05, 1), (0.3, 2), (1.0, 3), (2.5, 4), (9.0, 5)])
def test_newton_finds_the_grid_minimum_in_eight_passes(spark, true_t, seed):
    rng = np.random.default_rng(seed)
    logits = rng.normal(size=(600, 4)) * 2
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    truth = [int(rng.choice(4, p=soft(z / true_t))) for z in logits]
    proba = [soft(z) for z in logits]
    df = spark.createDataFrame([([float(x) for x in p], y) for p, y in zip(proba, truth)], "proba array<double>, y int").coalesce(2)
    steps = calibration.temperature_steps(df)
    z = np.log(np.array(proba) + 1e-12)

    def nll(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean()

    low, high = 0.01, 10.0
    for _ in range(12):
        grid = np.exp(np.linspace(math.log(low), math.log(high), 41))
        k = int(np.argmin([nll(t) for t in grid]))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, 40)]
    assert len(steps) <= 8 and steps[-1].t == pytest.approx((low + high) / 2, rel=1e-6)
    assert steps[-1].nll == pytest.approx(nll(steps[-1].t), abs=1e-12) and steps[-1].n == 600
    assert calibration.fit_temperature(df) == steps[-1].t


def test_temperature_at_the_borders_and_without_rows(spark):
    schema = "proba array<double>, y int"
    right = spark.createDataFrame([([0.9, 0.1], 0), ([0.2, 0.8], 1)], schema)
    wrong = spark.createDataFrame([([0.9, 0.1], 1), ([0.2, 0.8], 0)], schema)
    assert calibration.fit_temperature(right) == pytest.approx(0.01) and calibration.fit_temperature(wrong) == pytest.approx(10.0)
    with pytest.raises(ValueError):
        calibration.fit_temperature(right.limit(0))


@pytest.mark.parametrize(
    "page,spans",
    [
        ("<script>a<script>b</script>c", "c"), ("x<style>never closed", "x"), ("<script src='>'>s</script>t", "t"),
        ("<textarea><b>x</b> &lt;</textarea>y", "<b>x</b> <\ny"), ("<textarea>open <i>", "open <i>"), ("<![CDATA[a]]>b", "b"),
        ("<!--[if IE]>no<![endif]-->yes", "yes"), ("<![if x]>seen<![endif]>", "seen"), ("a<b title=\"1 > 0\">c</b>d", "a\nc\nd"),
        ("a < b <3", "a < b <3"), ("cut <a href='x", "cut"), ("</ p>x", "x"), ("<scripted>text</scripted>", "text"),
        ("<SCRIPT>a</Script >b", "b"), ("&lt;script&gt;shown", "<script>shown"), ("<!-->a<!--->b<!-- c --!>d", "b\nd"), ("", ""),
    ],
)
def test_text_spans(page, spans):
    assert html.parsed_text(page) == spans


def test_text_spans_are_linear_and_name_what_they_cannot_read():
    began = time.time()
    html.parsed_text("<a " + 'x="1" ' * 200_000)
    html.parsed_text("<script>" * 50_000)
    assert time.time() - began < 5
    with pytest.raises(ValueError):
        html.parsed_text("<p>x</p><![foo[bar]]>")
