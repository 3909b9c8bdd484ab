"""Toxicity by averaged subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import mapped, offsets, slices, texts
from veilmark.session import checkpointed, small_batches

#: Lengths of the character n-grams; a word's ends count as characters.
GRAMS = (4, 5, 6)
BUCKETS = 1 << 16
#: Words of a passage, and words from one passage to the next.
PASSAGE, STEP = 24, 12
#: A passage with fewer n-grams is averaged as if zero vectors filled it up to so many.
LEAST_GRAMS = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else (32 if b in b"\t\n\r\x0b\x0c" else b) for b in range(256))


@dataclass
class Passages:
    """Bucket of every n-gram occurrence by position, and the passages as ranges of them."""

    grams: np.ndarray  # bucket numbers, ordered by position
    start: np.ndarray  # first n-gram of each passage
    stop: np.ndarray
    doc: np.ndarray  # document of each passage


def passages(parts: list[bytes]) -> Passages:
    """All passages of whole texts; a text without words has none. ASCII letters are folded."""
    whole = b" ".join([b"", *parts, b"", b" " * max(GRAMS)]).translate(_LOWER)
    raw = np.frombuffer(whole, np.uint8)
    space = raw == 32
    text_at = 1 + offsets(parts) + np.arange(len(parts) + 1)
    word_at = np.flatnonzero(~space[1:] & space[:-1]) + 1
    n = len(raw) - max(GRAMS)
    spaces = np.concatenate(([0], np.cumsum(space, dtype=np.int64)))
    hashed = raw[:n].astype(np.uint32) * np.uint32(2654435761)
    at, bucket = [], []
    for k in range(1, max(GRAMS)):
        hashed = (hashed ^ raw[k : n + k]) * np.uint32(16777619)
        hashed ^= hashed >> np.uint32(15)
        if k + 1 not in GRAMS:
            continue
        # Within one word: white space only at the first or last place.
        inner = spaces[k : n + k] == spaces[1 : n + 1]
        fine = np.flatnonzero(inner & ~(space[:n] & space[k : n + k]))
        at.append(fine + 1)  # the gram belongs to the word of its second character
        bucket.append((hashed[fine] ^ np.uint32(k * 0x9E37)) % np.uint32(BUCKETS))
    at, bucket = np.concatenate(at), np.concatenate(bucket)
    order = np.argsort(at, kind="stable")
    at, bucket = at[order], bucket[order].astype(np.int32)
    word_doc = np.searchsorted(text_at, word_at, side="right") - 1
    # A word that repeats the one before it adds nothing to a passage.
    word = np.searchsorted(word_at, at, side="right") - 1
    amount = np.bincount(word, minlength=len(word_at))
    total = np.bincount(word, bucket, minlength=len(word_at))
    again = np.zeros(len(word_at), dtype=bool)
    again[1:] = (amount[1:] == amount[:-1]) & (total[1:] == total[:-1]) & (word_doc[1:] == word_doc[:-1])
    at, bucket = at[~again[word]], bucket[~again[word]]
    gram_at = np.concatenate((np.searchsorted(at, word_at), [len(at)]))
    first = np.searchsorted(word_doc, np.arange(len(parts)))
    words = np.searchsorted(word_doc, np.arange(len(parts)), side="right") - first
    count = np.where(words > 0, np.maximum(1, -(-(words - PASSAGE) // STEP) + 1), 0)
    doc = np.repeat(np.arange(len(parts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[doc] + nth * STEP
    end = np.minimum(begin + PASSAGE, first[doc] + words[doc])
    return Passages(bucket, gram_at[begin], gram_at[end], doc)


def passages_in_turn(parts: list[bytes], at_once: int = 1_000_000) -> Passages:
    """``passages`` of many texts, worked through in pieces so that its scratch arrays stay small."""
    found, first, low = [], 0, 0
    for i, size in enumerate([*np.cumsum([len(p) for p in parts]).tolist(), None]):
        if i == len(parts) or size - low >= at_once:
            stop = min(i + 1, len(parts))
            one = passages(parts[first:stop])
            found.append(Passages(one.grams, one.start, one.stop, one.doc + first))
            first, low = stop, size
    shift = np.cumsum([0] + [len(f.grams) for f in found])
    return Passages(
        np.concatenate([f.grams for f in found]), np.concatenate([f.start + s for f, s in zip(found, shift)]),
        np.concatenate([f.stop + s for f, s in zip(found, shift)]), np.concatenate([f.doc for f in found]),
    )


@dataclass
class Model:
    """Embedding of each bucket, softmax weights, and the calibration of a document's highest logit."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slope: float
    shift: float

    def gram_scores(self) -> tuple[np.ndarray, float]:
        """Softmax of two classes needs the difference only; averaging is linear, so each bucket has one number."""
        side = self.weights[:, 1] - self.weights[:, 0]
        return (self.vectors @ side).astype(np.float32), float(self.bias[1] - self.bias[0])


def passage_logits(found: Passages, gram_scores: np.ndarray, bias: float) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(gram_scores[found.grams], dtype=np.float64)))
    return (run[found.stop] - run[found.start]) / np.maximum(found.stop - found.start, LEAST_GRAMS) + bias


def highest(found: Passages, logits: np.ndarray, n_docs: int, empty: float) -> np.ndarray:
    """A document's highest passage logit; without words, ``empty``."""
    out = np.full(n_docs, -np.inf)
    np.maximum.at(out, found.doc, logits)
    return np.where(np.isinf(out), empty, out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _flat(found: Passages, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = found.stop[chosen] - found.start[chosen]
    row = np.repeat(np.arange(len(chosen)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(found.start[chosen], size)
    return found.grams[place], row, np.maximum(size, LEAST_GRAMS).astype(np.float32)


def train(parts: list[bytes], labels: np.ndarray, dim: int = 8, rounds: int = 6, seed: int = 11, rate: float = 0.5) -> Model:
    """Learn embeddings and softmax together on labelled texts.

    The first round takes every positive text's passages as positive. Later rounds keep the passage that scores highest, for
    positive and negative texts alike, next to random passages of negative ones: a label says
    that some passage is toxic, not that all are. AdaGrad; a last logistic fit turns a text's highest logit into a
    probability. With one class only, every text gets the class's share.
    """
    rng = np.random.default_rng(seed)
    found = passages_in_turn(parts)
    n = len(parts)
    share = float(np.clip(labels.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    vectors = (rng.random((BUCKETS, dim), dtype=np.float32) - 0.5) / dim
    weights = np.zeros((dim, 2), dtype=np.float32)
    weights[:, 1] = rng.normal(0, 0.5, dim)
    model = Model(vectors, weights, np.zeros(2, dtype=np.float32), 1.0, float(np.log(share / (1 - share))))
    if not len(found.grams) or labels.min() == labels.max():
        model.weights[:] = 0
        model.slope = 0.0
        return model
    seen_v, seen_w, seen_b = np.full((BUCKETS, dim), 1e-6, np.float32), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    truth = labels[found.doc]
    for turn in range(rounds):
        scores, bias = model.gram_scores()
        logits = passage_logits(found, scores, bias)
        order = np.lexsort((-logits, found.doc))
        top = order[np.concatenate(([True], np.diff(found.doc[order]) != 0))]
        negative = np.flatnonzero(truth == 0)
        if turn == 0:
            positive = np.flatnonzero(truth == 1)
            extra = rng.choice(negative, min(len(negative), 2 * len(positive)), replace=False)
            chosen = np.concatenate((positive, extra))
        else:
            extra = rng.choice(negative, min(len(negative), len(top)), replace=False)
            chosen = np.concatenate((top, extra))
        rng.shuffle(chosen)
        for a in range(0, len(chosen), 256):
            batch = chosen[a : a + 256]
            grams, row, size = _flat(found, batch)
            if not len(grams):
                continue
            y = truth[batch]
            mean = np.zeros((len(batch), dim), dtype=np.float32)
            np.add.at(mean, row, model.vectors[grams])
            mean /= size[:, None]
            z = mean @ model.weights + model.bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))[:, None]
            p[np.arange(len(y)), y] -= 1
            delta = (p * balance).astype(np.float32)
            grad_w, grad_b = mean.T @ delta, delta.sum(axis=0)
            used, back = np.unique(grams, return_inverse=True)
            down = (delta @ model.weights.T) / size[:, None]
            grad_v = np.zeros((len(used), dim), dtype=np.float32)
            np.add.at(grad_v, back, down[row])
            seen_v[used] += grad_v**2
            seen_w += grad_w**2
            seen_b += grad_b**2
            model.vectors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            model.weights -= (rate * 0.2 * grad_w / np.sqrt(seen_w)).astype(np.float32)
            model.bias -= (rate * 0.2 * grad_b / np.sqrt(seen_b)).astype(np.float32)
    scores, bias = model.gram_scores()
    x = highest(found, passage_logits(found, scores, bias), n, np.nan)
    x = np.where(np.isnan(x), np.nanmin(x), x)
    _calibrate(model, x, labels)
    return model


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic fit of the labels on the logit by Newton steps, on standardised values."""
    m, s = x.mean(), x.std() + 1e-9
    z, a, b = (x - m) / s, 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = a / s, b - a * m / s


def learning_sample(docs: DataFrame, labels: DataFrame, held_out, each: int = 1_500, longest: int = 20_000):
    """At most ``each`` labelled texts of each class, outside ``held_out``, of at most ``longest`` bytes:
    the rows whose ids hash lowest. The bound makes what reaches the driver at most 2 * each * longest bytes."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(~held_out & F.col("text").isNotNull() & (F.octet_length("text") <= longest)).withColumn("h", F.xxhash64("doc_id", "text"))
    # First the ids, then the texts of the chosen ones: 2 * each rows are the bound of what is broadcast.
    found = checkpointed(rows.select("doc_id", "h").distinct().join(known, "doc_id"))
    chosen = [found.filter(F.col("toxic") == label).orderBy("h", "doc_id").limit(each) for label in (0, 1)]
    picked = rows.select("doc_id", "h", "text").join(F.broadcast(checkpointed(chosen[0].union(chosen[1]))), ["doc_id", "h"])
    got = picked.groupBy("doc_id", "h", "toxic").agg(F.max("text").alias("text")).orderBy("toxic", "h", "doc_id").toArrow()
    return [t.encode() for t in got.column("text").to_pylist()], np.asarray(got.column("toxic"), dtype=np.int64)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``score`` (0 to 1) of every whole text, next to the columns ``keep``: the probability of its
    worst passage. Null and empty texts get the score of the least suspicious logit the model gives to no words."""
    spark = docs.sparkSession
    small_batches(spark)
    numbers, bias = model.gram_scores()
    sent = spark.sparkContext.broadcast((numbers, bias, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, start, slope, shift = sent.value
        for batch in slices(batches, limit=2_000_000):
            parts = texts(batch)
            found = passages(parts)
            logits = highest(found, passage_logits(found, grams, start), len(parts), min(start, 0.0) - 2.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(_sigmoid(slope * logits + shift))], names=[*keep, "score"]
            )

    wanted = docs.select(*keep, *([] if "text" in keep else ["text"]))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return wanted.mapInArrow(mapped(run), f"{head}, score double")
