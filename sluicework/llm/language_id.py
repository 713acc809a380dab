"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

* Features: letters in lower case, anything else as a blank; n-grams of 1 to 3 characters hashed into
  buckets. A feature is the bucket's share of the text's n-grams times its inverse document frequency.
* Document frequencies come from all learning documents, in one pass of one vector a task.
* The weights are fitted on a bounded sample with follow-the-regularised-leader (FTRL-proximal) under
  elastic-net penalties, which leaves most of them at exactly zero. A part of the sample that the fit
  does not see sets the temperature that calibrates the probabilities.
* Prediction is one Arrow pass over whole texts: a text's score is a sum of weights over its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of
from .sampling import bounded, learns

#: Buckets for n-grams of one, two and three characters.
BUCKETS = (1 << 12, 1 << 14, 1 << 15)
SIZE = sum(BUCKETS)
#: Documents a language that the weights and the temperature are fitted on.
PER_LANGUAGE = 400
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
#: Makes shares of n-grams, which are small, a fair size for the optimiser.
SCALE = 20.0
FOLDS, HELD = 4, 2
UNKNOWN = "und"
_PART = 2 << 20
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (SIZE + 1, languages); the last row is zero
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            table[ord(c)] = ord(c.lower()[0])
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three rows of buckets, one for each order; where each text starts; letters in each text).

    A text has one blank before and two behind it, so that no n-gram reaches into the next one. The
    n-grams that start at the last two blanks are in the bucket SIZE, which counts for nothing.
    """
    codes = np.frombuffer("".join(f" {t}  " for t in texts).encode("utf-32-le", "replace"), "<u4")
    c = _letters()[codes]
    sizes = np.array([len(t) + 3 for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(c)
    c = np.r_[c, np.uint32(32), np.uint32(32)]
    grams = np.empty((3, n), np.int32)
    h = c[:n] * _A
    grams[0] = h >> np.uint32(32 - 12)
    h = (h ^ (h >> np.uint32(15))) + c[1:n + 1] * _B
    grams[1] = ((h * _C) >> np.uint32(32 - 14)) + np.uint32(BUCKETS[0])
    h = (h ^ (h >> np.uint32(13))) * _C + c[2:] * _A
    grams[2] = ((h * _B) >> np.uint32(32 - 15)) + np.uint32(BUCKETS[0] + BUCKETS[1])
    grams[:, ends - 1] = SIZE
    grams[:, ends - 2] = SIZE
    return grams, starts, np.add.reduceat(c[:n] != 32, starts)


def parts(texts: pa.Array, most: int = _PART) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each."""
    start = total = 0
    for row, n in enumerate(pc.binary_length(texts).to_pylist()):
        if total and total + n > most:
            yield start, row
            start, total = row, 0
        total += n
    if len(texts):
        yield start, len(texts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task: documents seen and, for each bucket, those that have it."""
    seen, total = np.zeros(SIZE + 1, np.int64), 0
    for batch in batches:
        for a, b in parts(batch.column(0)):
            texts = batch.column(0).slice(a, b - a).to_pylist()
            grams, starts, _ = _grams(texts)
            stops = np.r_[starts[1:], grams.shape[1]]
            for s, e in zip(starts.tolist(), stops.tolist()):
                has = np.zeros(SIZE + 1, bool)
                has[grams[:, s:e].ravel()] = True
                seen += has
            total += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([seen.tobytes()])], ["n", "seen"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, seen = 0, np.zeros(SIZE + 1, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            n += row["n"]
            seen += np.frombuffer(row["seen"], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tobytes()])], ["n", "seen"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets of each (lang, key, text)."""
    for batch in batches:
        for a, b in parts(batch.column(2)):
            part = batch.slice(a, b - a)
            grams, starts, _ = _grams(part.column(2).to_pylist())
            stops = np.r_[starts[1:], grams.shape[1]]
            made = [np.unique(grams[:, s:e], return_counts=True) for s, e in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1),
                pa.array([i.astype("<i4").tobytes() for i, _ in made]), pa.array([k.astype("<i4").tobytes() for _, k in made])],
                ["lang", "key", "bucket", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of multinomial logistic regression by FTRL-proximal with elastic net.

    `rows`: (class, buckets, values). Rows are visited in an order shuffled with a fixed seed.
    """
    z, n = np.zeros((SIZE + 2, classes)), np.zeros((SIZE + 2, classes))
    order = np.random.default_rng(5)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return -(zi - np.sign(zi) * L1) * (np.abs(zi) > L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, bucket, value = rows[k]
            at, x = np.r_[bucket, SIZE + 1], np.r_[value, 1.0]
            w = weights(at)
            slope = _softmax(x @ w)
            slope[label] -= 1
            g = x[:, None] * slope
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(np.arange(SIZE + 2))
    w[SIZE] = 0
    return w[:SIZE + 1], w[SIZE + 1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the rows of `docs` where `learn` holds and the language is not null; None without such rows."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(doc_id).cast("long").alias("key"), text_of(text).alias("text")).where(
        F.col("text").rlike(r"\p{L}"))
    partial = rows.select("text").mapInArrow(_frequencies, "n long, seen binary")
    sums = partial.repartition(16).mapInArrow(_added, "n long, seen binary").collect()
    total = sum(r.n for r in sums)
    if not total:
        return None
    seen = np.sum([np.frombuffer(r.seen, np.int64) for r in sums], axis=0)
    idf = np.log((1 + total) / (1 + seen)) + 1
    idf[SIZE] = 0

    sample = bounded(rows, "lang", "key", per_language).mapInArrow(
        _vectors, "lang string, key long, bucket binary, n binary").collect()
    sample.sort(key=lambda r: (r.key, r.lang))
    languages = sorted({r.lang for r in sample})
    vectors = []
    for r in sample:
        bucket, count = np.frombuffer(r.bucket, "<i4"), np.frombuffer(r.n, "<i4").astype(float)
        own = bucket < SIZE
        bucket, count = bucket[own], count[own]
        vectors.append((languages.index(r.lang), bucket, SCALE * count / count.sum() * idf[bucket]))
    apart = vectors[::5] if len(vectors) >= 50 else vectors
    w, bias = fit([v for k, v in enumerate(vectors) if k % 5 or len(vectors) < 50], len(languages))
    logits = np.array([x @ w[b] + bias for _, b, x in apart])
    t = temperature(logits, np.array([c for c, _, _ in apart]))
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), bias, t)


def _predicted(model: Model | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for a, b in parts(batch.column(2)):
                texts = batch.column(2).slice(a, b - a).to_pylist()
                if model is None:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                grams, starts, letters = _grams(texts)
                sums = sum(np.add.reduceat(model.weights[g], starts, axis=0, dtype=np.float64) for g in grams)
                count = 3.0 * (np.array([len(t) for t in texts]) + 1)
                p = _softmax((sums / count[:, None] + model.bias) / model.temperature)
                best = p.argmax(1)
                names += [model.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), letters.tolist())]
                scores += np.where(letters > 0, p.max(1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:2 + with_text]],
                ["row", "held_out", "lang_pred", "score", "text"][:4 + with_text])
    return run


def predict(docs: DataFrame, model: Model | None, row: Column, held_out: Column, text: str = "text", with_text: bool = False) -> DataFrame:
    """(row, held_out, lang_pred, score), and the text if asked for: `row` is passed through."""
    rows = docs.select(row.alias("row"), held_out.alias("held_out"), text_of(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        _predicted(model, with_text), f"row {kind}, held_out boolean, lang_pred string, score double" + ", text string" * with_text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The language of every row of `docs`, learnt from the rows outside the held-out fold.

    A text that is null or has no letter is `und` with score 0, and so is every text if no row can be
    learnt from. A null id is in no fold: it is neither held out nor learnt from. Repeated rows get
    repeated results. Columns other than the three named may have any name.

    Returns doc_id, held_out (boolean), lang_pred, score (calibrated probability).
    """
    learn = learns(doc_id, FOLDS, HELD)
    model = train(docs, learn, doc_id, text, lang)
    held = F.coalesce(~learn, F.lit(False)) & F.col(doc_id).isNotNull()
    return predict(docs, model, F.col(doc_id).cast("long"), held, text).withColumnRenamed("row", "doc_id")


def in_known_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` whose text is in one of the languages learnt from them; all columns stay as they are."""
    learn = learns(doc_id, FOLDS, HELD)
    model = train(docs, learn, doc_id, text, lang)
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text}
    row = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in others.items()], F.lit(None).cast("void").cast("int").alias("_"))
    kept = predict(docs, model, row, F.lit(False), text, with_text=True).where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*[F.col("text").alias(c) if c == text else F.col(f"row.{others[c]}").alias(c) for c in docs.columns])
