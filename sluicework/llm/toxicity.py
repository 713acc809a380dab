"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: one looked up by the hash of the word, one that averages its character
trigrams, so that an unseen form of a known stem still looks familiar. Both directions read a window of
words; attention weighs their states, and a logistic unit scores the weighted state. A text is covered
by overlapping windows and has the score of its worst one, calibrated on texts the fit did not see.

Labels belong to whole texts, so training alternates: the windows that the present network (at first
log-odds of n-grams) finds worst stand for the toxic texts, and the worst and some other windows for
the clean ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of
from .language_id import parts
from .sampling import bounded, learns

#: Words of a window, and from one window to the next: neighbours share eight words.
WINDOW, STEP = 32, 24
WORD_BUCKETS, CHAR_BUCKETS, DIM = 1 << 14, 1 << 14, 8
HIDDEN = 8
#: Labelled documents that the network is fitted on: clean and toxic ones.
CLEAN, TOXIC = 2000, 800
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 128, 0.01
FOLDS, HELD = 5, 0
_KNOWN = 150_000
_WORD = re.compile(r"\w+")
_P = np.uint32(2654435761)


class Model(NamedTuple):
    weights: dict[str, np.ndarray]
    slope: float
    offset: float
    base: float  # score of a text without words


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the character trigrams of all words, where each word's trigrams start)."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    h = codes[:-2] * _P
    h = (h ^ (h >> np.uint32(15))) + codes[1:-1] * np.uint32(2246822519)
    h = (h ^ (h >> np.uint32(13))) * _P + codes[2:] * np.uint32(3266489917)
    bucket = ((h ^ (h >> np.uint32(16))) * _P >> np.uint32(32 - 14)).astype(np.int64)
    ends = np.cumsum(sizes)
    keep = np.ones(len(codes), bool)
    keep[ends - 1] = False
    keep[ends - 2] = False
    return bucket[keep[:-2]], np.r_[0, np.cumsum(sizes - 2)[:-1]]


def _buckets(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.int64) % WORD_BUCKETS


def windows(n: int) -> list[int]:
    """First words of the windows over n words: neighbours share a quarter of their words, the last one more, as it ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


# ---- the network --------------------------------------------------------------------------------

def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = 2 * DIM, HIDDEN

    def some(*shape: int, by: float) -> np.ndarray:
        return (r.standard_normal(shape) * by).astype(np.float32)

    w = {"word": some(WORD_BUCKETS, DIM, by=0.1), "char": some(CHAR_BUCKETS, DIM, by=0.1)}
    for side in "fb":
        w |= {f"W{side}": some(d, 3 * h, by=d ** -0.5), f"U{side}": some(h, 3 * h, by=h ** -0.5), f"b{side}": np.zeros(3 * h, np.float32)}
    return w | {"A": some(2 * h, h, by=(2 * h) ** -0.5), "v": some(h, by=h ** -0.5), "o": some(2 * h, by=(2 * h) ** -0.5), "c": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _scan(p: np.ndarray, U: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent layer over projected inputs p (steps, windows, 3h)."""
    h = HIDDEN
    state = np.zeros((p.shape[1], h), np.float32)
    states = np.empty((len(p), p.shape[1], h), np.float32)
    for t in range(len(p)):
        gates = _sigmoid(p[t][:, :2 * h] + state @ U[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(p[t][:, 2 * h:] + (r * state) @ U[:, 2 * h:])
        if keep is not None:
            keep.append((state, z, r, new))
        state = new + z * (state - new)
        states[t] = state
    return states


def _attend(states: np.ndarray, real: np.ndarray, w: dict) -> tuple[np.ndarray, ...]:
    """(logits, attention weights, pooled states, hidden attention) of states (steps, windows, 2h)."""
    seen = np.tanh(states @ w["A"])
    energy = np.where(real, seen @ w["v"], np.float32(-1e9))
    e = np.exp(energy - energy.max(0))
    share = e / e.sum(0)
    pooled = np.einsum("tn,tnd->nd", share, states)
    return pooled @ w["o"] + w["c"], share, pooled, seen


def logits(projected: dict[str, np.ndarray], index: np.ndarray, w: dict) -> np.ndarray:
    """Logits of windows; `index` (steps, windows) has rows of the projected words, -1 for no word."""
    real = index >= 0
    f = _scan(projected["f"][index], w["Uf"])
    b = _scan(projected["b"][index[::-1]], w["Ub"])[::-1]
    return _attend(np.concatenate([f, b], axis=2), real, w)[0]


def _back(p_keep: list, ds: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes (of the projected inputs, of U) from the slopes of a layer's states."""
    h = HIDDEN
    dp, dU = np.empty((len(p_keep), ds.shape[1], 3 * h), np.float32), np.zeros_like(U)
    carried = np.zeros_like(ds[0])
    for t in range(len(p_keep) - 1, -1, -1):
        state, z, r, new = p_keep[t]
        d = ds[t] + carried
        dnew = d * (1 - z) * (1 - new * new)
        dz = d * (state - new) * z * (1 - z)
        through = dnew @ U[:, 2 * h:].T
        dr = through * state * r * (1 - r)
        gates = np.concatenate([dz, dr], axis=1)
        dU[:, :2 * h] += state.T @ gates
        dU[:, 2 * h:] += (r * state).T @ dnew
        carried = d * z + through * r + gates @ U[:, :2 * h].T
        dp[t][:, :2 * h], dp[t][:, 2 * h:] = gates, dnew
    return dp, dU


def inputs(words: list[str], w: dict) -> np.ndarray:
    """The input vectors of distinct words."""
    bucket, first = _trigrams(words)
    sizes = np.diff(np.r_[first, len(bucket)])
    chars = np.add.reduceat(w["char"][bucket], first, axis=0) / sizes[:, None]
    return np.concatenate([w["word"][_buckets(words)], chars], axis=1).astype(np.float32)


def projections(words: list[str], w: dict) -> dict[str, np.ndarray]:
    """Projected inputs of `words` for either direction; one more row, the last, stands for no word."""
    x = inputs(words, w) if words else np.zeros((0, 2 * DIM), np.float32)
    x = np.concatenate([x, np.zeros((1, 2 * DIM), np.float32)])
    return {side: x @ w[f"W{side}"] + w[f"b{side}"] for side in "fb"}


def _step(w: dict, m: dict, s: dict, words: list[str], index: np.ndarray, target: np.ndarray, k: int) -> None:
    """One Adam step on a batch of windows; `index` (steps, windows) counts `words`, -1 for no word."""
    bucket, first = _trigrams(words)
    sizes = np.diff(np.r_[first, len(bucket)])
    x = np.concatenate([inputs(words, w), np.zeros((1, 2 * DIM), np.float32)])
    kept: dict[str, list] = {"f": [], "b": []}
    order = {"f": index, "b": index[::-1]}
    out = {side: _scan((x @ w[f"W{side}"] + w[f"b{side}"])[order[side]], w[f"U{side}"], kept[side]) for side in "fb"}
    states = np.concatenate([out["f"], out["b"][::-1]], axis=2)
    z, share, pooled, seen = _attend(states, index >= 0, w)
    dz = ((_sigmoid(z) - target) / len(z)).astype(np.float32)
    g = {"o": pooled.T @ dz, "c": dz.sum(keepdims=True)}
    dpool = dz[:, None] * w["o"]
    dstates = share[:, :, None] * dpool[None]
    dshare = np.einsum("nd,tnd->tn", dpool, states)
    denergy = share * (dshare - (share * dshare).sum(0))
    g["v"] = np.einsum("tn,tnh->h", denergy, seen)
    dseen = denergy[:, :, None] * w["v"] * (1 - seen * seen)
    g["A"] = np.einsum("tnd,tnh->dh", states, dseen, optimize=True)
    dstates += dseen @ w["A"].T
    dx = np.zeros_like(x)
    for side, part in (("f", dstates[:, :, :HIDDEN]), ("b", dstates[::-1, :, HIDDEN:])):
        dp, g[f"U{side}"] = _back(kept[side], part, w[f"U{side}"])
        rows = np.zeros((len(x), dp.shape[2]), np.float32)
        np.add.at(rows, order[side].ravel(), dp.reshape(-1, dp.shape[2]))
        g[f"W{side}"], g[f"b{side}"] = x.T @ rows, dp.sum((0, 1))
        dx += rows @ w[f"W{side}"].T
    dx = dx[:-1]
    sparse = {"word": (_buckets(words), dx[:, :DIM]), "char": (bucket, np.repeat(dx[:, DIM:] / sizes[:, None], sizes, axis=0))}
    for name, (at, slope) in sparse.items():
        own, back = np.unique(at, return_inverse=True)
        g[name] = np.zeros((len(own), DIM), np.float32)
        np.add.at(g[name], back, slope)
        _adam(w[name], m[name], s[name], g.pop(name), k, own)
    for name, slope in g.items():
        _adam(w[name], m[name], s[name], slope, k, slice(None))


def _adam(w: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray, k: int, at) -> None:
    m[at] = 0.9 * m[at] + 0.1 * g
    s[at] = 0.99 * s[at] + 0.01 * g * g
    w[at] -= RATE * (m[at] / (1 - 0.9 ** k)) / (np.sqrt(s[at] / (1 - 0.99 ** k)) + 1e-6)


# ---- training -----------------------------------------------------------------------------------

def _prior(texts: list[list[str]], labels: np.ndarray) -> list[np.ndarray]:
    """A first score for each word of each text: log-odds of its trigrams, by the texts that have them."""
    found = np.ones((2, CHAR_BUCKETS))
    for words, y in zip(texts, labels):
        if words:
            found[int(y), np.unique(_trigrams(list(dict.fromkeys(words)))[0])] += 1
    n = np.array([[np.sum(labels == 0)], [np.sum(labels == 1)]]) + 2
    share = found / n
    odds = np.log(share[1]) - np.log(share[0])
    out = []
    for words in texts:
        own = list(dict.fromkeys(words))
        if not own:
            out.append(np.zeros(0))
            continue
        bucket, first = _trigrams(own)
        value = dict(zip(own, np.add.reduceat(odds[bucket], first) / np.diff(np.r_[first, len(bucket)])))
        out.append(np.array([value[u] for u in words]))
    return out


def _window_index(ids: list[int], starts: list[int]) -> np.ndarray:
    index = np.full((WINDOW, len(starts)), -1, np.int64)
    row = np.array(ids, np.int64)
    for k, s in enumerate(starts):
        part = row[s:s + WINDOW]
        index[:len(part), k] = part
    return index


def _text_scores(texts: list[list[str]], w: dict) -> list[np.ndarray]:
    """The logit of every window of every text."""
    out = []
    for start in range(0, len(texts), 200):
        part = texts[start:start + 200]
        own = list(dict.fromkeys(u for words in part for u in words))
        rows = dict(zip(own, range(len(own))))
        p = projections(own, w)
        begins = [windows(len(words)) for words in part]
        index = np.concatenate([_window_index([rows[u] for u in words], b) for words, b in zip(part, begins)], axis=1)
        z = np.concatenate([logits(p, index[:, k:k + 8192], w) for k in range(0, index.shape[1], 8192)])
        out += np.split(z, np.cumsum([len(b) for b in begins])[:-1])
    return out


def fit(texts: list[list[str]], labels: np.ndarray, seed: int = 11) -> Model:
    """A calibrated network for texts (as words) of both classes."""
    r = np.random.default_rng(seed)
    base = (labels.sum() + 1) / (len(labels) + 2)
    apart = np.arange(len(texts)) % 5 == 0
    learn = [k for k in range(len(texts)) if not apart[k] and texts[k]]
    if not learn or len(set(labels[learn].tolist())) < 2:
        return Model(fresh(), 0.0, float(np.log(base / (1 - base))), float(base))
    used, marks = [texts[k] for k in learn], labels[learn]
    prior = _prior(used, marks)
    scores = [np.array([p[s:s + WINDOW].max() for s in windows(len(p))]) for p in prior]
    w = fresh()
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    k = 0
    for _ in range(ROUNDS):
        chosen: list[tuple[int, int, int]] = []
        for t, (z, y) in enumerate(zip(scores, marks)):
            begins = windows(len(used[t]))
            worst = np.argsort(-z, kind="stable")[:2 if y else 4].tolist()
            others = [] if y else r.choice(len(begins), min(4, len(begins)), replace=False).tolist()
            chosen += [(t, begins[i], int(y)) for i in dict.fromkeys(worst + others)]
        for _ in range(EPOCHS):
            for at in np.array_split(r.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
                spans = [used[chosen[i][0]][chosen[i][1]:chosen[i][1] + WINDOW] for i in at]
                own = list(dict.fromkeys(u for span in spans for u in span))
                rows = dict(zip(own, range(len(own))))
                index = np.full((WINDOW, len(spans)), -1, np.int64)
                for c, span in enumerate(spans):
                    index[:len(span), c] = [rows[u] for u in span]
                k += 1
                _step(w, m, s, own, index, np.array([chosen[i][2] for i in at], np.float32), k)
        scores = _text_scores(used, w)
    seen = [t for t in np.flatnonzero(apart) if texts[t]] or learn
    worst = np.array([z.max() for z in _text_scores([texts[t] for t in seen], w)])
    slope, offset = _calibrated(worst, labels[seen])
    return Model(w, slope, offset, float(base))


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on logits, drawn to (1, 0) as by 20 more texts.

    Newton steps, each shortened to a length of 0.5: classes that the logits separate have no finite fit
    of their own, and a full step could then overshoot.
    """
    a, b, pull = 1.0, 0.0, 20.0
    for _ in range(200):
        p = _sigmoid(np.clip(a * z + b, -30, 30))
        v = p * (1 - p)
        g = np.array([((p - y) * z).sum() + pull * (a - 1), (p - y).sum() + pull * b])
        H = np.array([[(v * z * z).sum() + pull, (v * z).sum()], [(v * z).sum(), v.sum() + pull]])
        step = np.linalg.solve(H, g)
        step /= max(1.0, 2 * np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.05)), float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", clean: int = CLEAN, toxic: int = TOXIC) -> Model:
    """A network fitted on at most `clean` and `toxic` labelled documents of the two classes.

    Of rows with one id the least text is learnt from, so that as many texts as ids reach the driver.
    """
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("y"))
    chosen = bounded(known, "y", "key", {0: clean, 1: toxic})
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), text_of(text).alias("text")).join(
        F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("text").alias("text")).collect()  # at most clean + toxic rows
    rows.sort(key=lambda r: r.key)
    return fit([words_of(r.text) for r in rows], np.array([r.y for r in rows], np.int64))


# ---- scoring ------------------------------------------------------------------------------------

def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.weights
        rows: dict[str, int] = {}
        p = projections([], w)

        def index_of(words: list[str]) -> np.ndarray:
            nonlocal p
            try:
                return np.array([rows[u] for u in words], np.int64)
            except KeyError:
                if len(rows) > _KNOWN:
                    rows.clear()
                    p = projections([], w)
                new = [u for u in dict.fromkeys(words) if u not in rows]
                more = projections(new, w)
                rows.update(zip(new, range(len(rows), len(rows) + len(new))))
                p = {side: np.concatenate([p[side][:-1], more[side]]) for side in "fb"}
                return np.array([rows[u] for u in words], np.int64)

        for batch in batches:
            scores: list[float] = []
            for a, b in parts(batch.column(2), 1 << 20):
                texts = [words_of(t) for t in batch.column(2).slice(a, b - a).to_pylist()]
                flat = index_of([u for words in texts for u in words])
                starts, counts, ends, at = [], [], [], 0
                for words in texts:
                    begins = windows(len(words)) if words else []
                    starts += [at + s for s in begins]
                    at += len(words)
                    ends += [at] * len(begins)
                    counts.append(len(begins))
                place = np.array(starts, np.int64)[None, :] + np.arange(WINDOW)[:, None]
                inside = place < np.array(ends, np.int64)[None, :]
                index = np.where(inside, flat[np.minimum(place, max(0, len(flat) - 1))] if len(flat) else 0, -1)
                z = np.concatenate([logits(p, index[:, k:k + 4096], w) for k in range(0, index.shape[1], 4096)] or [np.zeros(0)])
                z = _sigmoid(np.clip(model.slope * z.astype(np.float64) + model.offset, -30, 30))
                at = 0
                for n in counts:
                    scores.append(float(z[at:at + n].max()) if n else model.base)
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """A toxicity score for every row of `docs`, learnt from the labelled rows outside the held-out fold.

    A text without words, null ones included, has the share of toxic ones among the learning texts.
    Without learning texts of both classes every score is that share (a half if there are none). A null
    id is in no fold. Repeated labels of an id count as toxic if one of them does; labels other than 0
    and 1 are not used. Repeated rows get repeated results; other columns may have any name.

    Returns doc_id, held_out (boolean), score, predicted (int: 1 from a score of 0.5 on).
    """
    learn = learns(doc_id, FOLDS, HELD)
    model = train(docs, labels, learn, doc_id, text, label)
    held = F.coalesce(~learn, F.lit(False)) & F.col(doc_id).isNotNull()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), text_of(text).alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
