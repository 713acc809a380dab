"""Language and toxicity on small made-up corpora: held-out accuracy, folds and odd rows."""

import random
import zlib

from pyspark.sql import functions as F

from sluicework.llm import language_id, toxicity

STEMS = {"aa": "ka lo mi tu".split(), "bb": "schu ber ung zer".split(), "cc": "éau oir que ñel".split()}


def text(lang, r, n=40):
    return " ".join("".join(r.choices(STEMS[lang], k=3)) for _ in range(n))


def test_language(spark):
    r = random.Random(1)
    rows = [(k, text(lang := r.choice(sorted(STEMS)), r), lang, lang) for k in range(240)]
    odd = [(900, None, "aa", None), (901, "", "aa", None), (902, "123 !!", "bb", None), (903, text("aa", r), None, "aa"),
           (None, text("bb", r), "bb", "bb"), (904, text("cc", r, 20000), "cc", "cc")]
    docs = spark.createDataFrame([(i, t, lang, "x") for i, t, lang, _ in rows + odd], "doc_id long, text string, lang string, row string")
    want = {i: truth for i, _, _, truth in rows + odd}
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    for row in got:
        assert row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert row.lang_pred == (want[row.doc_id] or "und") and 0 <= row.score <= 1
    kept = language_id.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_toxicity(spark):
    r = random.Random(2)
    rows = []
    for k in range(400):
        words = text("aa", r, r.randrange(20, 200)).split()
        if k % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilox", "vilogram", "vilond", "grubber"]))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(901, None, "x"), (902, "...", "x"), (None, "ka", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (5000, 1), (1, None)], "doc_id long, toxic int")
    got = {row.doc_id: row for row in toxicity.score(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in got.values())
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    truth = {i: y for i, _, y in rows}
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    alone = toxicity.score(docs, labels.where("toxic = 0")).collect()
    assert {row.predicted for row in alone} == {0}
    assert toxicity.score(docs.where("false"), labels).count() == 0
    assert {row.score for row in toxicity.score(docs, labels.where("false")).collect()} == {0.5}


def test_repeated_ids_are_learnt_from_once(spark, monkeypatch):
    """However many rows an id has, one of them reaches the driver, the same in any order."""
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: given.append((texts, labels.tolist())))
    rows = [(1, f"text {k % 7}") for k in range(50)] + [(2, None), (2, "b"), (3, "never labelled"), (None, "c")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        toxicity.train(docs, labels, F.lit(True))
    assert given == [([["text", "0"], []], [1, 0])] * 2


def test_network_slopes():
    """The training step's slopes, as seen in the loss along each weight, for a tiny batch."""
    import numpy as np

    w = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    words, index, target = ["ab", "cde", "f"], np.array([[0, 1], [2, 0], [1, -1]]), np.array([1.0, 0.0])

    def loss(weights):
        z = toxicity.logits(toxicity.projections(words, weights), index, weights)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    found = {}
    original, toxicity._adam = toxicity._adam, lambda w, m, s, g, k, at: found.update({id(w): (g, at)})
    try:
        toxicity._step(w, w, w, words, index, target, 1)
    finally:
        toxicity._adam = original
    for name in ("Wf", "Ub", "bf", "A", "v", "o", "c", "Uf", "Wb"):
        slope = found[id(w[name])][0]
        at = tuple(0 for _ in w[name].shape)
        step = np.zeros_like(w[name])
        step[at] = 1e-2
        up, down = ({**w, name: w[name] + d * step} for d in (1, -1))
        assert abs((loss(up) - loss(down)) / 2e-2 - slope[at]) < 2e-3
