"""Operators 11 to 13 against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sluicework.llm import hard_negatives, merkle, shingle_join
from sluicework.llm.queries import QUERIES


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["ka", "lo", "mi", "tu", "schu", "ber"], k=4)) for _ in range(n))


# ---- 11 -----------------------------------------------------------------------------------------

def sets_of(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    return out


def classes_brute(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def key(row):
    return tuple((x is None, x) for x in row)


def edited(words, edits, r):
    words = list(words)
    for place in r.sample(range(len(words)), edits):
        words[place] = f"edit{r.randrange(10**9)}"
    return " ".join(words)


def test_shingle_join_equals_brute_force(spark):
    r = random.Random(11)
    rows = []
    for k in range(10):  # chains of edits around the bound
        base = prose(120, k).split()
        rows += [(len(rows) + j, edited(base, e, r)) for j, e in enumerate((0, 0, 1, 2, 2, 3, 4, 6))]
    hot = prose(100, 99).split()
    rows += [(1000 + j, edited(hot, r.choice((1, 2, 3, 4)), r)) for j in range(120)]  # one group of near copies
    parts = [prose(40, 500 + k) for k in range(8)]
    rows += [(2000 + j, " ".join(r.sample(parts, 4))) for j in range(80)]  # far, though made of the same paragraphs
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "Two words"), (3004, "two\tWORDS"), (3005, "É one two"), (3006, "é one two"),
             (None, rows[0][1]), (None, "of no id"), (7, rows[3][1]), (7, rows[3][1]), (3007, "a " * 30000), (3008, "a a a a")]
    frame = spark.createDataFrame(rows, "digest long, row string")  # names that clash with the operator's own
    got = shingle_join.near_classes(frame, doc_id="digest", text="row")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(classes_brute(rows), key=key)
    assert shingle_join.near_classes(frame.limit(0), doc_id="digest", text="row").count() == 0


def test_columns_dealt_over_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "COLUMN", 3)
    r = random.Random(12)
    base = prose(60, 7).split()
    rows = [(j, edited(base, r.choice((0, 1, 2)), r)) for j in range(60)]
    got = shingle_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(classes_brute(rows))


def test_shingles_of_pieces(monkeypatch):
    text = (prose(500, 3) + "\n").encode()
    whole, starts = shingle_join.shingles([text, b"", b"x y", text + b" z"])
    monkeypatch.setattr(shingle_join, "_PIECE", 16)
    again, same = shingle_join.shingles([text, b"", b"x y", text + b" z"])
    assert (whole == again).all() and (starts == same).all() and np.diff(starts).tolist() == [len(s) for s in sets_of([text.decode(), "", "x y", text.decode() + " z"])]


# ---- 12 -----------------------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Levels of (digest) from leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        out.append((at % 8, run[:at % 8] + run[at % 8 + 1:]))
        at //= 8
    return out


def merkle_brute(rows):
    def leaf(r, lower=False):
        text = r[4].translate({c: c + 32 for c in range(65, 91)}) if lower and r[4] is not None else r[4]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)])

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for k in trees:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {k: climb([leaf(r) for r in v]) for k, v in trees.items()}
    top = climb([levels[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for at, r in enumerate(trees[k]):
            steps = path_of(levels[k], at) + path_of(top, n)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, tampered)
            for digit, others in steps:
                node = h(*others[:digit], node, *others[digit:])
            out.append((r[0], leaf(r), levels[k][-1][0], top[-1][0], h(*[x for _, o in steps for x in o]), node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_merkle_equals_brute_force(spark, tmp_path):
    r = random.Random(13)
    langs = [None, "", "aa", "é", "z"] + [f"l{k}" for k in range(70)]  # three levels of subroots
    rows = [(i, r.choice(["s", None]), r.choices(langs, [90, 3, 520, 9, 1] + [1] * 70)[0], r.choice([None, i]), r.choice(["Text É", "low", None, "", "X" * 300])) for i in range(700)]
    rows += [(None, "s", "aa", 1, "A"), (None, "s", "aa", 1, "A"), rows[5], (8, "s", "aa", 2, "same id"), (8, "s", "aa", 2, "another")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "digest": F.lit("x"), "at": F.lit(2), "path": F.lit("y")}).repartition(5)
    got = merkle.verified(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).collect()
    assert sorted(map(tuple, got), key=key) == sorted(merkle_brute(rows), key=key)
    assert {x["verified"] for x in got} == {True, False}
    one = spark.createDataFrame([(1, None, None, None, "A")], SCHEMA)
    alone = merkle.verified(one).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] == alone["folded_root"] and alone["proof_sha256"] == h()
    assert merkle.verified(one.limit(0)).count() == 0
    for name in ("documents",):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["op12_merkle_descent"](spark, str(tmp_path)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_proofs_of_some_leaves(spark):
    rows = [(i, "s", "ab"[i % 2], i, f"T{i}") for i in range(150)]
    made = merkle.build(spark.createDataFrame(rows, SCHEMA))
    asked = made.leaves.where("doc_id IN (0, 77, 149)")
    got = merkle.proofs(made, asked).select("row.doc_id", merkle.folded(F.col("row.leaf"), F.col("path")).alias("root"))
    assert {(r["doc_id"], r["root"]) for r in got.collect()} == {(i, made.root.first()["digest"]) for i in (0, 77, 149)}


# ---- 13 -----------------------------------------------------------------------------------------

def mined_brute(rows, anchors, k=5):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(x))) for x in v]
        usable.setdefault(i, (label, whole))
    out = []
    for a in sorted(set(anchors) & set(usable)):
        label, v = usable[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in usable.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if usable[i][0] == label][:k]:
            fits = [i for i in ranked if usable[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fits[:k])]
    return out


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    g = np.random.default_rng(14)
    centres = g.normal(size=(6, 8))
    rows = [(i, int(g.integers(0, 3)), (centres[i % 6] + g.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(900)]
    rows += [(901 + k, k % 3, rows[10][2]) for k in range(12)]  # ties
    rows += [(1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [1.0, None]), (1300, 1, [float("nan")] * 8), (1400, 1, [float("inf")] * 8),
             (1500, 2, []), (1600, 0, [0.5]), (None, 1, rows[0][2]), (1700, 1, [300.0] * 8), (1800, 1, [-300.5] * 8), rows[4]]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"leaf": F.lit(1), "v": F.lit(2)})
    want = sorted(mined_brute([(i, x, [None if y is None else float(np.float32(y)) for y in v] if v is not None else None) for i, x, v in rows], [i for i, *_ in rows if i is not None and i % 50 == 0]))
    anchors = F.col("vec_id") % 50 == 0
    got = hard_negatives.mine(frame, anchors, fan=4, levels=3, fit_rows=200)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    monkeypatch.setattr(hard_negatives, "BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "QUERY_BLOCK", 5)
    assert sorted(map(tuple, hard_negatives.mine(frame, anchors, fan=4, levels=2).collect())) == want
    assert hard_negatives.mine(frame.limit(0), anchors).count() == 0
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0


def test_subtrees_that_no_window_meets_are_passed_over():
    g = np.random.default_rng(15)
    rows = np.concatenate([np.rint(g.normal(size=(200, 4)) * 5 + c).astype(np.int64) for c in ([200, 0, 0, 0], [-200, 0, 0, 0], [0, 200, 0, 0], [0, 0, 0, 200])])
    nodes = hard_negatives.fit(rows[::3], 4, 1)
    ranges = hard_negatives._Ranges(nodes)
    leaf = hard_negatives._assigned(rows, nodes[0], ranges)
    known = {0: (ranges.low[0], ranges.high[0])}
    anchors = rows[:5]
    scores = anchors @ rows.T
    low, high = np.full((5, 1), 30000.0), np.full((5, 1), np.inf)
    kept = {x: set(at.tolist()) for x, at in hard_negatives._survivors(anchors, low, high, nodes[0], known)}
    for q, r in zip(*np.nonzero(scores >= 30000)):
        assert q in kept[leaf[r]]
    assert sum(map(len, kept.values())) < 10  # of 20


# ---- 2 ------------------------------------------------------------------------------------------

def test_no_damaged_byte_of_a_block_goes_unseen():
    import pytest

    from sluicework.llm import context_coder

    block = context_coder.pack((np.arange(5000) * 7919 % 50000).astype(np.uint32))
    places = [*range(40), *range(40, len(block), 97), len(block) - 1]
    for at in places:
        for bit in range(8):
            with pytest.raises(ValueError):
                context_coder.unpack(block[:at] + bytes([block[at] ^ (1 << bit)]) + block[at + 1:])
    for cut in (0, 3, 12, len(block) - 1):
        with pytest.raises(ValueError):
            context_coder.unpack(block[:cut])
