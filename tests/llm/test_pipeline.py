"""The pipeline, stage by stage and as a whole, against brute force on a small fixture."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sluicework.llm.common import written
from sluicework.llm.queries import QUERIES, vocabulary
from sluicework.llm.suffix_dedup import LENGTH
from tests.llm.test_text_operators import cut_brute, fingerprint_brute


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["ka", "lo", "mi", "tu", "schu", "ber"], k=4)) for _ in range(n))


def test_pipeline(spark, tmp_path):
    item, shared = prose(30, 900) + ". " + prose(8, 901) + ".", prose(90, 902)
    rows = [(k, prose(60 + k, k), "aa", "s", 1) for k in range(40)]
    rows += [(50, rows[3][1], "aa", "s", 1), (51, None, "aa", "s", 1), (52, "12 - 34", "aa", "s", 1), (53, "", "aa", "s", 1),
             (54, prose(70, 60) + " " + item + " " + prose(40, 61), "aa", "s", 1), (55, shared + " " + prose(50, 62), "aa", "s", 1),
             (56, prose(50, 63) + "\n" + shared, "aa", "s", 1), (57, rows[5][1], "aa", "s", 1), (57, rows[5][1], "aa", "s", 1), (None, rows[7][1], "aa", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "never held in any text of the corpus at all.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # brute force: letters, smallest id of linked fingerprints, repeated 400-byte strings, items held, the library's ids
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    prints = {r[0]: fingerprint_brute(r[1]) for r in left if r[0] is not None}
    roots = {a: min(b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2) for a in prints}
    left = {r[0]: r[1] for r in left if r[0] is not None and roots[r[0]] == r[0]}
    left = {k: d.decode() for k, (*_, d) in zip(left, cut_brute(list(left.values())))}
    assert all(len(shared) >= LENGTH and shared[:LENGTH] not in t for t in left.values())
    left = {k: t for k, t in left.items() if item not in t}
    tokenizer, want = Tokenizer.from_file(vocabulary()), {}
    for k, t in left.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)))
        assert name == "bpe" or docs.columns == columns
    assert {r[0]: tuple(r[1:]) for r in docs.collect()} == want
    assert {r[0]: tuple(r[1:]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_duplicates_stage_keeps_one_of_each_component(spark):
    r = random.Random(5)
    rows = []
    for k in range(12):
        words = prose(400, 700 + k).split()
        for edits in (0, 0, 1, 2, 6):
            changed = list(words)
            for place in r.sample(range(5, 395), edits):
                changed[place] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(900, rows[0][1]), (None, rows[1][1]), (901, ""), (902, None), (903, "one two")]
    prints = [fingerprint_brute(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(set(root)) < len({t for _, t in rows}) - 5  # edited copies link
    want = {}
    for k, row in enumerate(rows):
        want[root[k]] = min(want.get(root[k], row), row, key=lambda x: (x[0] is None, x[0]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted((x[0], x[1] or "") for x in got) == sorted((x[0], x[1] or "") for x in want.values())


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
