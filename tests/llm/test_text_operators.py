"""Operators over texts on small fixtures, against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluicework.llm import bpe_chunks, context_coder, decontaminate, html_main, simhash_gray, suffix_dedup, token_files
from sluicework.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, id string, mark string, row int"


def words(n, seed, most=500):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


PASSAGE = words(150, 1)
TEXTS = [
    (0, words(300, 2)), (1, words(300, 2)), (2, words(300, 2) + " end"), (3, None), (4, ""), (5, " \n\t "),
    (6, "one two"), (7, "a" * 5000), (8, "ab é" * 400), (9, words(200, 3) + PASSAGE + words(50, 4)),
    (10, PASSAGE + "\n\n" + words(80, 5)), (11, words(20000, 6, 4000)), (12, "x<|endoftext|> y\x1cz    q"),
    (13, "漢字 " * 300), (14, " ".join(["THE the"] * 3)), (14, " ".join(["THE the"] * 3)), (15, "the the the the the the"),
    (16, words(30, 7) + PASSAGE[3:500]), (None, "no id"), (None, words(300, 2)), (17, "don't  stop\n\n\nit's 12345 ok!!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in TEXTS], SCHEMA)


def same(rows, want):
    assert Counter(map(str, map(tuple, rows))) == Counter(map(str, want))


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_equals_the_library(spark, docs):
    want = []
    for i, t in TEXTS:
        ids = plain_ids(t)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(TOKENIZER.decode(ids, skip_special_tokens=False).encode())))
    same(bpe_chunks.round_trip(docs, PATH).collect(), want)
    back = bpe_chunks.decode_ids(bpe_chunks.encode_ids(docs, PATH), PATH)
    same(back.collect(), [(i, t or "") for i, t in TEXTS])
    assert bpe_chunks.round_trip(docs.where("false"), PATH).count() == 0


def test_bpe_repairs_joins_for_any_chunk_size_and_cache():
    texts = [t for _, t in TEXTS if t] + ["café  naïve\u0085x  y   z\n \n" * 60, "'s't're" * 200, "\t\tq\r\n" * 300]
    for chunk, alone in ((32, False), (128, False), (64, True)):
        small = bpe_chunks.Codec(PATH, chunk=chunk, units=50, chunk_bytes=5000, only_library=alone)
        assert alone or small.ranks is not None
        for text in texts * 2:
            ids = np.frombuffer(small.encode(text), "<u4").tolist()
            assert ids == plain_ids(text)
            assert small.decode(small.encode(text)) == text
        assert small.reused


def test_coder_round_trip_and_damage():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0), np.zeros(1), r.integers(0, 50257, 3000), np.tile(np.arange(99), 400), np.full(7, (1 << 26) - 1),
                np.minimum(r.zipf(1.2, 200_000), 40_000)):
        block = context_coder.pack(ids.astype(np.uint32))
        assert (context_coder.unpack(block) == ids).all()
    assert len(context_coder.pack(np.tile(np.arange(99), 4000).astype(np.uint32))) < 4000 * 99 // 2
    with pytest.raises(ValueError):
        context_coder.unpack(block[:-1] + bytes([block[-1] ^ 1]))


def test_token_files(spark, docs):
    folder = scratch(spark)
    got = token_files.written_and_read(docs, PATH, folder=folder, block_ids=500).collect()
    want = sorted((-1 if i is None else i, len(plain_ids(t)) + 1, zlib.crc32(np.array(plain_ids(t) + [0], "<u4").tobytes())) for i, t in TEXTS)
    got.sort(key=lambda r: r.start)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    back = {(r.doc_id, tuple(r.ids)) for r in token_files.read_ids(spark, folder).collect()}
    assert back == {(i, tuple(plain_ids(t) + [0])) for i, t in TEXTS}
    assert token_files.written_and_read(docs.where("false"), PATH).count() == 0


def cut_brute(texts):
    data = [(t or "").encode() for t in texts]
    n = suffix_dedup.LENGTH
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(x for x, g in zip(d, gone) if not g)))
    return out


def test_suffix_dedup_equals_brute_force(spark, docs):
    short = [(i, t) for i, t in TEXTS if i != 11] + [(30 + k, words(60, 40 + k) + " " + words(90, 99)[:395 + 5 * k] + words(40, 60 + k)) for k in range(8)]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in short], SCHEMA)
    found = cut_brute([t for _, t in short])
    want = [(i, a, b, c, sha(d)) for (i, _), (a, b, c, d) in zip(short, found)]
    for hot in (suffix_dedup.HOT, 1):  # 1: every open anchor is spread string by string
        same(suffix_dedup.dedup(frame, hot=hot).collect(), want)
    left = suffix_dedup.without_repeats(frame)
    assert left.columns == frame.columns
    same(left.select("doc_id", "text", "row").collect(), [
        (i, None if t is None else d.decode(), 1) for (i, t), (*_, d) in zip(short, found)])
    assert suffix_dedup.dedup(docs.where("false")).count() == 0


def test_suffix_dedup_runs_longer_than_a_step(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 1000)
    data = [words(900, 3).encode(), words(700, 3).encode() + words(100, 8).encode()]
    buffer, starts, ends = suffix_dedup._joined(data)
    doc, lo, cnt, _ = suffix_dedup.runs(buffer, starts, ends)
    for k, d in enumerate(data):
        covered = sorted(s for a, b in zip(lo[doc == k], cnt[doc == k]) for s in range(a, a + b))
        assert covered == list(range(len(d) - suffix_dedup.LENGTH + 1))


def passages_brute(texts, n=50):
    """Of each text: where every word begins and ends, and whether a run of n words that stands elsewhere too covers it."""
    places = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", t)] for t in texts]
    split = [[t[a:b] for a, b in p] for t, p in zip(texts, places)]
    seen = Counter(tuple(w[i:i + n]) for w in split for i in range(len(w) - n + 1))
    return [(p, {k for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for k in range(i, i + n)}) for w, p in zip(split, places)]


def passage_texts():
    """Passages of 50 words or more and less than 400 bytes among other text, with other white space, and what must stay."""
    passage, tiny = [f"p{k}" for k in range(55)], list("abcdefghijklmnopqrstuvwxyz" * 2)
    texts = [words(60, 500 + k) + " " + ["\n", " ", "\t", "  "][k % 4].join(passage) + (" \n" + words(70, 520 + k) if k % 3 else "") for k in range(9)]
    texts += [" ".join([words(30, 540), *passage[:50]]), " ".join([words(30, 541), *passage[:49], words(30, 542)]), " ".join([*passage[3:], "é" * 30])]
    texts += [words(80, 543) + " " + " ".join(tiny), " ".join(tiny) + "\x0b" + words(5, 544), "x " * 60, "漢 字 é\x1c" * 40 + words(20, 545)]
    return texts + [words(49, 546), words(49, 546), words(50, 547), words(50, 547).replace(" ", "\r\n"), "  " + words(45, 548) + " " + "z" * 500, words(45, 549) + " " + "z" * 500]


def test_suffix_dedup_finds_passages_of_words(spark):
    texts = passage_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (90, ""), (91, " \n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    data = [(t or "").encode() for _, t in rows]
    found = passages_brute(data)
    assert sum(len(gone) > 0 for _, gone in found) >= 15 and not found[10][1] and not found[17][1]
    n = suffix_dedup.LENGTH
    strings = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    few = lambda x: len(re.findall(rb"(?<=[ \t-\r])[^ \t-\r]+(?=[ \t-\r])", x)) < 50
    for spared in ([], [3]):
        left = []
        for k, ((i, t), d, (places, gone)) in enumerate(zip(rows, data, found)):
            keep = np.ones(len(d), bool)
            for at in range(len(d) - n + 1):
                if strings[d[at:at + n]] > 1 and few(d[at:at + n]):
                    keep[at:at + n] = False
            for w in gone if k not in spared else ():
                keep[places[w][0]:places[w + 1][0] if w + 1 in gone else places[w][1]] = False
            left.append((i, None if t is None else bytes(np.frombuffer(d, np.uint8)[keep]).decode()))
        for hot in (suffix_dedup.HOT, 1):
            marks = frame.where(F.col("doc_id").isin(spared)).select(F.xxhash64("text").alias("mark"))
            same(suffix_dedup.without_repeats(frame, hot=hot, passages=True, spared=marks).collect(), left)


def test_pipeline_cuts_passages_but_leaves_benchmark_items(spark, tmp_path):
    item = words(55, 700)
    texts = passage_texts()[:9] + [f"{words(40, 701 + k)} {item} {words(30, 710 + k)}" for k in range(3)]
    spark.createDataFrame([(0, item + ". a b c d e.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = f"{item}. a b c d e. {words(30, 720)}"
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, held])], "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, frame, str(tmp_path)).collect()}
    assert not any("p9" in left[k].split() for k in range(9)) and all(len(left[k].split()) >= 60 for k in range(9))
    assert all(len(left[k].split()) == 70 for k in range(9, 12)) and left[12] == held


def test_word_runs_own_every_start(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 1000)
    texts = [words(n, n).encode() for n in (900, 10, 0, 700, 50, 49)]
    data, starts, ends = suffix_dedup._joined_words(texts)
    assert ((ends - starts) // 8).tolist() == [900, 10, 0, 700, 50, 49]
    fits = np.flatnonzero(ends - starts >= suffix_dedup.LENGTH)
    doc, lo, cnt, _ = suffix_dedup.runs(data, starts[fits], ends[fits], suffix_dedup.WORDS)
    for k, n in enumerate((900, 700, 50)):
        assert sorted(s for a, b in zip(lo[doc == k], cnt[doc == k]) for s in range(a, a + b)) == list(range(n - 49))


def fingerprint_brute(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash_equals_brute_force(spark, docs):
    prints = [(i, fingerprint_brute(t)) for i, t in TEXTS if i is not None]
    root = {i: i for i, _ in prints}
    for _ in root:
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 2:
                    root[a] = min(root[a], root[b])
    got = simhash_gray.near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "fingerprint", "component_id").collect()
    same(got, [(i, f"{p:016x}", root[i]) for i, p in prints])
    kept = simhash_gray.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(set(root.values()))
    assert simhash_gray.near_duplicates(docs.where("false")).count() == 0


def test_gray_index_and_split_groups_lose_no_link(spark):
    r = np.random.default_rng(2)
    seeds = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([seeds ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(9)] + [seeds]))
    codes = codes[np.argsort(simhash_gray.gray_rank(codes))]
    a, b = simhash_gray.gray_links(codes)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if i < j}
    rows = [(int(c), k) for k, c in enumerate(codes.view(np.int64))]
    frame = spark.createDataFrame(rows, "fp long, rep long")
    for group in (4096, 3, 1):
        routed = simhash_gray._routed(frame, group).repartition("t", "k", "more").sortWithinPartitions("t", "k", "more")
        edges = routed.mapInArrow(simhash_gray._group_links(2), "u long, v long")
        got = {r.node: r.component for r in simhash_gray.components(edges).collect()}
        root = list(range(len(codes)))
        for _ in range(20):
            for i, j in zip(a.tolist(), b.tolist()):
                root[i] = root[j] = min(root[i], root[j])
        assert all(got.get(k, k) == root[k] for k in range(len(codes)))


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 300)] + [(7, 7)]
    got = {r.node: r.component for r in simhash_gray.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 300)}


def test_decontamination_finds_all_items_held(spark):
    items = [(k, " ".join(f"q{k}x{j} the" for j in range(12)) + f". Answer a{k} b{k} c{k} d{k}.") for k in range(60)]
    items += [(100, None), (101, "  "), (102, words(300, 77)), (0, items[0][1])]
    texts = [(k, words(100 + 3 * k, k) + "\n" + items[k][1].upper() + " " + words(90, 7)) for k in range(20)]
    texts += [(50, items[3][1].split(".")[0] + " " + words(200, 1)), (51, words(5000, 2)), (52, None), (53, ""), (54, words(200, 9) + " " + items[62][1]),
              (55, "q5x1 the q5x3 the " * 40)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    want = Counter([(k, k) for k in range(20)] + [(0, 0), (54, 102)])
    for options in ({}, {"shard_items": 7}):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, **options).collect())
        assert got == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [50, 51, 52, 53, 55]
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_finds_items_with_one_changed_word():
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(n, " ".join(r.choices(vocabulary, k=12)) + ". " + " ".join(r.choices(vocabulary, k=n)) + ".") for n in range(1, 16)]
    items.append((100, " ".join(r.choices(vocabulary, k=15))))
    lists = {i: decontaminate.words_of(t) for i, t in items}
    index = decontaminate.Index(items, Counter(w for x in lists.values() for w in set(x)), len(items), 20.0, 64)
    noise = [f"z{k}" for k in range(40)]
    texts = [(i, noise + w[:k] + ["changed"] + w[k + 1:] + noise) for i, w in lists.items() for k in range(len(w))]
    texts += [(n, noise + lists[n][:-n] + noise) for n in (1, 2, 3)]  # a short last sentence cut off
    found = {(d, i) for d, i, *_ in decontaminate.hits([t for _, t in texts], index, decontaminate.THRESHOLD, decontaminate.QUESTION, decontaminate.ANSWER)}
    assert found == {(d, i) for d, (i, _) in enumerate(texts)}
    apart = [noise + lists[n][:12] + noise + lists[n][12:][::-1] for n in range(5, 10)]  # the answer's words, but not in order
    assert not list(decontaminate.hits(apart, index, decontaminate.THRESHOLD, decontaminate.QUESTION, decontaminate.ANSWER))


def test_wand_equals_full_scoring():
    r = random.Random(4)
    items = [(k, " ".join(f"t{min(int(r.expovariate(0.05)), 200)}" for _ in range(r.randrange(3, 30)))) for k in range(100)]
    frequency = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, frequency, 100, 15.0, 64)
    flat = {t: {} for t in range(len(index.terms))}
    for block in index.blocks:
        for t, (i, x, _) in block.items():
            flat[t].update(zip(i, x))
    for threshold in (0.2, 0.5, 0.9):
        terms = r.sample(range(len(index.terms)), 40)
        full = {k: sum(flat[t].get(k, 0) for t in terms) for k in range(100)}
        got = {k for b in range(len(index.blocks)) for k, _ in index.wand(b, terms, threshold)}
        assert got == {k for k, s in full.items() if s >= threshold - 1e-9}


def test_main_text(spark):
    article = "<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three</p>" \
              "<aside>x</aside><ul><li>i</li><li>j&nbsp;k</li></ul><script>if (a<b) {}</script><section class='comments'><p>first!</p></section></article><footer>f</footer>"
    common = "<div>All rights reserved by the owner of this very site since long ago</div>"
    bare = [f"<body><p>{words(300, k)}</p>{common}<p>see you</p></body>" for k in range(4)]
    rows = [(1, "http://a.org/1", article), (2, "http://a.org/2", article), (3, None, None), (4, "http://b.org/", ""), (4, "http://b.org/", "")]
    rows += [(10 + k, "http://B.org/x", b) for k, b in enumerate(bare)] + [(20, "http://c.org", bare[0]), (21, "http://b.org/again", bare[0])]
    # two versions of one text, and its copies, are one page; so is a text that is all a host has
    versions = [f"<p>{words(400, 9)} on {day} {words(400, 8)}</p>" for day in ("Monday", "Friday", "Friday", "Friday")]
    rows += [(30 + k, "http://d.org", v) for k, v in enumerate(versions)]
    # articles: a promotion in each is cut, a passage that a third of them quotes is not
    promotion, quoted = f"<p>{words(30, 70)}</p><p>Read more</p>", f"<p>{words(40, 71)}</p>"
    rows += [(40 + k, "http://e.org", f"<article><p>{words(300, 40 + k)}</p>{promotion}{quoted if k < 3 else ''}</article>") for k in range(9)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = html_main.main_text(pages).collect()
    main = "A & B\none two three\ni\nj k"
    want = [(1, main), (2, main), (3, ""), (4, ""), (4, "")] + [(10 + k, words(300, k)) for k in range(4)]
    whole = words(300, 0) + "\nAll rights reserved by the owner of this very site since long ago\nsee you"
    want += [(20, whole), (21, words(300, 0))] + [(30 + k, v[3:-4]) for k, v in enumerate(versions)]
    want += [(40 + k, words(300, 40 + k) + (f"\n{words(40, 71)}" if k < 3 else "")) for k in range(9)]
    same([(r.page_id, r.text) for r in got], want)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_main.main_text(pages.where("false")).count() == 0


def test_main_text_equals_brute_force(spark):
    """Every string of `length` words and every short block of every page, counted one by one."""
    r, length = random.Random(5), 9
    menu = [[f"m{r.randrange(40)}" for _ in range(r.randrange(1, 30))] for _ in range(12)]
    pages, streams = [], {}
    for page in range(160):
        host, marked = f"h{min(page % 7, 3)}", r.random() < 0.5
        blocks = [" ".join(r.choice(menu)) if r.random() < 0.5 else " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 25))) for _ in range(r.randrange(0, 8))]
        if r.random() < 0.4:
            blocks.append(" ".join(f"own{page}-{k}" for k in range(20)) + " " + " ".join(menu[0] * 2) + " end")
        tag = "article" if marked else "div"
        pages.append((page, f"http://{host}/", f"<{tag}>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</{tag}>"))
        streams[page] = (host, marked, [b.split()[:-1] + [b.split()[-1] + "\n"] for b in blocks])

    def strings(blocks):
        flat = [w for b in blocks for w in b]
        at, found = 0, []
        for b in blocks:
            if len(b) < length:
                found.append((("block", *b), at, at + len(b)))
            at += len(b)
        return found + [(tuple(flat[i:i + length]), i, i + length) for i in range(len(flat) - length + 1)]

    least, share = {False: 3, True: 4}, {False: 0.05, True: 0.1}
    kinds = {p: html_main._class_of(html_main._words([" ".join(b).strip() for b in blocks])[0]) for p, (_, _, blocks) in streams.items()}
    have, of_host = {}, {}
    for p, (host, _, blocks) in streams.items():
        if blocks:
            of_host.setdefault(host, set()).add(kinds[p])
        for key, _, _ in strings(blocks):
            have.setdefault((host, key), set()).add(kinds[p])
    want, changed = [], 0
    for p, (host, marked, blocks) in streams.items():
        gone = {k for key, a, b in strings(blocks) for k in range(a, b)
                if len(have[host, key]) >= least[marked] and len(have[host, key]) >= share[marked] * len(of_host[host])}
        places, left = iter(range(10 ** 6)), []
        for b in blocks:
            kept = [w.strip() for w in b if next(places) not in gone]
            left += [" ".join(kept)] if kept else []
        want.append((p, "\n".join(left)))
        changed += bool(gone)
    got = html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), length, least, share)
    same([(row.page_id, row.text) for row in got.collect()], want)
    assert 40 < changed < 160


def test_main_text_of_hostile_pages():
    for page in ("<div>" * 60000 + "</p></span>" * 60000, "<svg>" * 300000, "<form><article>x" * 50000, "</div>" * 300000, "<p>a</form><div>" * 50000):
        start = time.process_time()
        html_main.blocks_of(page)
        assert time.process_time() - start < 8  # linear; by the square it would be minutes


def test_main_text_inside_wrappers():
    body = "<nav>Home</nav>%s<h1>Title</h1><p>one two</p><div class='ad'>Buy</div>%s<footer>f</footer>"
    for wrapper in ("form id='aspnetForm'", "div class='layout with-sidebar'", "div class='no-sidebar'", "div class='has-banner'", "div class='ad-free'",
                    "div class='page-with-menu'", "div class='overlay'", "div class='page' id='has-menu'", "div role='form'"):
        for mark in ("article", "main", "div role='main'", "div itemprop='articleBody'"):
            page = f"<body><{wrapper}>{body % (f'<{mark}>', f'</{mark.split()[0]}>')}</{wrapper.split()[0]}></body>"
            assert html_main.blocks_of(page) == (["Title", "one two"], True), (wrapper, mark)
    for others in ("<section class='comments'>%s</section>", "<div class='related'>%s</div>", "<aside>%s</aside>", "<form class='comment-form'>%s</form>"):
        page = "<body><p>the text</p>" + others % "<article>no text of this page</article>" + "</body>"
        assert html_main.blocks_of(page) == (["the text"], False)
    article = "<article>own<form><p>out</p></form></article>"
    assert html_main.blocks_of(f"<form>{article}</form>") == (["own"], True)
    assert html_main.blocks_of(f"{article}<form><article>second</article></form>") == (["own"], True)
