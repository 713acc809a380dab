"""Benchmark decontamination: BM25 over the test items with block-max WAND, then a check of overlaps.

The items are indexed and the training texts are the queries. A text is read in passages: for items of
up to 2^k words, passages of 2^(k+1) words that start every 2^k words, so that each place where an item
could stand lies whole in one passage. A passage asks for all items whose BM25 score reaches a share of
the score that the item gives itself. Items stand in blocks of `BLOCK`; for each term and block the
index has the largest impact, and a block whose bounds over a passage's terms add up to less than the
threshold is passed over unread. In the blocks left, WAND moves over the postings from pivot to pivot.
Hits count if the passage also has enough of the word n-grams of the item's question and its answer; of
a short part, of its words in order.

Items are indexed in shards of bounded size, and texts are read once for each shard: the index that
goes to the executors never outgrows `SHARD_ITEMS` items and about `SHARD_BYTES` of text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_of, written
from .language_id import parts

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of the n-grams of its two parts.
THRESHOLD = 0.5
QUESTION, ANSWER = 0.6, 0.6
NGRAM = 3
#: Parts of fewer words are compared by their words in order: of their n-grams, one changed word leaves too few.
FEW = 10
#: An answer of fewer words is too short to bear a changed word, or to be told from its absence.
LEAST_ANSWER, LEAST_QUESTION = 4, 4
BLOCK = 4
#: Items of fewer words are read in passages for items of this many.
SHORTEST = 64
SHARD_ITEMS, SHARD_BYTES = 1024, 1 << 19
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """(question, answer) as words: the last sentence answers; of a single sentence, the last third of its words.

    An answer below `LEAST_ANSWER` words is lengthened to `FEW` by the words before it. If that leaves fewer than
    `LEAST_QUESTION` words of question, or the question has fewer, the item is one part.
    """
    sentences = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    words = [u for s in sentences for u in s]
    answer = len(sentences[-1]) if len(sentences) > 1 else len(words) // 3
    if answer < LEAST_ANSWER:
        answer = FEW
    cut = len(words) - answer
    return (words[:cut], words[cut:]) if cut >= LEAST_QUESTION else (words, [])


def ngrams(words: list[str], n: int = NGRAM) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """The share of the n-grams of `part` that the passage has; 1 for a part without words.

    Of a part below `FEW` words: the largest share of its words that stand in order in a stretch of the passage
    that is at most two words longer.
    """
    if not part:
        return 1.0
    if len(part) < FEW:
        return _in_order(part, passage) / len(part)
    own = ngrams(part)
    n = len(next(iter(own)))
    return len(own & {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}) / len(own)


def _in_order(part: list[str], passage: list[str]) -> int:
    known, best = set(part), 0
    for start, word in enumerate(passage):
        if word not in known:
            continue
        window = [w for w in passage[start:start + len(part) + 2] if w in known]
        if len(window) <= best:
            continue
        row = [0] * (len(part) + 1)
        for w in window:
            diagonal = 0
            for k, own in enumerate(part, 1):
                diagonal, row[k] = row[k], diagonal + 1 if w == own else max(row[k], row[k - 1])
        best = max(best, row[-1])
        if best == len(part):
            break
    return best


class Index:
    """Postings of items of one length class, with normalised impacts: an item gives itself a score of 1."""

    def __init__(self, items: list[tuple[int, str]], document_frequency: dict[str, int], n_items: int, mean: float, size: int):
        texts = [(i, t, words_of(t)) for i, t in items]
        # items with the same frequent words next to each other: bounds of a block are then closer to its items
        texts.sort(key=lambda x: (sorted(set(x[2]), key=lambda u: (-document_frequency[u], u))[:3], x[0]))
        self.size = size
        self.ids = [i for i, _, _ in texts]
        self.parts = [split_item(t) for _, t, _ in texts]
        self.terms: dict[str, int] = {}
        impacts: list[dict[int, float]] = []
        for _, _, words in texts:
            own = {}
            for u, tf in Counter(words).items():
                idf = np.log(1 + (n_items - document_frequency[u] + 0.5) / (document_frequency[u] + 0.5))
                own[self.terms.setdefault(u, len(self.terms))] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            total = sum(own.values())
            impacts.append({t: x / total for t, x in own.items()})
        self.blocks: list[dict[int, tuple[list[int], list[float], float]]] = []
        self.bounds = np.zeros((len(self.terms) + 1, -(-len(texts) // BLOCK)), np.float32)  # last row: unknown words
        for k in range(self.bounds.shape[1]):
            lists: dict[int, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
            for item in range(k * BLOCK, min((k + 1) * BLOCK, len(texts))):
                for t, x in impacts[item].items():
                    lists[t][0].append(item)
                    lists[t][1].append(x)
            self.blocks.append({t: (i, x, max(x)) for t, (i, x) in lists.items()})
            for t, (_, _, most) in self.blocks[-1].items():
                self.bounds[t, k] = most

    def wand(self, block: int, terms: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """The items of a block, with their scores, that reach the threshold."""
        postings = self.blocks[block]
        lists = [[*postings[t], 0] for t in terms if t in postings]
        while lists:
            lists.sort(key=lambda x: x[0][x[3]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[2]
                if bound >= threshold - 1e-6:
                    pivot = x[0][x[3]]
                    break
            if pivot is None:
                return
            if lists[0][0][lists[0][3]] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[3]] != pivot:
                        break
                    score += x[1][x[3]]
                    x[3] += 1
                if score >= threshold - 1e-9:
                    yield pivot, score
            else:
                for x in lists:
                    if x[0][x[3]] >= pivot:
                        break
                    x[3] = bisect_left(x[0], pivot, x[3])
            lists = [x for x in lists if x[3] < len(x[0])]


def _bounds(index: Index, ids: np.ndarray, docs: np.ndarray, places: np.ndarray, before: np.ndarray,
            base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(passages, blocks): sums of the block maxima over the distinct known words of each passage."""
    out = np.zeros((int(counts.sum()), index.bounds.shape[1]), np.float32)
    half = places // index.size
    for back in (0, 1):  # a word is in the passage that starts in its half, and in the one before
        k = half - back
        own = (k >= 0) & (k < counts[docs]) & (before < k * index.size)
        passage = base[docs[own]] + k[own]
        if not len(passage):
            continue
        heads = np.r_[0, np.flatnonzero(passage[1:] != passage[:-1]) + 1]
        out[passage[heads]] += np.add.reduceat(index.bounds[ids[own]], heads, axis=0)
    return out


def hits(texts: list[list[str]], index: Index, threshold: float, question: float, answer: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(text, item id, score, overlap of question, of answer, first word of the passage) of the best passage of each pair."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // index.size) - 1)
    base = np.cumsum(counts) - counts
    get, unknown = index.terms.get, len(index.terms)
    flat = np.array([get(u, unknown) for words in texts for u in words], np.int64)
    docs = np.repeat(np.arange(len(texts)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = flat < unknown
    ids, docs, places = flat[known], docs[known], places[known]
    order = np.argsort(docs * (unknown + 1) + ids, kind="stable")
    before = np.full(len(ids), -1, np.int64)
    same = (docs[order][1:] == docs[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    before[order[1:][same]] = places[order[:-1][same]]
    bounds = _bounds(index, ids, docs, places, before, base, counts)
    best: dict[tuple[int, int], tuple] = {}
    passages, blocks = np.nonzero(bounds >= threshold - 1e-4)  # single precision: a little slack, the exact score decides
    owners = np.searchsorted(base, passages, side="right") - 1
    last, words, terms = -1, [], []
    for p, b, d in zip(passages.tolist(), blocks.tolist(), owners.tolist()):
        if p != last:
            last, start = p, (p - int(base[d])) * index.size
            words = texts[d][start:start + 2 * index.size]
            terms = list({get(u) for u in words} - {None})
        for item, score in index.wand(b, terms, threshold):
            q = overlap(index.parts[item][0], words)
            a = overlap(index.parts[item][1], words) if q >= question else 0.0
            if q >= question and a >= answer:
                found = (score, q, a, start)
                if found[:3] > best.get((d, item), (-1.0, 0.0, 0.0))[:3]:
                    best[d, item] = found
    for (d, item), (score, q, a, start) in best.items():
        yield d, index.ids[item], score, q, a, start


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _searched(indexes: list[Index], threshold: float, question: float, answer: float):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                keys = part.column(0).to_pylist()
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                rows = [(keys[d], *r) for index in indexes for d, *r in hits(texts, index, threshold, question, answer)]
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, pa.int64() if k in (0, 1, 5) else pa.float64()) for k, c in enumerate(zip(*rows))], names)
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], ["item_id", "text", "words"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION,
                 answer: float = ANSWER, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The pairs of a row of `docs` and a test item that it holds, with the figures of the best passage.

    Null texts count as empty; a text or an item without words matches nothing. Repeated rows of either
    side give repeated pairs; null ids are passed on. Columns other than those named may have any name.
    Without items, or without hits, the result is empty.

    Returns doc_id, item_id, score (share of the item's own BM25 score), question_overlap,
    answer_overlap, first_word (where the passage starts, in words).
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), text_of(item_text).alias("text"))
    rows = written(rows.mapInArrow(_item_words, "item_id long, text string, words array<string>").where(F.size("words") > 0))
    n, mean, size = rows.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.octet_length("text"))).first()
    if not n:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    frequency = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    shards = max(-(-n // shard_items), -(-size // shard_bytes))
    found = []
    for shard in range(shards):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        terms = own.select(F.explode("words").alias("term")).distinct()
        df = {r.term: r.n for r in frequency.join(terms, "term", "left_semi").collect()}
        by_size: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for r in own.select("item_id", "text", F.size("words").alias("k")).collect():
            by_size[max(SHORTEST, 1 << (r.k - 1).bit_length())].append((r.item_id, r.text))
        indexes = [Index(group, df, n, mean, k) for k, group in sorted(by_size.items())]
        if indexes:
            found.append(texts.mapInArrow(_searched(indexes, threshold, question, answer), _SCHEMA))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no test item; all columns stay as they are, and null texts stay in."""
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), text_of(text))  # ids may be null or repeated
    packed = docs.select(key.alias("_key"), text_of(text).alias("_text"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"))
    bad = contaminated(packed.select("_key", "_text"), items, doc_id="_key", text="_text", **options).select(F.col("doc_id").alias("_key")).distinct()
    kept = packed.select("_key", "row").join(bad, "_key", "left_anti")
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
