"""Jaccard join of word n-grams as a blocked sparse matrix product.

Documents by n-grams is a sparse matrix of ones; its product with itself holds all overlaps. Columns
are ordered by how often their n-gram occurs, and cut into two blocks for each row: the rarest columns,
and the rest. A pair of rows of x and y entries needs an overlap of t / (1 + t) * (x + y).

1. Equal rows are one row from here on (128-bit digest of the sorted n-gram hashes).
2. First block. A row keeps its rarest x - ceil(t * x) + 1 columns: two rows that share none of them can
   overlap in too few of the rest. Frequencies come from a count over all rows, of fixed size.
3. The product of the first block counts overlaps; a pair is discarded if its count and all that the
   second block could add stay below its bound, or if their sizes alone rule it out.
4. Second block: of the pairs left the whole rows are multiplied.

Components only need links between different components. So each column's smallest row is multiplied
with the others first, and steps 3 and 4 then see only columns that still join different components,
and only pairs across them. No link is lost that way, and a group of copies with small edits, where
nearly all pairs link, doesn't cost the square of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, text_of, written
from .simhash_gray import components

WORDS = 4
#: Least similarity, in per cent.
LEAST = 85
#: Cells of the frequency count, and those of the filter that keeps rows without a candidate from being sent.
CELLS, FILTER_BITS = 1 << 16, 1 << 23
#: Rows of one column that one task takes; a column whose cell counts more is dealt over several.
COLUMN = 16_384
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                      0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25], np.uint64)
_CACHE, _PIECE = 1 << 18, 1 << 20
_GAP = np.zeros(256, bool)
_GAP[list(SPACES.encode())] = True
_SPACE = re.compile(b"[%s]" % SPACES.encode())
_BASE = 0x9E3779B97F4A7C15
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64th."""
    return tuple(np.cumprod(np.full(1 << bits, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and where it starts; the text is cut at white space into pieces of bounded size."""
    hashes, places, a = [], [], 0
    while a < len(text):
        space = _SPACE.search(text, a + _PIECE)
        b = space.end() if space else len(text)
        x = np.frombuffer(text, np.uint8, b - a, a)
        up, down = (p[:len(x)] for p in _powers(max(20, (len(x) - 1).bit_length())))
        edge = np.diff(np.r_[True, _GAP[x], True].view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[x] * up)]
        hashes.append(_mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        places.append(start + a)
        a = b
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *places])


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each whole text, one after the other, and their starts.

    A text with fewer words has the hash of all of them, one without words none. Words are what stands
    between the six white-space bytes, A-Z in lower case.
    """
    flat, places = word_hashes(b"\n".join(texts).lower())
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = np.searchsorted(places, begins)
    sizes = np.diff(starts)
    flat = np.r_[flat, np.zeros(words, np.uint64)]
    sums = sum(flat[k:len(flat) - words + k] * _MULTIPLY[k % 8] for k in range(words))
    grams = np.where(sizes == 0, 0, np.maximum(sizes - words + 1, 1))
    for k in np.flatnonzero((sizes > 0) & (sizes < words)):  # fewer words: what follows belongs to the next text
        a = starts[k]
        sums[a] = (flat[a:starts[k + 1]] * _MULTIPLY[:sizes[k]]).sum() + np.uint64(sizes[k])
    ends = np.cumsum(grams)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1] - (ends - grams), grams)
    rows = _mixed(sums[at])
    for a, b in zip((ends - grams).tolist(), ends.tolist()):
        rows[a:b].sort()
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    first[(ends - grams)[grams > 0]] = True
    return rows[first], np.r_[0, np.cumsum(first)][np.r_[0, ends].astype(np.int64)]


def _digest(row: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(row)


def _pieces(texts: list[str]) -> Iterator[list[bytes]]:
    """Texts as bytes, a few megabytes at a time; a longer text stays whole."""
    piece, size = [], 0
    for text in texts:
        piece.append(text.encode())
        size += len(piece[-1])
        if size > 4 * _PIECE:
            yield piece
            piece, size = [], 0
    yield piece


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _rows_and_counts(words: int):
    """(doc_id, digest, n, mark) of each document, mark being a hash of its text, then (cell, count) of all n-grams of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        names = ["doc_id", "digest", "n", "mark", "cell", "count"]
        for batch in batches:
            digests, sizes, marks = [], [], []
            for texts in _pieces(batch.column(1).to_pylist()):
                rows, starts = shingles(texts, words)
                counts += np.bincount(_cell(rows), minlength=CELLS)
                digests += [_digest(rows[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                sizes.append(np.diff(starts))
                marks += [xxhash.xxh3_128_digest(t) for t in texts]
            none = len(digests)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(marks, pa.binary()),
                                              pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())], names)
        at = np.flatnonzero(counts)
        none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(counts[at])], names)
    return run


class _Seen(set):
    """What a task has had already, as far as it remembers."""

    def new(self, key: bytes) -> bool:
        if len(self) > _CACHE:
            self.clear()
        before = len(self)
        self.add(key)
        return len(self) > before


def _first_block(words: int, least: int, counts: np.ndarray):
    """(column, part, d0, d1, n) of the rarest columns of each row that this task sees for the first time.

    Copies are equal rows: a task passes each of them on once, as long as it remembers it. A column
    whose cell is much fuller than the others is dealt over parts by the row's digest.
    """
    usual = 2 * counts.mean()
    place = np.unique(counts, return_inverse=True)[1].astype(np.uint16)  # of a cell, in the order of counts
    parts = np.maximum(np.ceil((counts - usual) / COLUMN), 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, had = _Seen(), _Seen()
        for batch in batches:
            for texts in _pieces(batch.column(0).to_pylist()):
                rows, starts = shingles([t for t in texts if had.new(xxhash.xxh3_128_digest(t))], words)
                cells = _cell(rows)
                often, first, digests, sizes, kept = place[cells], [], [], [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    digest = _digest(rows[a:b])
                    if a == b or not seen.new(digest):
                        continue
                    n = b - a + 1 + (-least * (b - a) // 100)
                    first.append(a + np.argsort(often[a:b], kind="stable")[:n])
                    digests.append(digest)
                    sizes.append(b - a)
                    kept.append(n)
                if first:
                    first = np.concatenate(first)
                    deal, d = parts[cells[first]], np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                    d0, d1 = (np.repeat(d[:, k], kept) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[first].view(np.int64)), pa.array(((d1 & 0x7FFFFFFF) % deal + (deal > 1)).astype(np.int32)),
                         pa.array(d0), pa.array(d1), pa.array(np.repeat(np.array(sizes, np.int64), kept))], ["column", "part", "d0", "d1", "n"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by column, part and digest: each once, and none of columns that only one row has.

    A column dealt over parts is passed on whole, as its other rows may be in other parts.
    """
    rest: list[pa.RecordBatch] = []

    def several(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c, p, d0, d1 = (t.column(k).to_numpy() for k in ("column", "part", "d0", "d1"))
        apart = np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])]
        first = np.flatnonzero(apart | np.r_[True, (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1])])
        group = (np.cumsum(apart) - 1)[first]
        yield from t.take(pa.array(first[(np.bincount(group)[group] > 1) | (p[first] > 0)])).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*rest, batch])
        c, p = t.column("column").to_numpy(), t.column("part").to_numpy()
        other = np.flatnonzero((c != c[-1]) | (p != p[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        yield from several(t.slice(0, cut)) if cut else ()
        rest = t.slice(cut).combine_chunks().to_batches()
    if rest:
        yield from several(pa.Table.from_batches(rest))


def _asked_rows(words: int, bits: np.ndarray):
    """(digest, row) of the documents whose text's mark may be asked for, once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for texts in _pieces(batch.column(0).to_pylist()):
                marks = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.uint8).reshape(-1, 16).astype(np.int64)
                hit = np.ones(len(texts), bool)
                for k in (0, 3):
                    x = (marks[:, k] << 16 | marks[:, k + 1] << 8 | marks[:, k + 2]) % FILTER_BITS
                    hit &= (bits[x >> 5] >> (x & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
                rows, starts = shingles([texts[k] for k in np.flatnonzero(hit)], words)
                made = [(d, rows[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:]) if seen.new(d := _digest(rows[a:b]))]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)], ["digest", "row"])
    return run


def _overlaps(least: int):
    """The links among pairs (a, b, x, y) of rows x and y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                if (100 + least) * n >= least * len(both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["u", "v"])
    return run


def _rows_of(texts: DataFrame, pairs: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """(digest, row) of all digests in `pairs` (a, b), from one pass over the texts."""
    asked = written(pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct())
    place = lambda k: F.conv(F.hex(F.substring("mark", k, 3)), 16, 10).cast("int") % FILTER_BITS
    cells = distinct.join(asked, "digest", "left_semi").select(F.explode(F.array(place(1), place(4))).alias("x")).groupBy(
        F.shiftright("x", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, x & 31)")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for at, value in cells.collect():
        bits[at] = value
    rows = texts.mapInArrow(_asked_rows(words, bits), "digest binary, row binary").join(asked, "digest", "left_semi")
    return written(rows.dropDuplicates(["digest"]))


def _linked(rows: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Links (u, v) among the pairs (a, b) of digests, by the product of their whole rows."""
    both = pairs.select("a", "b").join(rows.select(F.col("digest").alias("a"), F.col("row").alias("x")), "a").join(
        rows.select(F.col("digest").alias("b"), F.col("row").alias("y")), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_overlaps(least), "u binary, v binary"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose ends are in different components as yet."""
    for end, label in (("a", "p"), ("b", "q")):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("component").alias(label)), end, "left")
    return pairs.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b", "n")


def _bounded(products: DataFrame, least: int) -> DataFrame:
    """Pairs whose overlap in the first block, with all that the second could add, reaches the bound."""
    counted = products.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    second = lambda c: F.floor((least * F.col(c) + 99) / 100) - 1  # noqa: E731  what the second block holds
    most = F.col("n") + F.greatest(second("x"), second("y"))
    return counted.where((100 + least) * most >= least * (F.col("x") + F.col("y"))).select("a", "b", "n")


def _sizes_fit(least: int):
    return 100 * F.least("x", "y") >= least * F.greatest("x", "y")


def near_classes(docs: DataFrame, words: int = WORDS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size and class of every row of `docs`: classes are the components of links of `least` per cent or more.

    A null text counts as empty; a row without words is linked with nothing, not even its like. Rows
    with equal sets link. Repeated ids stay separate rows; as a class is named by its smallest id, a null
    id only names a class that has no other. Columns other than the two named may have any name.

    Returns doc_id, n_shingles, component_id.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    first = written(source.mapInArrow(_rows_and_counts(words), "doc_id long, digest binary, n long, mark binary, cell int, count long"))
    marks = first.where("digest IS NOT NULL").select("doc_id", "digest", "n")
    distinct = written(first.where("n > 0").groupBy("digest", "mark").agg(F.min("doc_id").alias("low")))
    counts = np.zeros(CELLS, np.int64)
    for cell, count in first.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("count")).collect():
        counts[cell] = count
    texts = source.select("text")
    entries = texts.mapInArrow(_first_block(words, least, counts), "column long, part int, d0 long, d1 long, n long")
    dealt = entries.repartition("column", "part").sortWithinPartitions("column", "part", "d0", "d1")
    digest = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("d0", "d1")]))
    block = written(dealt.mapInArrow(_shared, "column long, part int, d0 long, d1 long, n long").select("column", digest.alias("digest"), "n"))

    # the smallest row of each column, among those of about one size, times the others; of its heads a row tries the likeliest
    alike = F.floor(F.log(F.col("n")) / F.log(F.lit(200 / (100 + least)))).alias("alike")
    sized = block.select("column", "digest", "n", alike)
    heads = sized.groupBy("column", "alike").agg(F.min(F.struct("n", "digest")).alias("head"))
    stars = sized.join(heads, ["column", "alike"]).select(
        F.col("head.digest").alias("a"), F.col("digest").alias("b"), F.col("head.n").alias("x"), F.col("n").alias("y")).where("a <> b")
    stars = written(_bounded(stars.where(_sizes_fit(least)), least).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")))
    links = _linked(_rows_of(texts, stars, distinct, words), stars, least)
    found = components(links)

    # the columns that still join different components
    named = written(block.join(found.withColumnRenamed("node", "digest"), "digest", "left").select(
        "column", "digest", "n", F.coalesce("component", "digest").alias("label")))
    mixed = named.groupBy("column").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("column")
    left = written(named.join(mixed, "column", "left_semi"))
    one, two = (left.select("column", F.col("digest").alias(d), F.col("n").alias(n), F.col("label").alias(c)) for d, n, c in (("a", "x", "p"), ("b", "y", "q")))
    across = one.join(two, "column").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & _sizes_fit(least))
    pairs = written(_bounded(across, least))

    # of these each row's likeliest, then whatever still lies across
    rows = _rows_of(texts, pairs, distinct, words)
    likely = [pairs.groupBy(end).agg(F.max_by(other, F.struct("n", other)).alias(other)).select("a", "b") for end, other in (("a", "b"), ("b", "a"))]
    links = links.unionByName(_linked(rows, likely[0].unionByName(likely[1]).distinct(), least))
    links = links.unionByName(_linked(rows, written(_apart(pairs, components(links))), least))
    whole = components(links)

    low = distinct.groupBy("digest").agg(F.min("low").alias("low")).join(
        whole, F.col("digest") == F.col("node"), "left").select("digest", "low", F.coalesce("component", "digest").alias("component"))
    low = written(low)
    names = low.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = low.join(names, "component").select("digest", "component_id")
    return marks.join(classes, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
