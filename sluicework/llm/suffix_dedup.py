"""Exact removal of repeated byte strings by a sampled suffix array and bucket-pointer refinement.

A byte goes if a string of `LENGTH` bytes that covers it starts at another place too. Sorting all
suffixes of a corpus would shuffle many times its size. Instead:

1. Each string of LENGTH bytes owns one *anchor*: the 32-byte gram in it with the least hash, the
   leftmost of equals. Equal strings own equal anchors at equal offsets, so only starts with the same
   anchor have to be compared. About one position in 185 is an anchor. The consecutive starts that
   share an anchor form a *run*, whose *span* is all the bytes its strings cover.
2. Runs are counted by (anchor, span). Equal spans settle whole runs, and groups of copies shrink to
   one row a task before anything is shuffled. An anchor that no other run has proves its strings unique.
3. Where an anchor has several spans, one run stands for each. The bytes of those spans are refined:
   initial buckets hold the starts of equal 100-grams; starts in one bucket are told apart by the
   buckets of the starts 100 bytes later, then by those 200 bytes later, until buckets hold equal
   400-byte strings. Every round works on the bucket numbers of the round before. An anchor with more
   than `HOT` spans is spread by string instead: its strings are counted one by one as rows.
4. Covered stretches are merged within a document and cut out.

The same search finds runs of 50 words that stand elsewhere too, whatever white space parts them: a text
is then the string of its words' 64-bit hashes, eight bytes each, and strings start at words only.
Beside them, strings of LENGTH bytes are looked for only where they hold fewer whole words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, text_of, written
from .shingle_join import word_hashes

LENGTH = 400
#: What a string may start at, in bytes: each byte of a text, or each word of the string of word hashes.
BYTES, WORDS = 1, 8
#: Words of the shortest passage: LENGTH bytes of word hashes.
PASSAGE = LENGTH // WORDS
#: Bytes of a gram that can be an anchor.
GRAM = 32
#: Bytes of a gram of the initial buckets: LENGTH is this times a power of two.
BUCKET = 100
#: Spans that one anchor may have in one task.
HOT = 4096
#: Bytes of spans that are refined at once.
_REFINED = 4 << 20
_STEP = 1 << 19
_WORD_END = re.compile(rb"[%s]|\Z" % SPACES.encode())
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _K[1]
    h ^= h >> np.uint64(32)
    return h


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _gram_hashes(data: np.ndarray, step: int) -> np.ndarray:
    x = _words(data)[::step]
    n = (len(data) - GRAM) // step + 1
    h = x[:n] * _K[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(31)
        h += x[8 * k // step:8 * k // step + n] * _K[k]
    return _mixed(h)


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = BYTES, skip: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The runs of texts that stand one behind the other in `data` from `starts` to `ends`.

    Starts of bytes that are marked in `skip` belong to no run.
    Returns document number, first start (from the text's start, in steps), number of starts, anchor hash.
    """
    wide = (LENGTH - GRAM) // step + 1
    found: list[tuple[np.ndarray, ...]] = []
    last = ends - LENGTH  # the last start in each text
    for at in range(0, len(data) - LENGTH + 1, _STEP):
        part = data[at:at + _STEP + LENGTH - step]
        hashes = _gram_hashes(part, step)
        low = hashes & ~np.uint64(0xFFFFFF)
        low |= np.arange(len(low), dtype=np.uint64)
        size = 1
        while size < wide:  # the least over `size` grams, then over twice as many or what is missing
            more = min(size, wide - size)
            low = np.minimum(low[:-more], low[more:])
            size += more
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.empty(len(place), bool)
        new[0] = True
        np.not_equal(place[1:], place[:-1], out=new[1:])
        for edge in (starts, last + step):
            inside = edge[(edge >= at) & (edge < at + step * len(place))] - at
            new[inside // step] = True
        if skip is not None:
            left_out = skip[at:at + len(place)]
            new[1:] |= left_out[1:] != left_out[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(place)])
        begin = first * step + at
        doc = np.searchsorted(starts, begin, side="right") - 1
        fits = (begin >= starts[doc]) & (begin <= last[doc])
        if skip is not None:
            fits &= ~left_out[first]
        first, count, doc, begin = first[fits], count[fits], doc[fits], begin[fits]
        found.append((doc, (begin - starts[doc]) // step, count, hashes[place[first]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def _joined_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_joined`, of the strings of word hashes of the texts."""
    hashes, places = word_hashes(b"\n".join(texts))
    at = WORDS * np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return hashes.view(np.uint8), at[:-1], at[1:]


def _wordy(data: np.ndarray) -> np.ndarray:
    """Whether the string from each place on holds PASSAGE words between its own white space."""
    gap = np.isin(data, np.frombuffer(SPACES.encode(), np.uint8))
    begun, ended = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
    np.cumsum(gap[:-1] & ~gap[1:], out=begun[2:])  # words that begin before a place, and behind white space
    np.cumsum(~gap[:-1] & gap[1:], out=ended[2:])
    return ended[LENGTH:] - begun[1:len(data) + 2 - LENGTH] >= PASSAGE


def _slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges with about `size` bytes of text each, so that very long texts don't pile up."""
    lengths = pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
    start = total = 0
    for row, n in enumerate(lengths):
        if total and total + n > size:
            yield start, row
            start, total = row, 0
        total += n
    if lengths:
        yield start, len(lengths)


def _find_runs(steps: tuple[int, ...]):
    """Rows (anchor, span, n, id, mark, step, lo, cnt, total) of (id, mark, text)."""
    def found(part: pa.RecordBatch, texts: list[bytes], step: int) -> pa.RecordBatch:
        data, starts, ends = (_joined if step == BYTES else _joined_words)(texts)
        fits = np.flatnonzero(ends - starts >= LENGTH)
        if not len(fits):
            data = data[:0]
        skip = _wordy(data) if step == BYTES and WORDS in steps and len(fits) else None
        doc, lo, cnt, anchor = runs(data, starts[fits], ends[fits], step, skip)
        doc = fits[doc]
        view, at = memoryview(data), (starts[doc] + step * lo).tolist()
        span = np.array([xxhash.xxh3_64_intdigest(view[s:s + step * (c - 1) + LENGTH], step) for s, c in zip(at, cnt.tolist())], np.uint64)
        # runs of equal spans right behind each other, as in text that repeats with a short period, become one row
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1]) & (span[1:] == span[:-1]) & (lo[1:] == lo[:-1] + cnt[:-1])
        head = np.flatnonzero(~same)
        n = np.diff(np.r_[head, len(doc)])
        total = np.add.reduceat(cnt, head) if len(head) else cnt
        doc = doc[head]
        return pa.RecordBatch.from_arrays([
            pa.array((anchor[head] ^ np.uint64(step)).view(np.int64)), pa.array(span[head].view(np.int64)), pa.array(n, pa.int64()),
            part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(np.full(len(doc), step, np.int32)),
            pa.array(lo[head]), pa.array(cnt[head], pa.int32()), pa.array(total)],
            ["anchor", "span", "n", "id", "mark", "step", "lo", "cnt", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch):
                part = batch.slice(a, b - a)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                for step in steps:
                    yield found(part, texts, step)
    return run


_RUNS = "anchor long, span long, n long, id long, mark long, step int, lo long, cnt int, total long"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans of each (id, mark, runs, text); of a hot anchor, the hashes of its strings."""
    names = ["anchor", "id", "mark", "step", "lo", "cnt", "single", "bytes", "string"]
    for batch in batches:
        for a, b in _slices(batch, 1 << 20):
            rows = []
            for row in batch.slice(a, b - a).to_pylist():
                text, data = row["text"].encode(), {}
                for r in row["runs"]:
                    key, step = (r["anchor"], row["id"], row["mark"], r["step"]), r["step"]
                    if step not in data:
                        data[step] = text if step == BYTES else word_hashes(text)[0].tobytes()
                    if not r["hot"]:
                        rows.append((*key, r["lo"], r["cnt"], r["single"], data[step][step * r["lo"]:step * (r["lo"] + r["cnt"] - 1) + LENGTH], None))
                        continue
                    for s in range(r["lo"], r["lo"] + r["cnt"]):
                        rows.append((*key, s, 1, r["single"], None, xxhash.xxh3_128_digest(data[step][step * s:step * s + LENGTH])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((
                pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names)


_SPANS = "anchor long, id long, mark long, step int, lo long, cnt int, single boolean, bytes binary, string binary"


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Bucket numbers: equal ones for places where all keys are equal."""
    joint = keys[0].astype(np.uint64)
    for key in keys[1:]:
        joint = joint << np.uint64(32) | key.astype(np.uint64)
    return np.unique(joint, return_inverse=True)[1].astype(np.uint32)


def repeated_strings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of `starts`, whether its LENGTH bytes of `data` are those of another start.

    Bucket-pointer refinement: a round at depth d sorts starts by (bucket of the start, bucket of the
    start d bytes later) and numbers the finer buckets, which the next round uses at depth 2d. Starts
    alone in their bucket are unique and drop out of all later rounds.
    """
    grams = _words(data)
    n = len(data) - BUCKET + 1
    h = grams[:n] * _K[0]
    for k in [*range(8, BUCKET - 7, 8), BUCKET - 8]:
        h ^= h >> np.uint64(31)
        h *= _K[2]
        h += grams[k:k + n] * _K[1]
    _mixed(h)
    result = np.zeros(len(starts), bool)
    live = np.arange(len(starts))
    bucket = np.zeros(n, np.uint32)
    depth = BUCKET
    needed = starts
    while True:
        # the places that later rounds look at: the live starts and their offsets in steps of the depth
        looked = np.zeros(n, bool)
        for offset in range(0, LENGTH, depth):
            looked[needed + offset] = True
        at = np.flatnonzero(looked)
        if depth == BUCKET:
            bucket[at] = _numbered(h[at])
        else:
            half = depth // 2
            bucket[at] = _numbered(bucket[at], bucket[at + half])
        own = bucket[starts[live]]
        many = np.bincount(own, minlength=1)[own] > 1
        live = live[many]
        if depth == LENGTH or not len(live):
            result[live] = True
            return result
        needed = starts[live]
        depth *= 2


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered starts (id, mark, step, lo, n) among runs that share anchors; an anchor's runs arrive together."""
    def refined(part: pa.Table) -> pa.RecordBatch:
        spans = part.column("bytes").to_pylist()
        data, begin, _ = _joined(spans)
        cnt, lo, step = (part.column(k).to_numpy().astype(np.int64) for k in ("cnt", "lo", "step"))
        owner = np.repeat(np.arange(len(cnt)), cnt)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        hit = repeated_strings(data, begin[owner] + shift * step[owner]) & part.column("single").to_numpy(zero_copy_only=False)[owner]
        goes_on = hit[1:] & hit[:-1] & (owner[1:] == owner[:-1])
        first = np.flatnonzero(hit & ~np.r_[False, goes_on])
        stop = np.flatnonzero(hit & ~np.r_[goes_on, False]) + 1
        who = owner[first]
        take = pa.array(who)
        return pa.RecordBatch.from_arrays(
            [part.column(k).combine_chunks().take(take) for k in ("id", "mark", "step")]
            + [pa.array(lo[who] + shift[first]), pa.array(stop - first)], ["id", "mark", "step", "lo", "n"])

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.column("bytes").nbytes
        if size < _REFINED:
            continue
        part = pa.concat_tables(held).combine_chunks()
        anchors = part.column("anchor").to_numpy()
        new = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        heads = np.r_[0, new, len(anchors)]
        sizes = np.cumsum(np.r_[0, [len(x) for x in part.column("bytes").to_pylist()]])
        start = 0
        for k in range(1, len(heads) - 1):  # the last anchor may go on in the next batch
            if sizes[heads[k]] - sizes[start] >= _REFINED or k == len(heads) - 2:
                yield refined(part.slice(start, heads[k] - start))
                start = int(heads[k])
        held = [part.slice(start)]
        size = int(sizes[-1] - sizes[start])
    if held and sum(t.num_rows for t in held):
        yield refined(pa.concat_tables(held).combine_chunks())


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """(id, mark, text): a row is known by its id and its text, as ids may be null or repeated."""
    t = text_of(text)
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(t).alias("mark"), *more, t.alias("text"))


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, passages: bool = False) -> DataFrame:
    """(id, mark, step, lo, hi): stretches, from lo to before hi, that repeated strings cover.

    They count bytes where step is BYTES. With `passages` there are stretches of repeated runs of
    PASSAGE words, which count words; their step is WORDS. Strings of bytes then are those without
    PASSAGE words between their own white space, as the words of all others are found that way.
    """
    texts = _keyed(docs, doc_id, text)
    steps = (BYTES, WORDS) if passages else (BYTES,)
    least = 2 * PASSAGE - 1 if passages else LENGTH  # no shorter text has a string
    found = written(texts.where(F.octet_length("text") >= least).mapInArrow(_find_runs(steps), _RUNS), compression="zstd")
    spans = written(found.groupBy("anchor", "span").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("id", "mark", "step", "lo", "cnt")]), compression="zstd")  # of one run, all five
    beyond = F.when(F.col("step") == BYTES, LENGTH).otherwise(PASSAGE) - 1
    full = spans.where("n > 1").select("anchor", "span")
    settled = found.join(full, ["anchor", "span"]).select(
        "id", "mark", "step", "lo", (F.col("lo") + F.col("total") + beyond).alias("hi"))

    mixed = spans.groupBy("anchor").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("ones")).where("k > 1 AND ones > 0")
    open_runs = spans.join(mixed, "anchor").select("id", "mark", F.struct(
        "anchor", "step", "lo", "cnt", (F.col("n") == 1).alias("single"), (F.col("k") > hot).alias("hot")).alias("run"))
    by_text = open_runs.groupBy("id", "mark").agg(F.collect_list("run").alias("runs"))
    shown = written(by_text.join(texts, ["id", "mark"]).select("id", "mark", "runs", "text").mapInArrow(_spans, _SPANS), compression="zstd")

    refined = shown.where("bytes IS NOT NULL").select("anchor", "id", "mark", "step", "lo", "cnt", "single", "bytes").repartition(
        "anchor").sortWithinPartitions("anchor").mapInArrow(_refine, "id long, mark long, step int, lo long, n long")
    strings = shown.where("string IS NOT NULL").select("anchor", "id", "mark", "step", "lo", "single", "string")
    twice = strings.groupBy("anchor", "string").count().where("count > 1")
    spread = strings.where("single").join(twice, ["anchor", "string"]).select("id", "mark", "step", "lo", F.lit(1).cast("long").alias("n"))
    return settled.unionByName(refined.unionByName(spread).select(
        "id", "mark", "step", "lo", (F.col("lo") + F.col("n") + beyond).alias("hi")))


def merged(stretches: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal stretches of overlapping or touching ones."""
    out: list[list[int]] = []
    for lo, hi in sorted(stretches):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _in_bytes(data: bytes, words: list[list[int]]) -> list[list[int]]:
    """Where stretches of words begin and end in a text."""
    if not words:
        return []
    places = word_hashes(data)[1]
    return [[int(places[lo]), _WORD_END.search(data, int(places[hi - 1])).start()] for lo, hi in words]


def _stretches(cuts: list[dict] | None, step: int) -> list[list[int]]:
    return merged([(c["lo"], c["hi"]) for c in cuts or () if c["step"] == step])


def _marked(docs: DataFrame, doc_id: str, text: str, hot: int, row: Column, passages: bool = False, spared: DataFrame | None = None) -> DataFrame:
    """(row, cuts, text): the stretches to cut from each row of `docs`."""
    stretches = covered(docs, doc_id, text, hot, passages)
    if spared is not None:
        stretches = stretches.join(spared.select(F.col("mark").alias("spared")), (F.col("step") == WORDS) & (F.col("mark") == F.col("spared")), "left_anti")
    stretches = stretches.groupBy("id", "mark").agg(F.collect_set(F.struct("step", "lo", "hi")).alias("cuts"))
    return _keyed(docs, doc_id, text, row.alias("row")).join(stretches, ["id", "mark"], "left").select("row", "cuts", "text")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """What is cut from every row of `docs`, and the digest of what stays.

    A null text counts as empty. Rows with equal texts repeat each other, and so do rows with equal
    ids: every row is a place of its own. Columns other than the two named may have any name.

    Returns doc_id, n_bytes, n_removed, n_spans (long), kept_sha256.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cuts, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = value.encode()
                gone = _stretches(cuts, BYTES)
                rest, at = hashlib.sha256(), 0
                for lo, hi in gone:
                    rest.update(data[at:lo])
                    at = hi
                rest.update(data[at:])
                rows.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), rest.hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs, doc_id, text, hot, F.col(doc_id).cast("long")).mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, passages: bool = False,
                    spared: DataFrame | None = None) -> DataFrame:
    """`docs` with repeated strings cut out of the text; all columns and rows stay.

    With `passages`, so are whole words of runs of PASSAGE words that stand elsewhere too, and the white
    space between them, but for texts whose xxhash64 is a `mark` of `spared`; they still count as places.
    A cut that begins or ends inside a character leaves that character whole. Null texts stay null.
    """
    packed = F.struct(F.col(text).isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text])
    marked = _marked(docs, doc_id, text, hot, packed, passages, spared).select("row", "cuts", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for cuts, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if cuts:
                    data, at, parts = value.encode(), 0, []
                    gone = _stretches(cuts, BYTES) + _in_bytes(data, _stretches(cuts, WORDS))
                    for lo, hi in merged(gone):
                        while lo < hi and data[lo] & 0xC0 == 0x80:
                            lo += 1
                        while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
                            hi -= 1
                        parts.append(data[at:lo])
                        at = hi
                    value = b"".join([*parts, data[at:]]).decode()
                texts.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    done = marked.mapInArrow(cut, marked.drop("cuts").schema)
    return done.select(*[
        F.when(~F.col("row.none"), F.col("text")).alias(c) if c == text else F.col(f"row.c{k}").alias(c)
        for k, c in enumerate(docs.columns)])
