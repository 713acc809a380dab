"""SimHash near-dedup with a Gray-order hierarchical index.

1. Fingerprints: one Arrow pass over whole texts; equal fingerprints meet in an aggregate, so copies
   cost one row a task from there on.
2. Candidates: 64 bits in four segments of 16. Two fingerprints that differ in two bits or fewer agree
   in two segments at least, so each distinct fingerprint is sent to six groups, one for each pair of
   segments. A group of more than `GROUP` fingerprints is split the same way by parts of its other
   bits, which keeps every link and bounds what one task holds.
3. Within a group the fingerprints stand in Gray order. Runs of them share many bits: each upper node
   keeps the mask and the pattern that all fingerprints below share, and a search drops whole nodes
   when their shared bits differ too often already. A group passes on a spanning forest, not its pairs.
4. Components: alternating large-star and small-star steps over the forest edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of, written

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Distinct fingerprints that a group may have before it is split by more of their bits.
GROUP = 4096
#: Children of a node of the index.
FAN = 8
_CHUNK = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text as a signed integer; zero without words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six white-space bytes
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        part = words[start:start + _CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["doc_id", "mark", "fp"])
    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_links(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), a < b, of positions in `codes` whose codes differ in `radius` bits or fewer.

    `codes` are distinct and in Gray order. Level 0 has the codes; a node above them has the mask of
    the bits that all codes below share and their pattern. Pairs of nodes are opened from the top;
    a pair whose common shared bits differ in more than `radius` places is dropped as a whole.
    """
    masks, patterns = [np.full(len(codes), ~np.uint64(0))], [codes]
    while len(masks[-1]) > FAN:
        edges = np.arange(0, len(masks[-1]), FAN)
        mask, pattern = masks[-1], patterns[-1]
        shared = np.bitwise_and.reduceat(mask, edges)
        same = ~(np.bitwise_or.reduceat(pattern, edges) ^ np.bitwise_and.reduceat(pattern, edges))
        masks.append(shared & same)
        patterns.append(np.bitwise_and.reduceat(pattern, edges) & masks[-1])
    top = np.arange(len(masks[-1]))
    a, b = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    a, b = a[a <= b], b[a <= b]
    for level in range(len(masks) - 1, -1, -1):
        both = masks[level][a] & masks[level][b]
        near = np.bitwise_count((patterns[level][a] ^ patterns[level][b]) & both) <= radius
        a, b = a[near], b[near]
        if level == 0:
            break
        n = len(masks[level - 1])
        below = np.arange(FAN)
        a, b = (
            (a[:, None, None] * FAN + below[None, :, None] + 0 * below[None, None, :]).ravel(),
            (b[:, None, None] * FAN + below[None, None, :] + 0 * below[None, :, None]).ravel(),
        )
        inside = (a < n) & (b < n) & (a <= b)
        a, b = a[inside], b[inside]
    return a[a < b], b[a < b]


def _forest(codes: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code with a link: its id and the smallest id it reaches within the group."""
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, ids = codes[order], ids[order]
    a, b = gray_links(codes, radius)
    root = ids.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    linked = root != ids
    return ids[linked], root[linked]


def _group_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive one after the other; most hold one fingerprint and are passed over at once."""
        rest: list[pa.RecordBatch] = []

        def links(part: pa.Table) -> Iterator[pa.RecordBatch]:
            t, k, m = (part.column(c).to_numpy() for c in ("t", "k", "more"))
            fp, rep = part.column("fp").to_numpy().view(np.uint64), part.column("rep").to_numpy()
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(t)]
            us, vs = [], []
            for s, e in zip(*(x[ends - starts > 1] for x in (starts, ends))):
                u, v = _forest(fp[s:e], rep[s:e], radius)
                us.append(u), vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([*rest, batch])
            keys = [part.column(c).to_numpy() for c in ("t", "k", "more")]
            last = np.logical_and.reduce([x == x[-1] for x in keys])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            yield from links(part.slice(0, cut)) if cut else ()
            rest = part.slice(cut).combine_chunks().to_batches()
        if rest:
            yield from links(pa.Table.from_batches(rest))
    return run


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _routes() -> list[tuple[int, int]]:
    return [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _routed(distinct: DataFrame, group: int) -> DataFrame:
    """(t, k, more, fp, rep): six rows a fingerprint; in groups over `group` rows three, then nine for each.

    `more` tells the parts of a split group apart. The 32 bits that a group's key leaves out are two
    segments of 16; of three parts of them at least one agrees if two bits differ, and so once more
    for the bits that are left after that.
    """
    fp = F.col("fp")
    parts = []
    for t, (i, j) in enumerate(_routes()):
        others = [s for s in range(4) if s not in (i, j)]
        key = F.shiftleft(_bits(fp, 16 * i, 16), 16).bitwiseOR(_bits(fp, 16 * j, 16))
        left = F.shiftleft(_bits(fp, 16 * others[0], 16), 16).bitwiseOR(_bits(fp, 16 * others[1], 16))
        parts.append(F.struct(F.lit(t).alias("t"), key.alias("k"), left.alias("left")))
    routes = distinct.select("fp", "rep", F.explode(F.array(*parts)).alias("r")).select("fp", "rep", "r.t", "r.k", "r.left")

    def counted(rows: DataFrame) -> DataFrame:
        big = rows.groupBy("t", "k", "more").count().where(F.col("count") > group).select(
            "t", "k", "more", F.lit(True).alias("big"))
        return rows.join(big, ["t", "k", "more"], "left")

    def split(rows: DataFrame, spans: list[tuple[int, int]], tag: int) -> DataFrame:
        """One row for each span of `left` bits; the span's bits leave `left` and go into `more`."""
        made = []
        for n, (low, width) in enumerate(spans):
            rest = F.shiftleft(F.shiftrightunsigned("left", low + width), low).bitwiseOR(_bits(F.col("left"), 0, low))
            more = F.shiftleft(F.col("more"), 16).bitwiseOR(F.lit(tag + n).bitwiseOR(F.shiftleft(_bits(F.col("left"), low, width), 4)))
            made.append(F.struct(more.alias("more"), rest.alias("left")))
        return rows.select("fp", "rep", "t", "k", F.explode(F.array(*made)).alias("s")).select(
            "fp", "rep", "t", "k", "s.more", "s.left")

    first = counted(routes.withColumn("more", F.lit(0).cast("long")))
    second = counted(split(first.where("big"), [(0, 11), (11, 11), (22, 10)], 1))
    third = split(second.where("big"), [(0, 7), (7, 7), (14, 7)], 5)
    keep = ["t", "k", "more", "fp", "rep"]
    return first.where("big IS NULL").select(keep).unionByName(second.where("big IS NULL").select(keep)).unionByName(third.select(keep))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (u, v; long) reaches.

    Large-star and small-star steps in turn; every step writes its edges to the shared folder. Stars
    are aggregates and joins, so a node with very many edges is pre-aggregated and its join split.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.*").where("u <> v").distinct()
        small = written(small)
        # done when every edge joins a node to the centre of its star and no centre has a smaller neighbour
        more = small.groupBy("u").agg(F.count_if(F.lit(True)).alias("n")).where("n > 1").select("u").unionByName(
            small.select("v").join(small.select("u"), F.col("v") == F.col("u"), "left_semi").select(F.col("v").alias("u")))
        if more.isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = small


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, group: int = GROUP,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and component of every row of `docs`.

    A null text counts as empty; texts without words share fingerprint zero and are linked like any
    other. Repeated ids stay separate rows; as a component is named by its smallest id, a null id only
    names a component that has no other. Columns other than the two named may have any name.

    Returns doc_id, fingerprint (16 lower-case hexadecimal digits), component_id, mark (hash of the text).
    """
    if not 0 <= radius <= 2:
        raise ValueError("the routing keeps every link up to two bits")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    marks = written(rows.mapInArrow(_fingerprints(shingle), "doc_id long, mark long, fp long"))
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    routed = _routed(distinct.where("rep IS NOT NULL"), group).repartition("t", "k", "more").sortWithinPartitions("t", "k", "more")
    edges = routed.mapInArrow(_group_links(radius), "u long, v long")
    found = components(edges)
    named = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "mark")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of `docs` for each component: one that has the smallest id; all columns stay as they are.

    Rows with one id and one text are one document. Rows without an id stay only where their
    fingerprint has no row with an id, one for each fingerprint.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f")).agg(
        F.min("mark").alias("_mark")).select(F.col("component_id").alias("_id"), "_mark")
    keys = [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_k0"), F.col(doc_id).isNull().alias("_k1"), F.xxhash64(text_of(text)).alias("_k2")]
    mine = [F.coalesce("_id", F.lit(0)).alias("_k0"), F.col("_id").isNull().alias("_k1"), F.col("_mark").alias("_k2")]
    names = ["_k0", "_k1", "_k2"]
    packed = docs.select(*keys, F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"))
    kept = packed.join(chosen.select(*mine), names, "left_semi").dropDuplicates(names)
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
