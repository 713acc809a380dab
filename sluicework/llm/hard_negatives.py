"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

1. Split points are chosen far apart from each other on a bounded sample; a vector belongs to the
   nearest one of each node on its way down. Every row is indexed. For each pair of split points of a
   node, all rows together give the range of distances from the one to the subtree of the other.
2. A query wants scores within a window. With the norms of a subtree that is an annulus of distances
   around the anchor, and the subtree is passed over where, for some split point, the distances that
   its range allows do not meet the annulus.
3. Leaves that remain are searched in full, in blocks: scores are exact integer inner products.

Positives are searched in the anchor's own leaf first, whose fifth score opens the window for the rest;
each positive's score then is the window of its negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share of the positive's, in per cent, and at most the whole.
LEAST = 80
#: Split points a node, levels of nodes, and the most rows that split points are chosen from.
FAN, LEVELS, FIT = 16, 2, 4096
#: Rows of a leaf, and queries, that one task takes together.
BLOCK, QUERY_BLOCK = 32_768, 32_768
_TILE = 1 << 22


class Node(NamedTuple):
    """Split points (k x d), children (a node or None), and the number of the first leaf below."""

    number: int
    points: np.ndarray
    children: list
    first: int


def _packed(values: np.ndarray) -> bytes:
    """Components as 16 bits where all fit, else 64."""
    small = not len(values) or np.abs(values).max() < 1 << 15
    return values.astype("<i2" if small else "<i8").tobytes()


def _unpacked(blobs: list[bytes], dims: int) -> np.ndarray:
    """Integer rows; a vector shorter than the longest one ends in zeros."""
    if blobs and all(len(b) == 2 * dims for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i2").reshape(len(blobs), dims).astype(np.int64)
    out = np.zeros((len(blobs), dims), np.int64)
    for k, blob in enumerate(blobs):
        values = np.frombuffer(blob[1:], "<i8") if len(blob) % 2 else np.frombuffer(blob, "<i2")
        out[k, :len(values)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0 ** 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0 ** 63:
        return a @ b.T
    raise OverflowError("scores do not fit 64 bits")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, fan: int = FAN, levels: int = LEVELS) -> list[Node]:
    """All nodes of the tree, the root first."""
    nodes: list[Node] = []
    leaves = [0]

    def split(rows: np.ndarray, depth: int) -> Node | None:
        rows = np.unique(rows, axis=0)
        if depth == levels or len(rows) < 2 * fan:
            return None
        chosen = [0]
        far = _distances(rows, rows[:1])[:, 0]
        while len(chosen) < fan and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distances(rows, rows[chosen[-1:]])[:, 0])
        points = rows[chosen]
        nodes.append(None)
        number, mine = len(nodes) - 1, _distances(rows, points).argmin(1)
        first, children = leaves[0], []
        for k in range(len(points)):
            child = split(rows[mine == k], depth + 1)
            children.append(child)
            leaves[0] += child is None
        nodes[number] = Node(number, points, children, first)
        return nodes[number]

    if split(sample, 0) is None:
        points = sample[:1] if len(sample) else np.zeros((1, sample.shape[1]), np.int64)
        nodes[:] = [Node(0, points, [None], 0)]
    return nodes


def _leaf_numbers(node: Node) -> list:
    """For each child its leaf number, or None for a child that is a node."""
    out, now = [], node.first
    for child in node.children:
        if child is None:
            out.append(now)
            now += 1
        else:
            out.append(None)
            now += _count(child)
    return out


def _count(node: Node) -> int:
    return sum(1 if c is None else _count(c) for c in node.children)


class _Ranges:
    """Least and greatest distance from split point i to the subtree of j, and squared norms (i = -1), of each node."""

    def __init__(self, nodes: list[Node]):
        self.low = [np.full((len(n.points) + 1, len(n.points)), np.inf) for n in nodes]
        self.high = [np.full((len(n.points) + 1, len(n.points)), -np.inf) for n in nodes]

    def add(self, node: int, j: int, distances: np.ndarray, norms: np.ndarray) -> None:
        both = np.c_[norms, distances]
        self.low[node][:, j] = np.minimum(self.low[node][:, j], both.min(0))
        self.high[node][:, j] = np.maximum(self.high[node][:, j], both.max(0))

    def rows(self) -> Iterator[tuple]:
        for node, (low, high) in enumerate(zip(self.low, self.high)):
            for i, j in zip(*np.nonzero(low <= high)):
                yield node, int(i) - 1, int(j), float(low[i, j]), float(high[i, j])


def _assigned(vectors: np.ndarray, node: Node, ranges: _Ranges) -> np.ndarray:
    out = np.empty(len(vectors), np.int32)
    away, norms = _distances(vectors, node.points), (vectors.astype(np.float64) ** 2).sum(1)
    mine = away.argmin(1)
    for j, leaf in enumerate(_leaf_numbers(node)):
        at = np.flatnonzero(mine == j)
        if len(at):
            ranges.add(node.number, j, away[at], norms[at])
            out[at] = leaf if leaf is not None else _assigned(vectors[at], node.children[j], ranges)
    return out


_INDEX = "vec_id long, label int, v binary, leaf int, node int, i int, j int, low double, high double"


def _indexed(nodes: list[Node], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(nodes)
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            leaf = _assigned(_unpacked(blobs, dims), nodes[0], ranges) if blobs else np.empty(0, np.int32)
            none = [pa.nulls(len(leaf), t) for t in (pa.int32(),) * 3 + (pa.float64(),) * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaf), *none],
                                             ["vec_id", "label", "v", "leaf", "node", "i", "j", "low", "high"])
        rows = list(ranges.rows())
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(),) * 3 + (pa.float64(),) * 2)]
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, *cols], ["vec_id", "label", "v", "leaf", "node", "i", "j", "low", "high"])
    return run


def _survivors(anchors: np.ndarray, low: np.ndarray, high: np.ndarray, node: Node, ranges: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of the anchors that must search it); a window without end has `high` infinite.

    `low` and `high` are score windows, one row an anchor and one column a window; nan for none.
    """
    least, most = ranges[node.number]
    norms = (anchors.astype(np.float64) ** 2).sum(1)
    away = _distances(anchors, node.points)
    slack = 1e-6 * (1 + np.sqrt(norms))
    for j, leaf in enumerate(_leaf_numbers(node)):
        if not np.isfinite(least[0, j]):
            continue  # no row is there
        near = np.maximum(np.maximum(away - most[1:, j], least[1:, j] - away).max(1), 0) - slack
        far = (away + most[1:, j]).min(1) + slack
        inner = np.sqrt(np.maximum(norms[:, None] + least[0, j] - 2 * high, 0)) - slack[:, None]
        outer = np.sqrt(np.maximum(norms[:, None] + most[0, j] - 2 * low, 0)) + slack[:, None]
        touched = (norms[:, None] + most[0, j] - 2 * low >= -1) & (near[:, None] <= outer) & (far[:, None] >= inner)
        at = np.flatnonzero(touched.any(1))
        if len(at) and leaf is not None:
            yield leaf, at
        elif len(at):
            for below, some in _survivors(anchors[at], low[at], high[at], node.children[j], ranges):
                yield below, at[some]


class Index(NamedTuple):
    """Every row (vec_id, label, v, leaf) in a written table, the tree, its ranges, and the rows of each leaf."""

    rows: DataFrame
    nodes: list[Node]
    ranges: dict
    sizes: dict
    dims: int


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components times the scale, rounded down, packed; 64-bit ones carry their width in a leading byte."""
    for batch in batches:
        col = batch.column(2)
        ends = col.offsets.to_numpy()
        flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        if len(flat) and np.abs(flat).max() >= 2.0 ** 63:
            raise OverflowError("a component does not fit 64 bits")
        flat, start = flat.astype(np.int64), ends[0]
        blobs = []
        for a, b in zip(ends[:-1] - start, ends[1:] - start):
            blob = _packed(flat[a:b])
            blobs.append(b"\x08" + blob if len(blob) != 2 * (b - a) else blob)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["vec_id", "label", "v"])


def index(rows: DataFrame, fan: int = FAN, levels: int = LEVELS, fit_rows: int = FIT) -> Index:
    """Index every row of (vec_id, label, vector), fitted on the `fit_rows` rows with the least hash of their id."""
    packed = rows.mapInArrow(_whole, "vec_id long, label int, v binary")
    once = written(packed.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"))
    wide = F.when(F.length("v") % 2 == 1, F.floor(F.length("v") / 8)).otherwise(F.floor(F.length("v") / 2))
    dims = once.agg(F.max(wide)).first()[0] or 0
    sample = once.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").collect()
    nodes = fit(_unpacked([r[0] for r in sample], dims), fan, levels)
    made = written(once.mapInArrow(_indexed(nodes, dims), _INDEX))
    spans = made.where("node IS NOT NULL").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    ranges = {n.number: (np.full((len(n.points) + 1, len(n.points)), np.inf), np.full((len(n.points) + 1, len(n.points)), -np.inf)) for n in nodes}
    for r in spans:
        ranges[r["node"]][0][r["i"] + 1, r["j"]], ranges[r["node"]][1][r["i"] + 1, r["j"]] = r["low"], r["high"]
    every = made.where("leaf IS NOT NULL").select("vec_id", "label", "v", "leaf")
    sizes = {r["leaf"]: r["count"] for r in every.groupBy("leaf").count().collect()}
    return Index(every, nodes, ranges, sizes, dims)


def _routed(ix: Index, everywhere_but_home: bool):
    """Queries (anchor_id, label, v, leaf, low, high) to each leaf that a window of theirs may meet."""
    dims, root, ranges = ix.dims, ix.nodes[0], ix.ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            anchors = _unpacked(t["v"].to_pylist(), dims)
            home = t["leaf"].to_numpy()
            width = max(1, max(len(x) for x in t["low"].to_pylist()))
            low, high = (np.array([x + [np.nan] * (width - len(x)) for x in t[c].to_pylist()], np.float64) for c in ("low", "high"))
            low, high = np.where(np.isnan(low), -np.inf, low) if everywhere_but_home else low, np.where(np.isnan(high), np.inf, high) if everywhere_but_home else high
            for leaf, at in _survivors(anchors, low, high, root, ranges):
                at = at[home[at] != leaf] if everywhere_but_home else at
                if len(at):
                    part = t.take(pa.array(at))
                    yield from part.set_column(part.schema.get_field_index("leaf"), "leaf", pa.array(np.full(len(at), leaf, np.int32))).to_batches()
    return run


def _blocked(ix: Index, queries: DataFrame, n_queries: int, search, schema: str) -> DataFrame:
    """Each block of a leaf's rows against each block of the queries sent to that leaf."""
    parts = {leaf: -(-n // BLOCK) for leaf, n in ix.sizes.items()}
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    many = {leaf: n for leaf, n in parts.items() if n > 1}
    of = F.lit(1)
    for leaf, n in many.items():  # at most as many as the tree has leaves
        of = F.when(F.col("leaf") == leaf, n).otherwise(of)
    rows = ix.rows.select("leaf", F.pmod(F.xxhash64("vec_id"), of).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "label", "v")
    sent = queries.withColumns({"block": F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0), of - 1))})
    keys = ["leaf", "part", "block"]
    return rows.withColumn("part", F.col("part").cast("int")).groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, schema)


def _tiles(q: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, _TILE // max(1, len(rows)))
    for a in range(0, len(q), step):
        yield a, _products(q[a:a + step], rows)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the best `most` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1] if len(g) else np.empty(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < most]


def _positives(dims: int, most: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            x, q = (_unpacked(t["v"].to_pylist(), dims) for t in (rows, queries))
            anchors, own = queries["anchor_id"].to_numpy(), queries["label"].to_numpy()
            low = np.array([v[0] if v else np.nan for v in queries["low"].to_pylist()], np.float64)
            for a, s in _tiles(q, x):
                b = a + len(s)
                fits = (labels[None, :] == own[a:b, None]) & (ids[None, :] != anchors[a:b, None]) & ~(s < low[a:b, None])
                i, j = np.nonzero(fits)
                best = _first(i, s[i, j], ids[j], most)
                out.append((anchors[a:b][i[best]], ids[j[best]], s[i[best], j[best]]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])
    return search


def _negatives(dims: int, most: int, least: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            x, q = (_unpacked(t["v"].to_pylist(), dims) for t in (rows, queries))
            anchors, own = queries["anchor_id"].to_numpy(), queries["label"].to_numpy()
            found = [[(p["positive_id"], p["positive_score"]) for p in ps] for ps in queries["positives"].to_pylist()]
            width = max(map(len, found))
            ps = np.array([[s for _, s in f] + [-1] * (width - len(f)) for f in found], np.int64)  # a negative score has no window
            pid = np.array([[p for p, _ in f] + [-1] * (width - len(f)) for f in found], np.int64)
            for a, s in _tiles(q, x):
                b = a + len(s)
                other = (labels[None, :] != own[a:b, None]) & (ids[None, :] != anchors[a:b, None])
                for w in range(width):
                    top = ps[a:b, w, None]
                    i, j = np.nonzero(other & (s <= top) & (100 * s >= least * top) & (top >= 0))
                    best = _first(i, s[i, j], ids[j], most)
                    i, j = i[best], j[best]
                    out.append((anchors[a:b][i], pid[a:b, w][i], ps[a:b, w][i], ids[j], s[i, j]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(5)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                    names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return search


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", **tree) -> DataFrame:
    """The first `negatives` different-label rows in the window of each of the first `positives` of each anchor.

    `anchors` says which rows are anchors. Rows with a null id, label or vector, or with a component
    that is null or not finite, take no part; of rows that share an id the one with the least label, then
    the least packed vector does. A shorter vector counts as ending in zeros. A positive with a negative
    score has an empty window. Columns other than the three named may have any name.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    usable = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("vector"),
                         F.coalesce(anchors, F.lit(False)).alias("asked"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("vector")))
    ix = index(usable.select("vec_id", "label", "vector"), **tree)
    asked = usable.where("asked").select(F.col("vec_id").alias("_id")).distinct()
    queries = written(ix.rows.join(asked, F.col("vec_id") == F.col("_id"), "left_semi").select(F.col("vec_id").alias("anchor_id"), "label", "v", "leaf"))
    count = queries.count()
    pairs = "anchor_id long, positive_id long, positive_score long"
    numbers = lambda c: F.array(c.cast("double"))
    unbounded = queries.withColumns({"low": F.array().cast("array<double>"), "high": F.array().cast("array<double>")})
    search = _positives(ix.dims, positives)
    home = written(_blocked(ix, unbounded, count, search, pairs))
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = home.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= positives)
    floor = best.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) == positives, F.min("positive_score")).alias("floor"))
    opened = queries.join(floor, "anchor_id", "left").withColumns({
        "low": F.when(F.col("floor").isNotNull(), numbers(F.col("floor"))).otherwise(F.array().cast("array<double>")),
        "high": F.array().cast("array<double>")}).select("anchor_id", "label", "v", "leaf", "low", "high")
    query_type = "anchor_id long, label int, v binary, leaf int, low array<double>, high array<double>"
    rest = _blocked(ix, opened.mapInArrow(_routed(ix, True), query_type), count, search, pairs)
    found = written(home.unionByName(rest).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= positives).drop("_r"))
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    windows = queries.join(lists, "anchor_id").withColumns({
        "low": F.transform("positives", lambda p: F.when(p["positive_score"] >= 0, p["positive_score"] * least / 100.0).otherwise(F.lit(None)).cast("double")),
        "high": F.transform("positives", lambda p: F.when(p["positive_score"] >= 0, p["positive_score"]).cast("double"))})
    windows = windows.withColumns({c: F.transform(c, lambda x: F.coalesce(x, F.lit(float("nan")))) for c in ("low", "high")})
    routed = windows.select("anchor_id", "label", "v", "leaf", "low", "high", "positives").mapInArrow(
        _routed(ix, False), query_type + ", positives array<struct<positive_id:long,positive_score:long>>")
    hits = _blocked(ix, routed, count, _negatives(ix.dims, negatives, least), pairs + ", negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
