"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

1. Every row is a leaf, its digest made of length-prefixed fields. Each group of rows (one language,
   say) is a tree of its own, whose leaves are numbered by order of their ids; the trees' roots are the
   leaves of one more tree.
2. Every eight consecutive nodes become their parent. A level is stored as records: digest to children.
3. Requests descend from the root. A node that some request passes is opened by its digest; the octal
   digits of the requested ranks select children, and the children not selected go into the path of
   those that are. Requests below one node descend as one row until their paths part, so that a level
   has no more rows than nodes. The segments of a path, reversed, are the proof from the leaf upwards.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Nodes below one parent; a rank's octal digits are the way down.
FAN_BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = "struct<digit:int,others:array<string>>"


class Manifest(NamedTuple):
    """`leaves`: doc_id, tree, height, at, leaf and the caller's extra columns. `levels` and `top`: one table of
    (tree, height, at, digest, children) a level, lowest first. `subroots`: tree, height, digest, top_height, top_at.
    `root`: one row with digest and height, none for an empty dataset."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: DataFrame


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `at`, the place within the group from 0, and `size`, the rows of the group.

    Range partitions in the order of group and place are numbered on their own; what the partitions
    before have of the same group is added. So a group of any size is spread, and only one count for
    each partition and group is ever brought together. `order` should leave no ties but whole rows.
    """
    placed = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumns(
        {"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    counts = placed.groupBy(group, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    return placed.join(starts, [group, "_part"]).withColumn("at", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree: the octal digits of its last rank, none for a single leaf."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, 8))).otherwise(0)


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels above `nodes` (tree, height, at, digest), and the root of each tree."""
    top = nodes.agg(F.max("height")).first()[0] or 0
    levels, roots = [], nodes.where("height = 0").select("tree", "height", "digest")
    for level in range(1, top + 1):
        children = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda c: c["digest"])
        grouped = nodes.where(F.col("height") >= level).groupBy(
            "tree", "height", F.shiftright("at", FAN_BITS).alias("up")).agg(children.alias("children"))
        levels.append(written(grouped.select("tree", "height", F.col("up").alias("at"), joined(F.col("children")).alias("digest"), "children")))
        nodes = levels[-1]
        roots = roots.unionByName(nodes.where(F.col("height") == level).select("tree", "height", "digest"))
    return levels, written(roots)


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id",
          extra: dict[str, Column] | None = None) -> Manifest:
    """The manifest of every row of `docs`.

    Leaves of a tree ascend by `doc_id`, a null id first; rows with one id ascend by digest, and equal
    rows are leaves of their own with equal digests. A null tree comes before all others. Columns not
    named in `fields` take no part, so they may have any name. `extra` are columns kept beside each leaf.
    """
    named = F.col(tree).cast("string")
    leaves = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("tree"),
        digest_of(*[F.col(c) for c in fields]).alias("leaf"), *[v.alias(k) for k, v in (extra or {}).items()]))
    leaves = written(ranked(leaves, "tree", "doc_id", "leaf").withColumn("height", _height(F.col("size"))).drop("size"))
    levels, subroots = _grown(leaves.select("tree", "height", "at", F.col("leaf").alias("digest")))
    tops = written(ranked(subroots.withColumn("all", F.lit("")), "all", "tree").select(
        "tree", "height", "digest", _height(F.col("size")).alias("top_height"), F.col("at").alias("top_at")))
    top, root = _grown(tops.select(F.lit("").alias("tree"), F.col("top_height").alias("height"), F.col("top_at").alias("at"), "digest"))
    return Manifest(leaves, levels, tops, top, root.select("digest", "height"))


def _ways(requests: DataFrame, levels: int) -> list[DataFrame]:
    """For each level the nodes that requests (tree, height, at, row) pass, with the digits they go on by; the rows stay at the leaves."""
    ways, below = [], requests
    for level in range(1, levels + 1):
        digit = F.col("at").bitwiseAND(F.lit((1 << FAN_BITS) - 1)).cast("int").alias("digit")
        way = written(below.where(F.col("height") >= level).groupBy("tree", "height", F.shiftright("at", FAN_BITS).alias("up")).agg(
            F.collect_list(F.struct(digit, *(["row"] if level == 1 else []))).alias("digits")).withColumnRenamed("up", "at"))
        ways.append(way)
        below = way
    return ways


def _opened(front: DataFrame, way: DataFrame, records: DataFrame) -> DataFrame:
    """One level down: each requested child with its digest, its row if it is a leaf, and its parent's path and the children not selected."""
    known = records.select("digest", "children").dropDuplicates(["digest"])
    held = [c for c in front.columns if c not in ("digest", "at", "path")]
    at = front.join(way.select("tree", "at", "digits"), ["tree", "at"]).join(known, "digest")
    down = at.select(*held, "at", "path", "children", F.explode("digits").alias("d")).withColumn("digit", F.col("d.digit"))
    others = F.filter("children", lambda _, i: i != F.col("digit"))
    row = ["d.row"] if "row" in way.schema["digits"].dataType.elementType.names else []
    return down.select(
        *held, (F.shiftleft("at", FAN_BITS) + F.col("digit")).alias("at"), F.get("children", F.col("digit")).alias("digest"),
        F.concat("path", F.array(F.struct(F.col("digit").alias("digit"), others.alias("others")))).alias("path"), *row)


def _descended(front: DataFrame, levels: list[DataFrame], requests: DataFrame) -> DataFrame:
    """From the roots of trees down to the requested leaves with their rows; a tree joins at its own height."""
    ways = _ways(requests, len(levels))
    alone = front.where("height = 0").join(requests.where("height = 0").select("tree", "at", "row"), ["tree", "at"])
    if not levels:
        return alone
    now = front.where(F.col("height") == len(levels))
    for level in range(len(levels), 0, -1):
        now = _opened(now, ways[level - 1], levels[level - 1])
        now = now.unionByName(alone.select(*now.columns) if level == 1 else front.where(F.col("height") == level - 1))
    return now


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """tree, at, subroot, root, path (segments from the root down) and row of each requested leaf.

    `requests` has tree, height and at, as the leaves of the manifest have; by default every leaf is asked
    for. What else it has comes back as `row`, and is brought to the leaf's parent before the paths part:
    a path, which is longer than its row, is never sent anywhere once it is a leaf's own.
    """
    asked = manifest.leaves if requests is None else requests
    names = [c for c in asked.columns if c not in ("tree", "height", "at")]
    row = F.struct(*names) if names else F.lit(None).cast("int")
    asked = asked.select("tree", "height", "at", row.alias("row"))
    trees = asked.select("tree").distinct().join(manifest.subroots, "tree")
    tops = written(trees.select(F.lit("").alias("tree"), F.col("top_height").alias("height"), F.col("top_at").alias("at"),
                                F.struct(F.col("tree").alias("name"), "height", "digest").alias("row")))
    start = manifest.root.select(
        F.lit("").alias("tree"), "height", F.lit(0).cast("long").alias("at"), "digest", F.array().cast(f"array<{SEGMENT}>").alias("path"))
    front = written(_descended(start, manifest.top, tops).select(
        F.col("row.name").alias("tree"), F.col("row.height").alias("height"), F.lit(0).cast("long").alias("at"), "digest", "path",
        F.col("row.digest").alias("subroot")))
    root = manifest.root.first()
    return _descended(front, manifest.levels, asked).select(
        "tree", "at", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path", "row")


def proof_digest(path: Column) -> Column:
    """Of all siblings, from the leaf's level up to the root's."""
    return joined(F.flatten(F.transform(F.reverse(path), lambda s: s["others"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node: Column, step: Column) -> Column:
        around = F.concat(F.slice(step["others"], F.lit(1), step["digit"]), F.array(node), F.slice(step["others"], step["digit"] + 1, F.lit(1 << FAN_BITS)))
        return joined(around)
    return F.aggregate(F.reverse(path), leaf, up)


def verified(docs: DataFrame, tampered: Column | None = None, text: str = "text") -> DataFrame:
    """Every row's leaf, roots and proof, and whether its row, tampered with where the column says, still proves.

    Tampering lower-cases A-Z of the text; a null text stays null, and a text without A-Z stays as it
    is and so still proves. A null `tampered` means no. An empty dataset gives no row.
    """
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    lowered = digest_of(*[F.translate(F.col(c), _UPPER, _LOWER) if c == text else F.col(c) for c in FIELDS])
    made = build(docs, extra={"shown": F.when(changed, lowered)})
    again = proofs(made).select(
        "row.doc_id", "row.leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("row.shown", "row.leaf"), F.col("path")).alias("folded_root"))
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))
