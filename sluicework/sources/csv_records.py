"""CSV whose quoted values hold line breaks, read in splits.

Whether a line starts inside a quoted value depends on all quotes before it. One narrow scan counts the
quotes of each split; their running parity tells how each split starts, and from there its own lines
decide. A record that goes on in the next split is put together from its pieces, of which a split has two at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sluicework import fixed_values as fv
from sluicework.functions.rules import ref
from sluicework.session import durable, fresh_folder

RECORD, TAIL, HEAD, HEADER = 0, 1, 2, 3
_PIECES = "file string, start long, kind int, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they start in; only a line feed ends a line here."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def inside_quotes(spark: SparkSession, path: str) -> tuple[bool, set[tuple[str, int]]]:
    """Whether any line leaves a quote open, and the splits that start inside a quoted value.

    Splits are grouped as they are read, so a task passes on one row for each of them.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = _lines(spark, path).groupBy("file", "start").agg(
        F.sum(quotes).alias("quotes"), F.bool_or(quotes % 2 == 1).alias("open"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    marked = splits.select("file", "start", "open", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    found = marked.where("open OR inside").collect()  # at most one row for each split of the files
    return any(r["open"] for r in found), {(r["file"], r["start"]) for r in found if r["inside"]}


def _cut(inside: set[tuple[str, int]]):
    """Lines to records, and to the pieces of records that cross the border of a split."""

    class Split:
        def __init__(self, key: tuple[str, int]):
            self.key, self.odd = key, int(key in inside)
            self.kind = HEAD if self.odd else HEADER if key[1] == 0 else RECORD
            self.held: list[str] = []

        def add(self, lines: pa.Array) -> tuple[list[int], list[str]]:
            after = (self.odd + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) & 1
            texts, kinds, out = lines.to_pylist(), [], []
            at = 0
            for end in np.flatnonzero(after == 0).tolist():  # a record ends wherever no quote is open
                self.held += texts[at:end + 1]
                out.append("\n".join(self.held))
                kinds.append(self.kind)
                self.held, self.kind, at = [], RECORD, end + 1
            self.held += texts[at:]
            self.odd = int(after[-1]) if len(after) else self.odd
            return kinds, out

        def rest(self) -> tuple[list[int], list[str]]:
            return ([TAIL if self.kind != HEAD else HEAD], ["\n".join(self.held)]) if self.held else ([], [])

    def made(split: Split, kinds: list[int], texts: list[str]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([split.key[0]] * n, pa.string()), pa.array([split.key[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())],
            ["file", "start", "kind", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            start, file = batch.column(2).to_numpy(), batch.column(1)
            new = np.flatnonzero((start[1:] != start[:-1]) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip(np.r_[0, new].tolist(), np.r_[new, len(start)].tolist()):
                key = (file[a].as_py(), int(start[a]))
                if split is None or split.key != key:
                    if split is not None:
                        yield made(split, *split.rest())
                    split = Split(key)
                yield made(split, *split.add(batch.column(0).slice(a, b - a)))
        if split is not None:
            yield made(split, *split.rest())
    return run


def records(spark: SparkSession, path: str, inside: set[tuple[str, int]]) -> DataFrame:
    """``text`` of every record but the headers, whole however many lines and splits it covers."""
    pieces = _lines(spark, path).mapInArrow(_cut(inside), _PIECES)
    whole = pieces.where(F.col("kind") == RECORD).select("text")
    if not inside:
        return pieces.where(F.col("kind").isin(RECORD, TAIL)).select("text")  # a quote that never closes ends with its file
    parts = durable(pieces.where(F.col("kind").isin(TAIL, HEAD)), fresh_folder(spark))
    nth = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", F.desc("kind")))
    joined = parts.withColumn("nth", nth).groupBy("file", "nth").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("start", (-F.col("kind")).alias("k"), "text"))), lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("text"))


def parsed(texts: DataFrame, names: list[str]) -> DataFrame:
    """Records to text columns and ``extra``, the first value beyond the header; blank records are none."""
    kinds = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    body = F.regexp_replace("text", "\r$", "")
    row = F.from_csv(body, kinds.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "maxCharsPerColumn": "-1"})
    rows = texts.where(F.trim(body) != "").select(row.alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.col(f"r.c{len(names)}").alias("extra"))


#: Types a column of texts may have, the narrowest first, and the form a text must have beside its cast.
TYPES = (("int", None), ("bigint", None), ("double", None), ("date", r"^\d{4}-\d{2}-\d{2}$"), ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d"),
         ("boolean", r"(?i)^(true|false)$"))


def _fits(value: Column, kind: str, form: str | None) -> Column:
    held = value.try_cast(kind).isNotNull()
    return held & value.rlike(form) if form else held


def typed(rows: DataFrame, infer: bool) -> tuple[DataFrame, str | None]:
    """The rows with inferred types, and the first value beyond the header if there is one: both from one pass.

    A column has the narrowest type that all of its values have; null tokens fit every type.
    """
    names = [c for c in rows.columns if c != "extra"]
    values = {c: F.when(~ref(c).isin(fv.NULL_TOKENS), ref(c)) for c in names}
    misses = [F.count_if(values[c].isNotNull() & ~_fits(values[c], kind, form)).alias(f"{i}_{kind}")
              for i, c in enumerate(names) for kind, form in (TYPES if infer else ())]
    filled = [F.count(values[c]).alias(f"{i}_filled") for i, c in enumerate(names)]
    found = rows.agg(F.any_value("extra", F.lit(True)).alias("extra"), *filled, *misses).first()
    casts = {}
    for i, c in enumerate(names):
        kind = next((k for k, _ in TYPES if infer and found[f"{i}_filled"] and not found[f"{i}_{k}"]), "string")
        casts[c] = values[c] if kind == "string" else values[c].try_cast(kind)
    return rows.select(*[v.alias(c) for c, v in casts.items()]), found["extra"]
