"""Token ids of documents in files of compressed, checksummed blocks, in ascending order of documents.

A file is a Parquet file of blocks: (part, seq, offset, docs, ids). `part` counts the files in order of
document, `seq` the blocks of a file, `offset` the ids of the file before the block. `docs` lists the
block's documents and the ids of each; `ids` is what `context_coder.pack` makes of all of them. A
document lies in one block, and blocks don't depend on each other: any of them can be read by itself.

Texts are sorted over the cluster by range, so each task writes one file in one pass. A document's
place in the whole comes from the totals of the files, one small row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe_chunks import codec
from .common import scratch, text_of
from .context_coder import pack, unpack
from .language_id import parts

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 19
_BLOCK = "part int, seq int, offset long, n long, docs binary, ids binary"
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])


def _blocks(path: str, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            nonlocal seq, offset, n
            made = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([offset]), pa.array([n]),
                pa.array([zlib.compress(np.array(docs, _DOC).tobytes(), 1)]), pa.array([pack(np.concatenate(held))])],
                ["part", "seq", "offset", "n", "docs", "ids"])
            seq, offset, n = seq + 1, offset + n, 0
            docs.clear(), held.clear()
            return made

        c, last = codec(path, only_library=True), np.array([end], "<u4")
        for batch in batches:
            for a, b in parts(batch.column(1)):
                piece = batch.slice(a, b - a)
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    ids = np.concatenate([np.frombuffer(c.encode(text), "<u4"), last])
                    docs.append((key or 0, key is None, len(ids)))
                    held.append(ids)
                    n += len(ids)
                    if n >= block_ids:
                        yield block()
        if docs:
            yield block()
    return run


def write(docs: DataFrame, folder: str, path: str, end: int = 0, doc_id: str = "doc_id", text: str = "text",
          block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every row of `docs`, each followed by `end`, below `folder`, which must be new.

    Rows with one id stand next to each other, ordered by the hash of their text, so that not even an
    id of very many rows has to fit in one file. Null ids come first, a null text is empty.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _blocks(path, end, block_ids), _BLOCK).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["ids"])
            docs = np.frombuffer(zlib.decompress(row["docs"]), _DOC)
            stops = np.cumsum(docs["n"].astype(np.int64))
            raw, n = memoryview(ids.astype("<u4").tobytes()), docs["n"].astype(np.int64)
            sums = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(stops.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(docs["id"].astype(np.int64), mask=docs["null"] > 0),
                pa.array(row["offset"] + stops - n), pa.array(n), pa.array(sums, pa.int64())],
                ["part", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids: array of long) of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, docs = unpack(row["ids"]).astype(np.int64), np.frombuffer(zlib.decompress(row["docs"]), _DOC)
                edges = np.r_[0, np.cumsum(docs["n"].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs["id"].astype(np.int64), mask=docs["null"] > 0),
                    pa.LargeListArray.from_arrays(pa.array(edges), pa.array(ids)).cast(pa.list_(pa.int64()))], ["doc_id", "ids"])
    return spark.read.schema(_BLOCK).parquet(folder).select("docs", "ids").mapInArrow(run, "doc_id long, ids array<long>")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document lies, read from the blocks: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it. A damaged block raises an error.
    """
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    # one row a file: as few as the tasks that wrote them
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    docs = blocks.select("part", "offset", "docs", "ids").mapInArrow(
        _documents, "part int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, path: str, end: int = 0, doc_id: str = "doc_id", text: str = "text",
                     folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files of `docs` and return their index as read back.

    A null text is one `end`; repeated rows and ids are documents of their own; an empty table has an
    empty index. Columns other than the two named may have any name.
    """
    folder = folder or scratch(docs.sparkSession)
    write(docs, folder, path, end, doc_id, text, block_ids)
    return index(docs.sparkSession, folder)
