"""Session helpers: a local session for tests, shared folders, error texts."""

from __future__ import annotations

import os
import uuid
from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "sluicework") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables on many cores
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLUICEWORK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return named.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one; expiring it is left to the shared folder's owner."""
    return f"{shared_folder(spark)}/sluicework/{uuid.uuid4().hex}"


def durable(df: DataFrame, folder: str) -> DataFrame:
    """Cut lineage with a table below ``folder``, which driver and executors share.

    Written once and read back column by column, where a checkpoint would compute the
    last stage twice. It outlives any executor.
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def move_folders(spark: SparkSession, source: str, target: str) -> None:
    """Move the folders in ``source`` into ``target``, each in place of one of its name; done again, it goes on with what is left.

    Only names change: no row is read, and there are as many moves as folders.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    here, there = path(source), path(target)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(here):
        return
    files.mkdirs(there)
    for found in files.listStatus(here):
        if found.isDirectory():
            place = path(there, found.getPath().getName())
            files.delete(place, True)
            files.rename(found.getPath(), place)


def _files_of(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    path, files = _files_of(spark, folder)
    return [found.getPath().getName() for found in files.listStatus(path)] if files.exists(path) else []


def move_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder to a name that nothing has yet."""
    (here, files), (there, _) = _files_of(spark, source), _files_of(spark, target)
    if files.exists(there) or not files.rename(here, there):
        raise FileExistsError(target)


def read_text(spark: SparkSession, file: str) -> str:
    """A small file as text."""
    path, files = _files_of(spark, file)
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, file: str, text: str) -> None:
    path, files = _files_of(spark, file)
    stream = files.create(path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def error_text(exc: BaseException) -> str:
    """The whole text of an error, or its kind if it has none."""
    return str(exc) or type(exc).__name__


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a local relation: planned without a scan or Python workers."""
    kinds = T.DataType.fromDDL(schema)
    columns = to_arrow_schema(kinds)
    arrays = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=columns), schema=kinds)
