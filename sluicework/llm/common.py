"""What several operators of this subpackage share: scratch tables, row keys, text columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose executors are threads of the driver, may do without that setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _local_folder()
    return f"{named.rstrip('/')}/llm-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def written(df: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """Cut lineage: the rows as a Parquet table in the shared folder, so that no executor has to be asked again."""
    path = folder or scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> SparkSession:
    """Python workers look for this package where the driver has it, as on a shared installation."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}{os.pathsep}{known}" if known else root
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
