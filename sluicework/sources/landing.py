"""Files waiting at the gate: listing, age and whether they changed since the last scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluicework import fixed_values as fv
from sluicework.functions.rules import moment
from sluicework.session import small_frame

FILE_SCHEMA = "path string, modified timestamp, mtime double, size bigint"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Path, modification time and size of the files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    try:
        found = reader.load(folder)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return small_frame(spark, [], FILE_SCHEMA)
    return found.select(
        "path", F.col("modificationTime").alias("modified"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"),
    )


def timeliness(files: DataFrame, as_of: datetime | Column, max_age_hours: float = fv.FRESHNESS_HOURS) -> DataFrame:
    """Age of each file; it is stale once it is as old as allowed."""
    seconds = F.unix_micros(moment(as_of)) / 1e6 - F.unix_micros(F.col("modified").cast("timestamp")) / 1e6
    age = seconds / 3600
    stale = age >= max_age_hours
    return files.withColumns({
        "age_hours": age,
        "stale": stale,
        "error": F.when(stale, F.format_string(fv.MSG["stale"], age, F.lit(f"{max_age_hours:g}"))),
    })


def check_timeliness(spark: SparkSession, path: str, as_of: datetime,
                     max_age_hours: float = fv.FRESHNESS_HOURS) -> tuple[bool, str | None]:
    """Whether one file is fresh, with the error otherwise; a missing file is not."""
    row = timeliness(list_files(spark, path, "*"), as_of, max_age_hours).orderBy(F.col("age_hours").desc()).first()
    if row is None:
        return False, fv.MSG["timeliness_missing"] % path
    return not row["stale"], row["error"]


def unchanged(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Mark files whose time equals the one the registry holds for their dataset."""
    seen = registry.select(F.col("dataset_name").alias("dataset"), "last_file_mtime")
    same = F.abs(F.col("mtime") - F.col("last_file_mtime")) < fv.UNCHANGED_TOLERANCE_SECONDS
    return files.join(seen, "dataset", "left").withColumn("unchanged", F.coalesce(same, F.lit(False)))
