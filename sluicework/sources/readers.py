"""Reading a batch from a file, a table or a query."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluicework import fixed_values as fv
from sluicework.contracts import ColumnSpec, Contract
from sluicework.functions.rules import ref
from sluicework.operators.profile import Batch, by_batch
from sluicework.session import error_text
from sluicework.sources import csv_records

FILE_FORMATS = ("csv", "parquet", "json")
COLUMNAR = ("parquet", "table", "query")


class SourceError(Exception):
    """A batch that could not be read, with the kind of issue it is reported as."""

    def __init__(self, issue_type: str, message: str):
        super().__init__(message)
        self.issue_type = issue_type
        self.message = message

    def row(self, dataset: str) -> tuple:
        return (dataset, "fail", None, self.issue_type, self.message, None, None)


def format_of(path: str) -> str:
    """File format by suffix; anything unknown is taken for CSV."""
    return next((f for f in ("parquet", "json") if path.endswith(f".{f}")), "csv")


def fold_null_tokens(df: DataFrame) -> DataFrame:
    """Texts that stand for null become null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~ref(c).isin(fv.NULL_TOKENS), ref(c)) for c in texts}) if texts else df


def _csv(spark: SparkSession, multi_line: bool):
    # a quote inside a quoted value is doubled
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header. ``infer=False`` keeps text and saves the inference pass over the data.

    A row with more values than the header raises an error; a shorter one is filled with nulls.
    By default a narrow scan finds out whether quoted values hold line breaks; a file that has such
    values is read record by record, in splits. ``multi_line=True`` leaves it to Spark's own reader, which can't split it.
    """
    if multi_line is None:
        multi_line, inside = csv_records.inside_quotes(spark, path)
        if multi_line:
            names = _csv(spark, False).csv(path).columns
            rows, extra = csv_records.typed(csv_records.parsed(csv_records.records(spark, path, inside), names), infer)
            if extra is not None:
                raise _too_wide(names, extra)
            return rows
    names = _csv(spark, multi_line).csv(path).columns
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    extra = F.col(f"c{len(names)}")
    first = _csv(spark, multi_line).schema(wide).csv(path).where(extra.isNotNull()).select(extra).first()
    if first is not None:
        raise _too_wide(names, first[0])
    return fold_null_tokens(_csv(spark, multi_line).option("inferSchema", infer).csv(path))


def _too_wide(names: list[str], extra: str) -> SourceError:
    return SourceError("load_error", fv.MSG["load_error"] % f"a row has more than {len(names)} values, the first beyond them is {extra!r}")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON: one object a line, or files that hold one value each over several lines, such as an array. Other content is an error."""
    df = spark.read.json(path)
    if "_corrupt_record" not in df.columns:
        return df
    whole = spark.read.text(path, wholetext=True)
    if whole.where(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNull()).isEmpty():  # one value and nothing after it
        return spark.read.option("multiLine", True).json(path)
    raise SourceError("load_error", fv.MSG["load_error"] % "neither an object a line nor one value a file")


def load(spark: SparkSession, source: str, source_type: str = "csv") -> DataFrame:
    """One entry for csv, parquet, json, table and query sources."""
    if source_type not in (*FILE_FORMATS, "table", "query"):
        raise SourceError("load_error", fv.MSG["unsupported_format"] % source_type)
    try:
        if source_type == "csv":
            return read_csv(spark, source)
        if source_type == "json":
            return read_json(spark, source)
        if source_type == "parquet":
            return spark.read.parquet(source)
        return spark.table(source) if source_type == "table" else spark.sql(source)
    except SourceError:
        raise
    except AnalysisException as exc:
        text = error_text(exc)
        if source_type == "query":
            raise SourceError("query_error", fv.MSG["query_error"] % text) from exc
        if "PATH_NOT_FOUND" in text:
            raise SourceError("file_not_found", fv.MSG["file_not_found"] % source) from exc
        raise SourceError("load_error", fv.MSG["load_error"] % text) from exc
    except Exception as exc:
        raise SourceError("load_error", fv.MSG["load_error"] % error_text(exc)) from exc


SPARK_TYPES = {
    "integer": "bigint", "smallint": "smallint", "tinyint": "tinyint", "hugeint": "decimal(38,0)",
    "float": "float", "double": "double", "decimal": "decimal(38,10)", "varchar": "string",
    "boolean": "boolean", "date": "date", "timestamp": "timestamp", "time": "string",
    "interval": "string", "blob": "binary", "json": "string",
}


def spark_type(spec: ColumnSpec) -> str:
    """Spark type a text column of this declaration is cast to."""
    if spec.declared in ("decimal", "numeric") and "(" in spec.data_type:
        return "decimal" + spec.data_type[spec.data_type.index("("):]
    family = next((f for f, names in fv.TYPE_FAMILIES.items() if spec.declared in names), "varchar")
    return SPARK_TYPES.get(family, "string")


def cast_to_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared columns held as text become typed; a text that does not fit becomes null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    casts = {
        c.name: ref(c.name).try_cast(spark_type(c)) for c in contract.columns
        if isinstance(kinds.get(c.name), T.StringType) and spark_type(c) != "string"
    }
    return df.withColumns(casts) if casts else df


def coercion_failures(df: DataFrame, contract: Contract, batch: Batch = None) -> DataFrame:
    """Texts per batch and column that do not fit the declared type, in the same single pass style as profiling.

    With this a CSV needs no inference pass: a column is of the declared type when nothing fails.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    held = [c for c in contract.columns if isinstance(kinds.get(c.name), T.StringType)]
    counted = [
        F.struct(
            F.lit(c.name).alias("column_name"), F.lit(c.declared).alias("declared_type"),
            F.count(ref(c.name)).alias("filled"),
            F.count_if(ref(c.name).isNotNull() & ref(c.name).try_cast(spark_type(c)).isNull()).alias("failures"),
        )
        for c in held
    ]
    return by_batch(df, batch, [F.array(*counted).alias("c")]).select("batch", F.inline("c"))
