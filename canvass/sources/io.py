"""Sources and sinks for the survey table.

The reader always applies the declared schema (no inference). A missing path
surfaces Spark's ``AnalysisException`` (``PATH_NOT_FOUND``) with the path.
Written intermediate tables go to the shared checkpoint folder, never to a
machine-local temp dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.session import scratch_path
from canvass.sources.schema import RESPONSES_SCHEMA

# Texts that a survey file may hold for a missing value.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: Reason of a record that has not as many fields as the header.
MALFORMED = "record"
_RECORD = "_canvass_record"


def header_names(spark: SparkSession, path: str) -> list[str]:
    """The column names in a CSV file's header, in the file's order."""
    return spark.read.option("header", True).csv(path).columns


def _texts(spark: SparkSession, path: str, schema: T.StructType, header: bool, mode: str) -> tuple[DataFrame, list[str]]:
    """The rows of a CSV file (or folder of files with one header) as texts, and all
    names of the file. Columns are bound by the header's names, in whatever order
    they stand; a file whose header differs from the first one's stops the load."""
    names = header_names(spark, path) if header else schema.names
    missing = [c for c in schema.names if c not in names]
    if missing:
        raise ValueError(f"{path}: the header lacks {missing}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    reader = spark.read.option("header", header).option("mode", mode).option("enforceSchema", not header).option("columnPruning", False)
    if mode == "PERMISSIVE":
        text = text.add(_RECORD, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", _RECORD)
    return reader.schema(text).csv(path), names


def _value(field: T.StructField):
    """The text of a field, null if it stands for a missing value."""
    return F.when(~F.trim(F.col(field.name)).isin(MISSING_TOKENS), F.col(field.name))


def _tried(field: T.StructField):
    """The field's value, null if its text isn't one; whole numbers may have a decimal point (3.0)."""
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        exact = _value(field).try_cast(field.dataType)
        number = _value(field).try_cast("decimal(38,6)")
        return F.coalesce(exact, F.when(number == F.floor(number), number.try_cast(field.dataType)))
    return _value(field).try_cast(field.dataType)


def _no_nan(rows: DataFrame, schema: T.StructType) -> DataFrame:
    floating = [f for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in floating})


def read_responses(spark: SparkSession, path: str | list[str], fmt: str = "parquet", header: bool = True,
                   schema=None) -> DataFrame:
    """Read a survey file (CSV, or parquet) with the declared schema.

    ``schema`` overrides the declared one, e.g. for files whose respondent ids
    are text. CSV columns are found by the header's names: their order is free,
    further columns are left out, a missing one is a ``ValueError``; without a
    header they are taken in the schema's order. Files whose headers differ are given as
    a list of paths, each of which is bound by its own header. Missing values are null whatever their form:
    the empty field and ``MISSING_TOKENS`` in a CSV file, NaN in any floating column. Any other text
    that its column's type can't hold, and any record with too few or too many
    fields, stops the load; :func:`read_quarantined` sets such rows apart instead.
    """
    schema = schema or RESPONSES_SCHEMA
    if fmt != "csv":
        return _no_nan(spark.read.schema(schema).format(fmt).load(path), schema)
    rows = None
    for one in [path] if isinstance(path, str) else path:
        texts, _ = _texts(spark, one, schema, header, "FAILFAST")
        typed = texts.select(*[F.coalesce(_tried(f), _value(f).cast(f.dataType)).alias(f.name) for f in schema])
        rows = typed if rows is None else rows.unionByName(typed)
    return _no_nan(rows, schema)


def read_quarantined(spark: SparkSession, path: str | list[str], header: bool = True, schema=None) -> tuple[DataFrame, DataFrame]:
    """S1 for files with bad rows: (good, bad) of CSV files.

    good has the declared schema. bad has, for each row that can't be read,
    source_file, record (its text) and reasons: ``record`` if the number of
    fields is wrong, else the names of the columns whose text is no value of their type."""
    schema = schema or RESPONSES_SCHEMA
    good = bad = None
    for one in [path] if isinstance(path, str) else path:
        texts, names = _texts(spark, one, schema, header, "PERMISSIVE")
        wrong = F.filter(F.array(*[F.when(_value(f).isNotNull() & _tried(f).isNull(), F.lit(f.name)) for f in schema]), lambda c: c.isNotNull())
        reasons = F.when(F.col(_RECORD).isNotNull(), F.array(F.lit(MALFORMED))).otherwise(wrong)
        record = F.coalesce(F.col(_RECORD), F.to_csv(F.struct(*[F.col(c) for c in names])))
        read = texts.select("*", F.col("_metadata.file_path").alias("_canvass_file"), reasons.alias("_canvass_reasons"))
        fine = read.where(F.size("_canvass_reasons") == 0).select(*[_tried(f).alias(f.name) for f in schema])
        apart = read.where(F.size("_canvass_reasons") > 0).select(
            F.col("_canvass_file").alias("source_file"), record.alias("record"), F.col("_canvass_reasons").alias("reasons"))
        good, bad = (fine, apart) if good is None else (good.unionByName(fine), bad.unionByName(apart))
    return _no_nan(good, schema), bad


def write_csv(df: DataFrame, path: str | None = None) -> str:
    """Write ``df`` as CSV with a header into ``path`` (default: a fresh shared scratch path)."""
    path = path or scratch_path(df.sparkSession, "csv")
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str | None = None, name: str = "table") -> str:
    """Materialise ``df`` as parquet in the shared folder; returns the path."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path

