"""Multi-sheet sources and CSV sinks.

A workbook of sheets becomes one directory per sheet (``sheet=<name>/``),
read back with partition discovery so each sheet is a source partition and
any subset may be missing. CSV sinks write a header, no index, and both
null and '' as an empty field (so both read back as null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SHEET_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("expected_company", T.StringType()),
    T.StructField("gold", T.StringType()),
    T.StructField("pred_k1", T.StringType()),
    T.StructField("pred_k3", T.StringType()),
    T.StructField("pred_k5", T.StringType()),
])

PER_QUERY_SCHEMA = T.StructType([
    T.StructField("rougeL", T.DoubleType()),
    T.StructField("semantic_cosine", T.DoubleType()),
    T.StructField("good_refusal", T.DoubleType()),
    T.StructField("hallucination_rate", T.DoubleType()),
    T.StructField("cohort", T.StringType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("query", T.StringType()),
    T.StructField("expected_company", T.StringType()),
    T.StructField("gold", T.StringType()),
    T.StructField("pred", T.StringType()),
])


def write_sheets(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    """One directory per value of ``sheet`` (created as needed: S8)."""
    df.write.mode("overwrite").partitionBy("sheet").format(fmt).option("header", True).save(root)


def read_sheets(spark: SparkSession, root: str, fmt: str = "parquet",
                schema: T.StructType = SHEET_SCHEMA) -> DataFrame:
    """All sheet directories under ``root`` with a ``sheet`` column."""
    full = T.StructType(list(schema.fields) + [T.StructField("sheet", T.StringType())])
    reader = spark.read.schema(full).format(fmt).option("header", True)
    return reader.load(root).select("sheet", *schema.fieldNames())


SUMMARY_SCHEMA = T.StructType([
    T.StructField("cohort", T.StringType()), T.StructField("k", T.IntegerType()),
    *[PER_QUERY_SCHEMA[m] for m in ("rougeL", "semantic_cosine", "good_refusal",
                                    "hallucination_rate")]])


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """S5 / S6. ``single_file`` only for small summaries (coalesce(1))."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("emptyValue", "")
        .option("nullValue", "").option("escape", '"').csv(path))


def write_summary(metrics: DataFrame, path: str) -> None:
    """The means by cohort and depth as one sorted file (nine rows)."""
    write_csv(metrics.orderBy("cohort", "k").select(*SUMMARY_SCHEMA.fieldNames()), path,
              single_file=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared schema, empty fields → null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
