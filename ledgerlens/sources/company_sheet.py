"""The company sheet under its source headings → canonical columns.

The sheet arrives as CSV with a header row (a spreadsheet export). Headings
are long sentences containing dots, colons and commas, so they are renamed
once at ingest (``COMPANY_SHEET_HEADINGS``) and never referenced again.

Types are declared, not inferred: the header is read without an inference
pass over the data, the headings present are cast to the declared type and
renamed; headings that are absent are skipped (P1). Column pruning and
filters above the scan still reach the reader. Texts may hold line ends, quotes
and commas; a file with line ends in texts cannot be split, so bulk data belongs
in Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COMPANY_SHEET_HEADINGS

TEXT_COLUMNS = {"company_name", "company_code", "industry", "description",
                "additional_info", "website", "asx_page"}


def _type(canonical: str) -> str:
    return "string" if canonical in TEXT_COLUMNS else "double"


def _ref(name: str):
    return F.col("`" + name + "`")


def write_company_sheet(companies: DataFrame, path: str) -> None:
    """Export canonical company columns under the source headings. Outer
    whitespace is kept (two headings end in a space; the writer would trim)."""
    cols = [_ref(c).alias(h) for c, h in COMPANY_SHEET_HEADINGS if c in companies.columns]
    (companies.select(*cols).write.mode("overwrite")
     .option("header", True).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .options(quote='"', escape='"').csv(path))


def read_company_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Scan the sheet and return canonical, typed columns in sheet order."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .options(quote='"', escape='"', multiLine=True).csv(path))
    present = set(raw.columns)
    return raw.select(*[_ref(h).cast(_type(c)).alias(c)
                        for c, h in COMPANY_SHEET_HEADINGS if h in present])
