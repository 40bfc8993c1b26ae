"""One text document per company row, with id and metadata.

The template is a list of (label, field) lines (``constants.DOC_LINES``), so
another source layout only needs another list. Lines after the first are
indented. Strings print as-is, numbers
as Python prints floats, nulls as ``nan``. A narrow projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DOC_FIRST_LINE, DOC_INDENT, DOC_LINE_ENDS, DOC_LINES
from ..functions.numfmt import float_text, text_or_nan


def _field(df: DataFrame, name: str):
    if name not in df.columns:
        return text_or_nan(F.lit(None))
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return float_text(F.col(name))
    return text_or_nan(F.col(name))


def render_documents(companies: DataFrame, lines=DOC_LINES, first_line=DOC_FIRST_LINE,
                     indent: str = DOC_INDENT, line_ends=DOC_LINE_ENDS) -> DataFrame:
    """(doc_id, row_id, company_code, industry, content)."""
    p0, f0, p1, f1, p2 = first_line
    head = F.concat(F.lit(p0), _field(companies, f0), F.lit(p1), _field(companies, f1),
                    F.lit(p2))
    body = [F.concat(F.lit(indent + label), _field(companies, field),
                     F.lit(line_ends.get(field, ""))) for label, field in lines]
    return companies.select(
        F.col("row_id").cast("string").alias("doc_id"),
        "row_id",
        F.col("company_code"),
        F.col("industry"),
        F.trim(F.concat_ws("\n", head, *body)).alias("content"),
    )
