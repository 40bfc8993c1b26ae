"""Number → text exactly as Python prints a float (``repr``): shortest
round-trip digits, fixed notation for 1e-4 ≤ |x| < 1e16, else ``1e+16``
style; null → ``nan`` (the missing-value marker of the source sheets).

The JVM's ``Double.toString`` switches to exponent form at 1e7 and, on
JDK < 19, is not always shortest, so this one conversion runs as an
Arrow-batched pandas UDF (one vectorised call per batch, no per-row JVM
round trip). It is only used when rendering documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NULL_TEXT


@F.pandas_udf(T.StringType())
def _py_float_text(s: pd.Series) -> pd.Series:
    return pd.Series([NULL_TEXT if v is None or v != v else repr(float(v))
                      for v in s.astype("object")], dtype="object")


def float_text(c: Column) -> Column:
    return _py_float_text(c.cast("double"))


def text_or_nan(c: Column) -> Column:
    """Strings: the value, null → 'nan'."""
    return F.coalesce(c.cast("string"), F.lit(NULL_TEXT))
