"""Percent text for report columns.

Python's ``f"{x:.2%}"`` rounds the exact binary value of ``x * 100``; Java's
``%.2f`` (``format_string``) rounds its shortest decimal form half-up, so the
two disagree on values such as 5.125 or 0.0525 * 100. The report text is
defined by Python's formatting, so this one formatter runs in Python,
vectorised through Arrow, on the run-summary table (one row per run).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _percent_udf(digits: int):
    @F.pandas_udf("string")
    def fmt(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or pd.isna(v) else f"{v:.{digits}%}")
    return fmt


_UDFS: dict[int, object] = {}


def percent(col, digits: int = 2) -> Column:
    if digits not in _UDFS:
        _UDFS[digits] = _percent_udf(digits)
    c = F.col(col) if isinstance(col, str) else col
    return _UDFS[digits](c)
