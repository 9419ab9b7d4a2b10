"""Cells of delimited files as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_value(cell: Column) -> Column:
    """Blank and ``nan`` (any case) are null; anything else must be a number, or the job fails.

    Java's type suffixes (``1.0d``) are no numbers here.
    """
    text = F.btrim(cell, F.lit(" \t\n\r\x0b\x0c"))
    missing = cell.isNull() | F.lower(text).isin("", "nan")
    suffixed = F.lower(text).rlike("[0-9.][df]$")
    bad = F.raise_error(F.concat(F.lit("not a number: "), cell)).cast("double")
    return F.when(missing, F.lit(None).cast("double")).when(suffixed, bad).otherwise(text.cast("double"))
