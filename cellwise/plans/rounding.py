"""Rounded results, so that engines can be compared by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: Sums of counts, which are whole numbers already: raised by a trillionth, those from half a million on would get a last digit.
WHOLE = ("Count", "product margin", "event margin", "n11")


def _round(x: Column, digits: int) -> Column:
    """Half away from zero; by arithmetic where it is exact enough, which takes a fraction of the time of decimals."""
    scale = float(10**digits)
    whole = F.when(x >= 0, F.floor(x * scale + 0.5)).otherwise(F.ceil(x * scale - 0.5))
    return F.when(F.abs(x) < 1e6, whole / scale).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every double but the counts rounded; NaN and infinite values are null, and there is no negative zero."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind == "double":
            # Exact ties are raised a little, so that they round alike everywhere.
            value = x if c in WHOLE else _round(x * 1.000000000001, digits) + 0.0
            if c == "FNR":  # its last denominator is 1e-7
                value = F.when(x >= 1000, F.round(x, -3)).otherwise(value)
            x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), value)
        out.append(x.alias(c))
    return df.select(*out)
