"""Panel text: fixed decimals, rounded half up on the exact binary value."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed(value: Column, digits: int) -> Column:
    """The value with `digits` decimals; no built-in rounds the exact value half away from zero."""
    unit = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def fixed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: "NaN" if x != x else str(Decimal(x).quantize(unit, ROUND_HALF_UP)), na_action=None)

    return F.when(value.isNotNull(), fixed(value))


def price(value: Column) -> Column:
    """`US$ 1.23`, or `-` for null, 0 and NaN."""
    shown = value.isNotNull() & ~F.isnan(value) & (value != 0)
    return F.when(shown, F.concat(F.lit("US$ "), to_fixed(value, 2))).otherwise("-")
