"""Quantile sketches that merge: counts of values by logarithmic bin, and baselines for spikes made of them.

A bin holds the values of one sign between two powers of gamma = (1 + alpha) / (1 - alpha), so a quantile read from it is within a share alpha of the
exact one, whatever was merged. A sketch is plain rows (its keys, bin, n): parts of days, late ticks and whole years merge by a sum, in any order, and can
be kept as a table. Nulls, NaN and infinite values count for nothing.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candles import KEY

#: Relative error of a quantile.
ALPHA = 0.01
#: Larger than any bin's power, so that bins of positive values are above 0 and those of negative ones below.
_ABOVE = 2**40


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bin_of(value: Column, alpha: float = ALPHA) -> Column:
    """The value's bin, which never falls as values rise: 0 for zero, null for values that don't count."""
    value = value.cast("double")
    size = F.abs(value)
    power = F.ceil(F.ln(F.when((size > 0) & (size < F.lit(math.inf)), size)) / F.lit(math.log(_gamma(alpha)))) + _ABOVE
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, power).when(value < 0, -power)


def value_of(bin_: Column, alpha: float = ALPHA) -> Column:
    """The value that is within a share alpha of all those in the bin."""
    gamma = _gamma(alpha)
    size = F.least(F.pow(F.lit(gamma), (F.abs(bin_) - _ABOVE - 1).cast("double")) * F.lit(2 * gamma / (1 + gamma)), F.lit(sys.float_info.max))
    return F.when(bin_ == 0, 0.0).when(bin_ > 0, size).otherwise(-size)


def sketched(rows: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """A sketch of `value` for each `by`: a row for each bin that holds any. Counts are partial before the shuffle, so a busy key costs its bins alone."""
    return rows.withColumn("bin", bin_of(F.col(value), alpha)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged into one for each `by`."""
    return sketches.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], probability: float, alpha: float = ALPHA) -> DataFrame:
    """For each `by` quantile, its bin as quantile_bin, and n_values, from merged sketches: the value of place floor(probability * (n - 1)) from 0 in their order.

    A window holds one sketch, whose length alpha bounds and not the number of values.
    """
    if not 0 <= probability <= 1:
        raise ValueError("a probability lies between 0 and 1")
    order = Window.partitionBy(*by).orderBy("bin")
    counted = sketches.select(*by, "bin", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("n_values"))
    reached = counted.where(F.col("upto") > F.floor(F.lit(probability) * (F.col("n_values") - 1)))
    found = reached.groupBy(*by, "n_values").agg(F.min("bin").alias("quantile_bin"))
    return found.select(*by, value_of(F.col("quantile_bin"), alpha).alias("quantile"), "quantile_bin", "n_values")


def quantile_spikes(bars: DataFrame, value: str = "volume", days: int = 7, probability: float = 0.95, alpha: float = ALPHA) -> DataFrame:
    """Each bar with its `baseline`, the quantile of `value` over its series' bars of the `days` calendar days before its own, n_values, their number, and `spike`.

    A spike's bin is above the baseline's. So its value is above the exact quantile, and one that isn't a spike is at most gamma times it (for negative
    quantiles, a gamma-th of it). A bar without a time or without bars in those days has no baseline and is no spike, nor is one whose value doesn't count.

    A day's sketch is merged into the `days` after it: sketches are copied, bars are not. No task holds more of a series than a day's bars. The bars are read twice, so stage
    ones that are dear to make.
    """
    dated = bars.withColumn("day_", F.to_date("time"))
    daily = sketched(dated.where("day_ IS NOT NULL"), [*KEY, "day_"], value, alpha)
    later = F.explode(F.sequence(F.date_add("day_", 1), F.date_add("day_", days)))
    base = quantiles(merged(daily.select(*KEY, later.alias("day_"), "bin", "n"), [*KEY, "day_"]), [*KEY, "day_"], probability, alpha)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEY, "day_")]
    met = dated.alias("d").join(base.alias("b"), same, "left")
    spike = F.coalesce(bin_of(F.col(f"d.{value}"), alpha) > F.col("b.quantile_bin"), F.lit(False))
    return met.select(*[F.col(f"d.{c}") for c in bars.columns], F.col("b.quantile").alias("baseline"), F.col("b.n_values").alias("n_values"), spike.alias("spike"))
