"""As-of joins: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MICROS = 1_000_000


def _unused(taken: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, take: dict[str, str], order: str | None = None, bucket_seconds: int = 86_400, within_seconds: float | None = None) -> DataFrame:
    """All rows and columns of `left`, with those of `right` in `take` (right's name: name in the result) from the last row of the same `by` at or before `at`.

    Of right rows of one time that with the largest `order` counts, then that of the larger values. Nulls are a group of `by`; a row without a time, or
    with no right row at or before it, within `within_seconds` if given, gets nulls.

    Both tables' rows meet in buckets of time, so a long series fills many tasks; the last right row of each bucket is carried to the
    buckets after it, where rows before the first right row of their own take it. Only a row for each series and bucket is ordered by series.
    """
    names = [*left.columns, *take.values()]
    side, place, held, bucket, carried, key = (_unused(names, n) for n in ("side", "place", "held", "bucket", "carried", "order_"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    values = F.struct(F.col(right_at).alias("at"), (F.col(order) if order else F.lit(0)).alias("order"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(take)])
    known = right.where(F.col(right_at).isNotNull()).select(*by, micros(right_at).alias(place), F.lit(0).alias(side), values.alias(held), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias(key))
    asked = left.select(*by, micros(at).alias(place), F.lit(1).alias(side), F.lit(None).cast(known.schema[held].dataType).alias(held), F.struct(*left.columns).alias(key))
    both = known.unionByName(asked).withColumn(bucket, F.floor(F.col(place) / (bucket_seconds * _MICROS)))

    # Equal times: right rows first, in their order, so that the last one is what a left row sees.
    inside = Window.partitionBy(*by, bucket).orderBy(place, side, held).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen_", F.last(held, ignorenulls=True).over(inside)).where(F.col(side) == 1)

    lasts = known.withColumn(bucket, F.floor(F.col(place) / (bucket_seconds * _MICROS))).groupBy(*by, bucket).agg(F.max(held).alias(held))
    wanted = asked.where(F.col(place).isNotNull()).withColumn(bucket, F.floor(F.col(place) / (bucket_seconds * _MICROS))).select(*by, bucket).distinct()
    buckets = lasts.unionByName(wanted.withColumn(held, F.lit(None).cast(lasts.schema[held].dataType))).groupBy(*by, bucket).agg(F.max(held).alias(held))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    borders = buckets.withColumn(carried, F.last(held, ignorenulls=True).over(before)).drop(held)
    match = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, bucket)]
    joined = seen.alias("s").join(borders.alias("b"), match, "left").select(F.col(f"s.{key}").alias(key), F.col(f"s.{place}").alias(place), F.coalesce(F.col("s.seen_"), F.col(f"b.{carried}")).alias(held))
    usable: Column = F.col(place).isNotNull()
    if within_seconds is not None:
        usable = usable & (F.col(place) - F.unix_micros(F.col(held)["at"].cast("timestamp")) <= int(within_seconds * _MICROS))
    return joined.select(f"{key}.*", *[F.when(usable, F.col(held)[f"v{i}"]).alias(name) for i, name in enumerate(take.values())])
