"""Positions, running sums and ranks over a whole frame without a single-partition window.

A frame is cut into buckets that are themselves ordered: by the event's name for
the data order, and by the binary magnitude of a statistic (or of its distance from 1,
above a half) for its rank; rows at exactly 0 or 1, as many p-values are, by their event. Windows
run inside buckets; the small table of bucket totals is summed over the buckets
and joined back. Group columns partition everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join on the group columns, or with the one row of ``right`` where there are none."""
    if groups:
        return left.join(right, list(groups))
    return left.crossJoin(F.broadcast(right))  # an aggregate without groups has exactly one row


def magnitude(x: Column) -> Column:
    """A whole number that doesn't decrease as x increases; null and NaN come last."""
    size = F.floor(F.log2(F.abs(x)) * 16)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(1 << 20))
        .when(x == 0, F.lit(0))
        .when((x > 0.5) & (x < 1), 39_984 - F.ceil(F.log2(1 - x) * 16))
        .when(x >= 1, size + 42_000)
        .when(x > 0, size + 40_000)
        .otherwise(-size - 40_000)
        .cast("int")
    )


def running(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: dict[str, str | Column],
) -> DataFrame:
    """Adds running sums, in the order of ``bucket`` and then ``order``; ``sums`` maps new names to what is summed."""
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = df.withColumns({name: F.sum(what).over(inside) for name, what in sums.items()})
    totals = df.groupBy(*groups, bucket).agg(*[F.sum(what).alias(f"_{name}") for name, what in sums.items()])
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, bucket, *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums]
    )
    out = made.join(offsets, [*groups, bucket])
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop(*[f"_{name}" for name in sums])


def with_position(df: DataFrame, groups: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Adds the place of each row in the order of ``ae_name`` and ``product_name``, from 1."""
    return running(df, groups, "ae_name", [F.col("product_name")], {name: F.lit(1)})


def with_rank(df: DataFrame, statistic: str, name: str, groups: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds the rank of each row by a statistic, ties by ``ae_name`` and ``product_name``, null and NaN last."""
    value = F.nanvl(F.col(statistic).cast("double"), F.lit(None).cast("double"))
    buckets = magnitude(value)
    if descending:
        buckets = F.when(value.isNull(), buckets).otherwise(-buckets)
    tie = F.when(value.isNull() | value.isin(0.0, 1.0), F.col("ae_name").cast("string")).otherwise("")
    key = value.desc_nulls_last() if descending else value.asc_nulls_last()
    order = [key, F.col("ae_name"), F.col("product_name")]
    df = df.withColumn("_bucket", F.struct(buckets.alias("size"), tie.alias("tie")))
    return running(df, groups, "_bucket", order, {name: F.lit(1)}).drop("_bucket")
