"""Exact positions in a global order without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut


def prefix_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """Rank every row within ``keys`` (1 first) and sum columns over the rows before it.

    ``sums`` maps a numeric column to the name of its running total *before* the row. A key may hold any share of
    the rows: rows are range-partitioned by (keys, order), ranked within their range, and shifted by totals of the
    earlier ranges, so the largest group a task sees is one range. ``order`` must be a total order (end it with a
    unique column); rows with a null key form a group of their own. Empty input gives an empty result.

    The ranges are written to the shared folder, since they are read twice and must not move in between.
    """
    sums = sums or {}
    keyed = df.withColumn("_grp", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")))
    placed = cut(keyed.repartitionByRange(*[F.col("_grp").asc_nulls_first()], *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_grp", "_range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn(rank, F.row_number().over(inside).cast("long"))
    for col, name in sums.items():
        local = local.withColumn(name, F.coalesce(F.sum(col).over(before), F.lit(0)))
    totals = placed.groupBy("_grp", "_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{n}") for c, n in sums.items()])
    earlier = Window.partitionBy("_grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        F.col("_grp").alias("_g2"), F.col("_range").alias("_r2"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s0_{n}") for n in sums.values()],
    )
    out = local.join(shifts, (F.col("_range") == F.col("_r2")) & F.col("_grp").eqNullSafe(F.col("_g2")))
    out = out.withColumn(rank, F.col(rank) + F.col("_n0"))
    for name in sums.values():
        out = out.withColumn(name, F.col(name) + F.col(f"_s0_{name}"))
    return out.select(*df.columns, rank, *sums.values())
