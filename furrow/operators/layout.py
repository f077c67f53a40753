"""Positioned words of page layouts: columns by range, rows by nearest preceding anchor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut, scratch


def word_columns(words: DataFrame, ranges: Sequence[tuple[str, float, float]], x: str = "x0") -> DataFrame:
    """Adds ``column``: the name of the half-open range [lo, hi) that holds the word's position, null outside all."""
    out = F.when(F.lit(False), F.lit(""))
    for name, lo, hi in ranges:
        out = out.when((F.col(x) >= lo) & (F.col(x) < hi), F.lit(name))
    return words.withColumn("column", out)


def anchor_bands(words: DataFrame, anchors: DataFrame, page: str = "page", top: str = "top", slack: float = 0.5, key: str = "anchor_id") -> DataFrame:
    """Adds the ``key`` of the last anchor of the page that begins at most ``slack`` below the word's top; null before the first.

    An as-of join as one window over the union of both sides, so neither side is multiplied and no range join is planned.
    A page is one group; words of one page are few.
    """
    cols = words.columns
    a = anchors.select(F.col(page).alias("_p"), (F.col(top) - slack).alias("_t"), F.lit(0).alias("_kind"), F.col(key).alias("_a"), F.lit(None).cast(words.select(F.struct(*cols).alias("w")).schema["w"].dataType).alias("_w"))
    w = words.select(F.col(page).alias("_p"), F.col(top).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(anchors.dtypes)[key]).alias("_a"), F.struct(*cols).alias("_w"))
    order = Window.partitionBy("_p").orderBy("_t", "_kind", "_a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(w).withColumn(key, F.last("_a", ignorenulls=True).over(order))
    return both.where("_kind = 1").select(*[F.col(f"_w.{c}").alias(c) for c in cols], key)


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, out: str) -> DataFrame:
    """Adds to each left row the ``value`` of the latest right row of the same ``by`` at or before its time; null if none. Of right rows at the
    same time the greatest value counts.

    Both sides lie in ranges of (by, time), in one table. Within a range the last value is carried along, and what the earlier ranges of a key
    end with is added; so a key may hold any share of the rows.
    """
    cols = left.columns
    r = right.select(F.col(by).alias("_b"), F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.lit(None).cast(left.select(F.struct(*cols).alias("w")).schema["w"].dataType).alias("_w"))
    l_ = left.select(F.col(by).alias("_b"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.struct(*cols).alias("_w"))
    with scratch():
        both = cut(r.unionByName(l_).repartitionByRange("_b", "_t", "_kind").withColumn("_range", F.spark_partition_id()))
        order = Window.partitionBy("_b", "_range").orderBy("_t", "_kind", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = both.where("_kind = 0 and _v is not null").groupBy("_b", "_range").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_end"))
        spans = both.select("_b", "_range").distinct().join(ends, ["_b", "_range"], "left")
        earlier = Window.partitionBy("_b").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = spans.select("_b", "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        local = both.withColumn("_here", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1").join(carried, ["_b", "_range"], "left")
        return cut(local.select(*[F.col(f"_w.{c}").alias(c) for c in cols], F.coalesce("_here", "_before").alias(out)), keep=True)
