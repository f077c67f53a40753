"""Problem 3: no contributor holds more than a cap; the best records by score remain.

Method: a histogram of scores per contributor, which merges by addition, gives the bin in which the cap falls.
Records in better bins stay, those in worse bins go, and only the records of that one bin are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import publisher_key, usable_score
from furrow.operators.ordering import prefix_totals
from furrow.session import cut, scratch


def over_cap(records: DataFrame, *, key: str = "id", contributor: str = "publisher", score: str = "score", max_share: float | None = 0.05, max_count: int | None = None, bins: int = 1024) -> DataFrame:
    """The keys of the records beyond each contributor's cap, with their contributor and score.

    The cap is ``max_share`` of all records rounded down, or ``max_count``; if both are given, the smaller. Within a
    contributor the order is higher score first, null and NaN last, then smaller key. Records without a
    contributor count in the total and are never dropped. Ties are broken by the key alone, so the result is fixed;
    keys should be unique (rows with equal keys and scores are ranked in some order). An empty table gives none.

    Histograms combine before the shuffle. Only contributors beyond the cap reach the join, fewer than 1/max_share
    of them when a share is given; the ranking of the borderline bin is spread over range partitions, so a bin of
    equal scores may hold any number of records.
    """
    rows = records.select(F.col(key).alias("key"), publisher_key(contributor).alias("who"), usable_score(score).alias("s"))
    caps = []
    if max_share is not None:
        total = records.count()
        # whole hundredths and the like must not fall below the integer they mean
        caps.append(math.floor(round(total * max_share, 9)))
    if max_count is not None:
        caps.append(max_count)
    cap = max(0, min(caps))
    named = rows.where("who is not null")
    finite = F.when(F.abs("s") != float("inf"), F.col("s"))
    ends = named.groupBy("who").agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).where(F.col("n") > cap)
    # an equal-width grid over the contributor's own range; infinite scores get bins of their own, missing ones the last
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = (
        F.when(F.col("s").isNull(), F.lit(-2))
        .when(F.col("s") == float("inf"), F.lit(bins + 1)).when(F.col("s") == float("-inf"), F.lit(-1))
        .when(width > 0, F.least(F.floor((F.col("s") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))).otherwise(F.lit(0))
    )
    with scratch():
        binned = cut(named.join(ends.select("who", "lo", "hi"), "who").select("key", "who", "s", bin_of.alias("bin")))
        hist = binned.groupBy("who", "bin").agg(F.count("*").alias("n"))
        better = Window.partitionBy("who").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        edge = hist.withColumn("above", F.coalesce(F.sum("n").over(better), F.lit(0))).where((F.col("above") <= cap) & (F.col("above") + F.col("n") > cap))
        edge = edge.select("who", F.col("bin").alias("edge_bin"), (F.lit(cap) - F.col("above")).alias("room"))
        placed = binned.join(edge, "who")
        worse = placed.where(F.col("bin") < F.col("edge_bin"))
        border = placed.where(F.col("bin") == F.col("edge_bin"))
        ranked = prefix_totals(border, ["who"], [F.col("s").desc_nulls_last(), F.col("key").asc()])
        cols = ["key", "who", "s"]
        out = worse.select(*cols).unionByName(ranked.where(F.col("rank") > F.col("room")).select(*cols))
        return cut(out.select(F.col("key").alias(key), F.col("who").alias("contributor"), F.col("s").alias("score")), keep=True)


def cap_contributors(records: DataFrame, *, key: str = "id", **how) -> DataFrame:
    """The records that remain under the cap (see ``over_cap``), with all their columns."""
    gone = over_cap(records, key=key, **how).select(F.col(key).alias("_gone"))
    return records.join(gone, records[key] == F.col("_gone"), "left_anti")
