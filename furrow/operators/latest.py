"""The current version of each key in an arrival-ordered table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``at``; only ``columns`` are carried through the shuffle.

    A null ``at`` is older than any other. Rows that tie on ``at`` are ordered by the carried columns, so the result
    does not depend on the order of arrival. Rows with a null key are no record and are left out. The aggregate
    combines before the shuffle, so a key with very many versions costs one row per input partition.
    """
    cols = [c for c in columns if c not in (key, at)]
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in cols])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, f"_best.{at}", *[f"_best.{c}" for c in cols])
