"""What several training-data operators share."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from furrow.operators.latest import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publisher_key(col: str | Column = "publisher") -> Column:
    """Publisher names that differ only in case or spaces are one; null and blank are null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def usable_score(col: str | Column = "score") -> Column:
    """The score, or null where it is NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def manifest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current records of ``download_manifest``."""
    return latest(table(spark, sf_dir, "download_manifest"), "id", "listed_at", columns)


_WORD = re.compile(r"[a-z0-9]+")


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    flat = unicodedata.normalize("NFKD", text.lower())
    return sorted(set(_WORD.findall("".join(c for c in flat if not unicodedata.combining(c)))))


@pandas_udf(T.ArrayType(T.StringType()))
def word_set(s: pd.Series) -> pd.Series:
    """Distinct words, sorted: lower case, accents dropped, all but a-z and 0-9 separates."""
    return s.map(_words)


def crop_set(col: str | Column = "crops_covered") -> Column:
    """Sorted distinct crop names, split at ``;``, case and outer spaces ignored; null gives an empty array."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
