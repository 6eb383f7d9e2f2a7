"""Reads of key ranges and keys: plain filters and joins, which Catalyst pushes to the scans below the folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, key: str = "key", lo=None, hi=None) -> DataFrame:
    """Rows whose key is in [lo, hi); None is no bound."""
    if lo is not None:
        df = df.filter(F.col(key) >= F.lit(lo))
    return df if hi is None else df.filter(F.col(key) < F.lit(hi))


def page(df: DataFrame, n: int, key: str = "key", start=None) -> DataFrame:
    """The first n rows in key order from `start` on, for reading on from the last key that was seen."""
    return bound(df, key, start).orderBy(key).limit(n)


def multi_get(df: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows of the given keys. Join strategy is left to Spark, since the keys may be many."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def locate(df: DataFrame, value: str, least: int = 4096) -> DataFrame:
    """Adds n_bytes and large, whether the value is read better by place than inline; value is null for large rows."""
    sized = df.withColumn("n_bytes", F.octet_length(value).cast("long")).withColumn("large", F.col("n_bytes") >= least)
    return sized.withColumn(value, F.when(~F.col("large"), F.col(value)))


def locate_newest(versions: DataFrame, value: str, key: str = "key", least: int = 4096) -> DataFrame:
    """(key, n_bytes, large, value, and file and row where the versions have them) of each key's newest version, for put-only spaces of large
    values: the place where large, the value where not. A delete on top gives nothing, a merge on top is an error."""
    rest = [c for c in versions.columns if c not in (key, "prec")]
    top = versions.groupBy(key).agg(F.min_by(F.struct(*rest), "prec").alias("x")).select(key, "x.*")
    put = F.when(F.col("kind") == 3, F.raise_error(F.lit("CORRUPT: a merge entry under a located key"))).otherwise(F.col("kind") == 1)
    return locate(top.filter(put).drop("kind"), value, least)
