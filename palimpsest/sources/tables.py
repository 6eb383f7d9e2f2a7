"""Sorted, immutable tables as Parquet: statistics and bloom filters take the place of a block index and key filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of value and three times the key that an entry has at most.
MAX_ENTRY = 64 << 20


def flush(entries: DataFrame, path: str, key: str = "key", partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Writes entries sorted by key, in ranges of keys, with a bloom filter on the key. An error are null and empty keys, a key twice, where
    there is a column kind others than 1 to 3, and where there is a column value an entry of more than MAX_ENTRY bytes.

    One shuffle: ranges of keys hold a key's entries together, so that those of a key are told apart without another one.
    """
    dealt = entries.repartitionByRange(partitions, key) if partitions else entries.repartitionByRange(key)
    fail = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(text)))
    types, k = dict(entries.dtypes), F.col(key)
    bytes_of = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long") if types[c] in ("string", "binary") else F.lit(0)
    checks = [(k.isNull(), "keys must be there"), (F.col("_pal_nth") > 1, "keys must be there once each")]
    if types[key] in ("string", "binary"):
        checks.append((F.octet_length(k) == 0, "a key is empty"))
    if "kind" in types:
        checks.append((~F.coalesce(F.col("kind").isin(1, 2, 3), F.lit(False)), "unknown kind"))
    if "value" in types:
        checks.append((bytes_of("value") + 3 * bytes_of(key) > MAX_ENTRY, "an entry is too large"))
    sound = F.coalesce(*(fail(bad, f"BAD_ENTRY: {text}").cast("boolean") for bad, text in checks), F.lit(True))
    order = Window.partitionBy(key).orderBy(key)
    sorted_ = dealt.withColumn("_pal_nth", F.row_number().over(order)).filter(sound).drop("_pal_nth").sortWithinPartitions(key)
    sorted_.write.mode(mode).option("parquet.bloom.filter.enabled#" + key, "true").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """One DataFrame for each table, in the order given: runs for merge_runs, the newest first."""
    return [spark.read.parquet(p) for p in paths]


def placements(table: DataFrame, key: str = "key") -> DataFrame:
    """(file, row, key): where each entry of a table stands."""
    return table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), key)
