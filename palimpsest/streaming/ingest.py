"""Streams into tables: each micro-batch is flushed as one table, its number being its sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import flush


def flush_batches(stream: DataFrame, folder: str, checkpoint: str, key: str = "key", order: str = "seq"):
    """A query that writes table `folder`/seq=<n> for each micro-batch: of each key the last entry by `order`. A batch that is tried again
    has the same rows and the same number, so it writes its table anew: half-written ones are replaced, whole ones stay as they were."""

    def one(batch: DataFrame, n: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")
        flush(last, f"{folder}/seq={n:020d}", key, mode="overwrite")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
