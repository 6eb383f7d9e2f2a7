"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scratch import written

__all__ = ["fold_of", "narrow", "slices", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as doc_id and text: no other column can clash with an operator's own names."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches, rows: int = 512, size: int = 8 << 20):
    """Arrow batches cut to at most `rows` rows and, where rows are long, to fewer: about `size` bytes, or one row that has more. So
    Python objects of few texts are alive at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            todo = [batch.slice(at, rows)]
            while todo:
                part = todo.pop()
                if part.num_rows > 1 and part.nbytes > size:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
