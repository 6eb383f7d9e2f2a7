"""Metadata of sorted tables as DataFrames: what each table holds, which tables a range meets, sizes by space and level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_meta(entries: DataFrame, table: str, key: str = "key") -> DataFrame:
    """(table, count, deletes, min, max) of entries (table, key, kind)."""
    return entries.groupBy(table).agg(F.count("*").alias("count"), F.count_if(F.col("kind") == 2).alias("deletes"), F.min(key).alias("min"), F.max(key).alias("max"))


def overlaps(lo=None, hi=None) -> Column:
    """Whether a table of keys [min, max] meets [lo, hi); None is no bound."""
    above = F.lit(True) if lo is None else F.col("max") >= F.lit(lo)
    return above if hi is None else above & (F.col("min") < F.lit(hi))


def newest_first(files: DataFrame) -> DataFrame:
    """prec of files (level, seq, min): level 0 by seq from the newest, then the deeper levels by min. One row a file, not a key."""
    order = Window.orderBy("level", F.when(F.col("level") == 0, -F.col("seq")), "min", "seq")
    return files.withColumn("prec", F.row_number().over(order) - 1)


def signature(files: DataFrame, name: str = "name") -> DataFrame:
    """One row: a digest of the names in order of precedence. It changes if and only if the list of files does."""
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prec", name))), lambda x: x[name]), "\n"), 256).alias("signature"))


def holds(key) -> Column:
    """Whether a table of keys [min, max] may hold the key."""
    return (F.col("min") <= F.lit(key)) & (F.lit(key) <= F.col("max"))


def space_ranges(entries: DataFrame, table: str, space: str, key: str = "key") -> DataFrame:
    """(table, space, min, max, count) for each key space that a table has entries of."""
    return entries.groupBy(table, space).agg(F.min(key).alias("min"), F.max(key).alias("max"), F.count("*").alias("count"))


def apply_edit(files: DataFrame, deleted: DataFrame, added: DataFrame, name: str = "name") -> DataFrame:
    """The files after an edit: those not deleted, and those added. A deleted name that is not there is ignored; a moved file is in both. An
    added file without a key range is an error where it has the columns min and max; edit_errors says what else is wrong."""
    if {"min", "max"} <= set(added.columns):
        bare = F.col("min").isNull() | F.col("max").isNull()
        added = added.filter(F.when(bare, F.raise_error(F.concat(F.lit("BAD_EDIT: no key range of file "), F.col(name).cast("string")))).otherwise(True))
    return files.join(deleted.select(name), name, "left_anti").unionByName(added)


def edit_errors(files: DataFrame, deleted: DataFrame, added: DataFrame, name: str = "name") -> DataFrame:
    """(name, level, error) of what makes an edit unsound: added files without a key range, and files of levels from 1 on that would
    meet or touch the one before them. A sound edit has no rows."""
    bare = F.col("min").isNull() | F.col("max").isNull()
    after = files.join(deleted.select(name), name, "left_anti").unionByName(added.filter(~bare))
    none, meet = added.filter(bare).select(name, "level", F.lit("no key range").alias("error")), touching(after, name).select(name, "level", F.lit("overlap").alias("error"))
    return none.unionByName(meet)


def touching(files: DataFrame, name: str = "name") -> DataFrame:
    """Files (level, min, max) of levels from 1 on whose keys meet or touch those of the files before them, in the order of min, max and
    name: no sound list has any. One row a file, not a key."""
    before = F.max("max").over(Window.partitionBy("level").orderBy("min", "max", name).rowsBetween(Window.unboundedPreceding, -1))
    return files.filter("level >= 1").withColumn("before", before).filter("before >= min")


def job_overlap(inputs: DataFrame, deeper: DataFrame) -> DataFrame:
    """Files of `deeper` (space, min, max) that a merge of the inputs rewrites: those that meet the range of all inputs of their space, with it as lo and hi."""
    hull = inputs.groupBy("space").agg(F.min("min").alias("lo"), F.max("max").alias("hi"))
    return deeper.join(hull, "space").filter("max >= lo and min <= hi")


def receives(ranges: DataFrame, inputs: DataFrame, *, inclusive: bool = False) -> DataFrame:
    """Those of the ranges (space, lo, hi) that some input (space, min, max) may put a key into: by each input's own range, not their hull.
    hi is exclusive unless `inclusive`; null is no bound."""
    start, end = F.coalesce(F.col("max") >= F.col("lo"), F.lit(True)), F.col("min") <= F.col("hi") if inclusive else F.col("min") < F.col("hi")
    each = inputs.select(F.col("space").alias("_space"), "min", "max")
    return ranges.join(each, (F.col("space") == F.col("_space")) & start & F.coalesce(end, F.lit(True)), "left_semi")


def worth_cleaning(spaces: DataFrame, ratio: float) -> DataFrame:
    """Spaces (runs, entries, deletes) of several runs with at least `ratio` deletes to each entry that is none."""
    return spaces.filter((F.col("runs") > 1) & (F.col("deletes") > 0) & (F.col("deletes") >= F.lit(ratio) * (F.col("entries") - F.col("deletes"))))
