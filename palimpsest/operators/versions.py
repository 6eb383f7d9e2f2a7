"""Histories of put, delete and merge entries, folded into one entry per key with DataFrame operations.

A version is a row (key, prec, kind, ...): prec 0 is the newest. The newest put or delete of a key ends its history; what is
older is shadowed. All folds shuffle on the key alone, so a filter on the key reaches the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE, MERGE = 1, 2, 3
#: Versions of one key that one task takes; a key with more is dealt over several.
DEALT = 1 << 16


def entry_errors(entries: DataFrame, key: str = "key") -> DataFrame:
    """(key, entries, unknown) of keys that no flush takes: null ones, ones with several entries, and ones with an entry of unknown kind."""
    each = entries.groupBy(key).agg(F.count("*").alias("entries"), F.count_if(~F.coalesce(F.col("kind"), F.lit(0)).isin(PUT, DELETE, MERGE)).alias("unknown"))
    return each.filter(F.col(key).isNull() | (F.col("entries") > 1) | (F.col("unknown") > 0))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """All versions of several runs, newest run first, each with its precedence."""
    return reduce(DataFrame.unionByName, [run.withColumn("prec", F.lit(k)) for k, run in enumerate(runs)])


def with_precedence(df: DataFrame, key: str, newest_first: Column) -> DataFrame:
    """prec within each key: 0 for the newest."""
    return df.withColumn("prec", F.row_number().over(Window.partitionBy(key).orderBy(newest_first)) - 1)


def ends(versions: DataFrame, key: str = "key") -> DataFrame:
    """(_key, _end, _n) for each key: the prec of its newest put or delete, null if it has none, and the number of its versions. Sums are
    partial before the shuffle, so a hot key costs each task one row."""
    return versions.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(F.col("kind") != MERGE, F.col("prec"))).alias("_end"), F.count("*").alias("_n"))


def merge_order(versions: DataFrame, key: str = "key") -> DataFrame:
    """All versions in the order of a merge, by key and then from the newest on: ranges of keys, sorted inside."""
    return versions.repartitionByRange(key).sortWithinPartitions(key, "prec")


def live(versions: DataFrame, key: str = "key") -> DataFrame:
    """The versions that a fold sees: down to the newest put or delete, that one included. No window: a hot key is streamed, not buffered,
    and its join may be split as a skewed one."""
    both = versions.join(ends(versions, key), F.col(key).eqNullSafe(F.col("_key")))
    return both.filter("_end is null or prec <= _end").select(*versions.columns)


def live_dealt(versions: DataFrame, key: str = "key") -> DataFrame:
    """As live, but the versions of a key with more than DEALT of them are dealt over tasks, which the column _deal tells apart. Whether the
    table of such keys is broadcast is left to Spark, which knows its size."""
    found = ends(versions, key).select("_key", "_end", F.ceil(F.col("_n") / DEALT).alias("_deals"))
    hot = found.filter("_deals > 1").select(F.col("_key").alias("_hot"), F.col("_deals").alias("_among"))
    dealt = versions.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_deal", F.pmod(F.xxhash64("prec"), F.coalesce("_among", F.lit(1))))
    found = found.select("_key", "_end", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_of"))
    both = dealt.join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_deal") == F.col("_of")))
    return both.filter("_end is null or prec <= _end").select(*versions.columns, "_deal")


def last_writer(versions: DataFrame, key: str = "key", *, bottom: bool) -> DataFrame:
    """The newest version of each key, for histories without merges: one aggregation, no sort. A merge on top is an error.

    With bottom, deleted keys are gone; else their delete stays to shadow what lies deeper.
    """
    rest = [c for c in versions.columns if c not in (key, "prec")]
    top = versions.groupBy(key).agg(F.min_by(F.struct(*rest), "prec").alias("x")).select(key, "x.*")
    known = F.when(F.col("kind") == MERGE, F.raise_error(F.lit("NO_MERGER: a merge entry needs a merge function"))).otherwise(F.col("kind"))
    top = top.withColumn("kind", known)
    return top.filter(F.col("kind") == PUT) if bottom else top


def resolve_sets(versions: DataFrame, key: str = "key", *, bottom: bool) -> DataFrame:
    """(key, kind, add, rem) of set-valued histories (key, prec, kind, add, rem): arrays of members.

    A put's set is its add. A merge takes rem away and then puts add in. Per member the newest mention decides, and add wins within one
    version. With bottom only non-deleted puts remain; else merges with nothing beneath stay one merge. A set that merges leave empty is a
    delete; a put of an empty set stays.

    One scan and two aggregations with partial sums: by (key, member), where each version also counts under no member, and by key, which
    gathers distinct members alone. What is shadowed falls out last: a member is live if its newest mention is no older than the key's end.
    """
    none = F.array().cast("array<bigint>")
    said = lambda c, s: F.transform(F.coalesce(c, none), lambda m: F.struct(m.alias("m"), F.lit(s).alias("s")))
    mentions = F.when(F.col("kind") != DELETE, F.concat(said("add", 1), said("rem", 0))).otherwise(said(none, 0))
    marker = F.array(F.struct(F.lit(None).cast("bigint").alias("m"), F.lit(-1).alias("s")))
    each = versions.select(key, "prec", "kind", F.explode(F.concat(marker, F.filter(mentions, lambda x: x["m"].isNotNull()))).alias("x")).select(key, "prec", "kind", "x.m", "x.s")
    mark, settled = F.col("s") == -1, F.col("kind") != MERGE
    newest = each.groupBy(key, "m").agg(F.max(F.when(~mark, F.struct((-F.col("prec")).alias("at"), "s"))).alias("said"), F.min(F.when(mark & settled, F.struct("prec", "kind"))).alias("end"), F.min(F.when(mark & ~settled, F.col("prec"))).alias("op"))
    parts = newest.groupBy(key).agg(F.min("end").alias("end"), F.min("op").alias("op"), F.collect_list(F.when(F.col("m").isNotNull(), F.struct("m", "said"))).alias("members"))
    ended = F.col("end.prec")
    side = lambda s: F.array_sort(F.transform(F.filter("members", lambda x: (x["said"]["s"] == s) & (ended.isNull() | (-x["said"]["at"] <= ended))), lambda x: x["m"]))
    both = parts.select(key, F.col("end.kind").alias("under"), (F.col("op").isNotNull() & (ended.isNull() | (F.col("op") < ended))).alias("ops"), side(1).alias("add"), side(0).alias("rem"))
    open_ = F.col("ops") & F.col("under").isNull() & F.lit(not bottom)
    kind = F.when(~F.col("ops"), F.col("under")).when(open_, MERGE).when(F.size("add") > 0, PUT).otherwise(DELETE)
    out = both.withColumn("kind", kind.cast("int"))
    out = out.select(key, "kind", F.when(F.col("kind") == DELETE, none).otherwise(F.col("add")).alias("add"), F.when(F.col("kind") == MERGE, F.col("rem")).otherwise(none).alias("rem"))
    return out.filter(F.col("kind") == PUT) if bottom else out


def resolve_with(versions: DataFrame, fold, result: str, key: str = "key", *, bottom: bool, partial=None) -> DataFrame:
    """(key, kind, value) by a fold of one's own: fold(base or null, array of operands oldest first) is a Column expression that gives
    the value, null for none. For folds without a closed form; a key's live operands must fit in memory.

    A fold that is associative and takes the operands in any order has no such bound: partial, an aggregate such as F.sum that also
    combines its own results, gathers the operands, and fold(base or null, what partial gave) gives the value."""
    if partial is not None:
        return _resolve_dealt(versions, fold, partial, result, key, bottom)
    seen = live(versions, key)
    parts = seen.groupBy(key).agg(
        F.max(F.when(F.col("kind") == PUT, F.col("value"))).alias("base"), F.max((F.col("kind") == MERGE).cast("int")).alias("ops"), F.max((F.col("kind") == DELETE).cast("int")).alias("dead"), F.max((F.col("kind") == PUT).cast("int")).alias("put"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == MERGE, F.struct((-F.col("prec")).alias("p"), "value")))).alias("operands"),
    )
    return _folded(parts, fold(F.col("base"), F.transform("operands", lambda x: x["value"])), result, key, bottom)


def _resolve_dealt(versions, fold, partial, result, key, bottom):
    names = ("base", "ops", "dead", "put")
    each = live_dealt(versions, key).groupBy(key, "_deal").agg(
        F.max(F.when(F.col("kind") == PUT, F.col("value"))).alias("base"), *(F.max((F.col("kind") == k).cast("int")).alias(n) for k, n in ((MERGE, "ops"), (DELETE, "dead"), (PUT, "put"))), partial(F.when(F.col("kind") == MERGE, F.col("value"))).alias("operands"),
    )
    parts = each.groupBy(key).agg(*(F.max(n).alias(n) for n in names), partial(F.col("operands")).alias("operands"))
    return _folded(parts, fold(F.col("base"), F.col("operands")), result, key, bottom)


def _folded(parts, folded, result, key, bottom):
    """(key, kind, value) of keys' base, flags and the value that their operands were folded to."""
    value = F.when(F.col("ops") == 0, F.col("base")).otherwise(folded).cast(result)
    out = parts.withColumn("value", value).withColumn("kind", F.when((F.col("ops") == 0) & (F.col("put") == 1), PUT).when((F.col("ops") == 1) & F.col("value").isNotNull(), PUT).otherwise(DELETE))
    open_ = (F.col("ops") == 1) & (F.col("put") == 0) & (F.col("dead") == 0)
    if not bottom:
        out = out.withColumn("kind", F.when(open_, MERGE).otherwise(F.col("kind")))
    out = out.select(key, F.col("kind"), "value")
    return out.filter(F.col("kind") == PUT) if bottom else out
