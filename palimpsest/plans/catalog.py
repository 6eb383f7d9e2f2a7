"""The queries of the versioned key-value operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keys
from palimpsest.functions.postings import coded, decode, postings
from palimpsest.operators import files, reads, versions
from palimpsest.sources import scratch, tables

BATCH = 500


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark, sf_dir):
    """events as set-valued histories of users: the later the event the newer."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", 2).otherwise(3)
    member, none = F.array(F.get_json_object("props", "$.k").cast("long")), F.array().cast("array<bigint>")
    return e.select("user_id", "event_id", (-F.col("event_id")).alias("prec"), kind.alias("kind"), F.when(F.col("event_type").isin("signup", "purchase", "click"), member).otherwise(none).alias("add"), F.when(F.col("event_type") == "view", member).otherwise(none).alias("rem"))


def _text(c):
    return F.array_join(F.transform(c, lambda m: m.cast("string")), ",")


def _members(df):
    return df.select("user_id", F.size("add").cast("long").alias("n_members"), _text("add").alias("members"))


def resolve_set_bottom(spark, sf_dir):
    return _members(versions.resolve_sets(history(spark, sf_dir), "user_id", bottom=True))


def resolve_set_partial(spark, sf_dir):
    out = versions.resolve_sets(history(spark, sf_dir), "user_id", bottom=False)
    return out.select("user_id", "kind", _text("add").alias("added"), _text("rem").alias("removed"))


def _plain(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("user_id", (-F.col("event_id")).alias("prec"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("kind"), "event_id", "event_type")


def lww_put_delete(spark, sf_dir):
    return versions.last_writer(_plain(spark, sf_dir), "user_id", bottom=True).select("user_id", "event_id", "event_type")


def tombstones_kept(spark, sf_dir):
    return versions.last_writer(_plain(spark, sf_dir), "user_id", bottom=False).select("user_id", "kind", "event_id")


def merge_all_versions(spark, sf_dir):
    return versions.with_precedence(_plain(spark, sf_dir).drop("prec"), "user_id", F.desc("event_id")).select("user_id", "event_id", "kind", F.col("prec").cast("long").alias("prec"))


def merge_runs(spark, sf_dir):
    e = _plain(spark, sf_dir).select("user_id", "event_id", "kind")
    return versions.merge_runs([e.filter(F.col("event_id") % 3 == k) for k in (2, 1, 0)]).withColumn("prec", F.col("prec").cast("long"))


def range_iter(spark, sf_dir):
    return _members(reads.bound(versions.resolve_sets(history(spark, sf_dir), "user_id", bottom=True), "user_id", 20, 60))


def seek_page(spark, sf_dir):
    return reads.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 50, "o_orderkey", 1000)


def point_get(spark, sf_dir):
    return reads.bound(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 42, 43)


def multi_get(spark, sf_dir):
    wanted = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reads.multi_get(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


def locate_large(spark, sf_dir):
    return reads.locate(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "n_bytes", "large")


def _flushed(spark, sf_dir):
    e = _plain(spark, sf_dir).withColumn("seq", F.floor(F.col("event_id") / BATCH).cast("long"))
    return e.groupBy("seq", "user_id").agg(F.max_by(F.struct("event_id", "kind"), "event_id").alias("x")).select("seq", "user_id", "x.*")


def flush_batches(spark, sf_dir):
    top = _flushed(spark, sf_dir).withColumn("prec", -F.col("seq"))
    return versions.last_writer(top, "user_id", bottom=True).select("user_id", "seq", "event_id")


def table_meta(spark, sf_dir):
    return files.table_meta(_flushed(spark, sf_dir), "seq", "user_id")


def files_overlapping(spark, sf_dir):
    meta = files.table_meta(_flushed(spark, sf_dir), "seq", "user_id").withColumn("level", (F.col("seq") % 3).cast("long"))
    return files.newest_first(meta.filter(files.overlaps(30, 40))).select("level", "seq", "min", "max", F.col("prec").cast("long").alias("prec"))


def holding_tables(spark, sf_dir):
    return files.table_meta(_flushed(spark, sf_dir), "seq", "user_id").filter(files.holds(42)).select("seq", "count")


def signature(spark, sf_dir):
    return files.signature(files_overlapping(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), F.col("seq"))))


def runs_by_space(spark, sf_dir):
    e = _flushed(spark, sf_dir).withColumn("space", (F.col("user_id") % 4).cast("long"))
    return e.groupBy("space", "seq").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == 2).alias("deletes"))


def _halves(spark, sf_dir):
    """The history's newer and older half by number of event, each folded to one entry a key as a flush does."""
    h = history(spark, sf_dir)
    cut = (h.agg(F.max("event_id")).first()[0] or 0) // 2
    return [versions.resolve_sets(h.filter(part), "user_id", bottom=False) for part in (F.col("event_id") >= cut, F.col("event_id") < cut)]


def _as_tables(spark, *runs):
    """Each run flushed as a sorted table and read back."""
    paths = [scratch.new_path(spark) for _ in runs]
    for run, path in zip(runs, paths, strict=True):
        tables.flush(run, path, "user_id")
    return tables.read(spark, *paths)


def compact_then_read(spark, sf_dir):
    """The older half compacted to one entry a key, then read under the newer half: the same as reading all."""
    h = history(spark, sf_dir)
    cut = (h.agg(F.max("event_id")).first()[0] or 0) // 2
    old = versions.resolve_sets(h.filter(F.col("event_id") < cut), "user_id", bottom=False)
    old = old.withColumn("prec", F.lit(1 - cut).cast("long"))
    new = h.filter(F.col("event_id") >= cut).drop("event_id")
    return _members(versions.resolve_sets(new.unionByName(old.select(new.columns)), "user_id", bottom=True))


def tables_read(spark, sf_dir):
    """Two flushed tables, merged by precedence and folded as they are read."""
    return _members(versions.resolve_sets(versions.merge_runs(_as_tables(spark, *_halves(spark, sf_dir))), "user_id", bottom=True))


def tables_multi_get(spark, sf_dir):
    """The users that are customers of one segment, through two flushed tables."""
    wanted = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    runs = [reads.multi_get(t, wanted, "user_id") for t in _as_tables(spark, *_halves(spark, sf_dir))]
    return _members(versions.resolve_sets(versions.merge_runs(runs), "user_id", bottom=True))


def tables_compacted(spark, sf_dir):
    """Two flushed tables compacted into one of the bottom level, which is flushed and read in its turn."""
    merged = versions.merge_runs(_as_tables(spark, *_halves(spark, sf_dir)))
    return _members(_as_tables(spark, versions.resolve_sets(merged, "user_id", bottom=True))[0])


def get_version(spark, sf_dir):
    """One user: the bound reaches the scan below the fold."""
    return _members(versions.resolve_sets(reads.bound(history(spark, sf_dir), "user_id", 42, 43), "user_id", bottom=True))


def locate_newest(spark, sf_dir):
    """Texts by document under the deletions of toxic ones, read through two flushed tables."""
    new = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("value"))
    old = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("kind"), F.col("text").alias("value"))
    paths = [scratch.new_path(spark) for _ in range(2)]
    for run, path in zip((new.dropDuplicates(["doc_id"]), old), paths, strict=True):
        tables.flush(run, path, "doc_id")
    found = reads.locate_newest(versions.merge_runs(tables.read(spark, *paths)), "value", "doc_id")
    return found.select("doc_id", "n_bytes", "large", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("inline_bytes"))


def merge_order(spark, sf_dir):
    return versions.merge_order(merge_all_versions(spark, sf_dir), "user_id")


def duplicate_key_history(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    rest = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    top = l.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*rest)).alias("x"), F.count("*").alias("n_versions"))
    return top.select("l_orderkey", "l_linenumber", "x.l_partkey", "x.l_quantity", "n_versions")


def keyenc_string(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(keys.encode_string(F.col("c_name").cast("binary"))).alias("key"), F.decode(keys.decode_string(keys.encode_string(F.col("c_name").cast("binary"))), "utf-8").alias("name"))


def keyenc_double(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.hex(keys.encode_double(F.col("c_acctbal"))).alias("key"))
    return c.select("c_custkey", F.substring("key", 1, 16).alias("key"), (F.col("c_acctbal") < 0).alias("below"))


def keyenc_double_back(spark, sf_dir):
    """A key of a string and a number, taken apart again."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(keys.encode_string(F.col("c_name").cast("binary")), keys.encode_double(F.col("c_acctbal")), F.lit(b"\x07")).alias("key"))
    c = c.withColumn("a", keys.split_string(F.col("key"))).withColumn("b", keys.split_double(F.col("a.rest")))
    return c.select("c_custkey", F.decode("a.value", "utf-8").alias("name"), F.col("b.value").alias("balance"), F.hex("b.rest").alias("rest"), (F.col("a.ok") & F.col("b.ok")).alias("ok"))


def prefix_end(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.hex(keys.prefix_end(F.substring("p_name", 1, 3).cast("binary"))).alias("upper_bound"))


def postings_rows(spark, sf_dir):
    return postings(_table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("weight").alias("total"))


def postings_coded(spark, sf_dir):
    """Lists written as bytes and read back: the same counts as of the rows."""
    lists = coded(_table(spark, sf_dir, "documents"), "doc_id", "text")
    back = lists.select("term", F.explode(decode(F.col("data"))).alias("x"))
    return back.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("x.weight").alias("total"))


def entry_errors(spark, sf_dir):
    return versions.entry_errors(_plain(spark, sf_dir), "user_id")


def _placed(spark, sf_dir, *by):
    level = (F.col("seq") % 3).cast("long").alias("level")
    e = _flushed(spark, sf_dir).withColumn("space", (F.col("user_id") % 4).cast("long")).groupBy("seq", *by)
    return e.agg(F.count("*").alias("count"), F.count_if(F.col("kind") == 2).alias("deletes"), F.min("user_id").alias("min"), F.max("user_id").alias("max")).select("*", level)


def apply_edit(spark, sf_dir):
    """Every fifth table moved to level 4."""
    now = _placed(spark, sf_dir)
    moved = now.filter("seq % 5 = 0")
    return files.apply_edit(now, moved, moved.withColumn("level", F.lit(4).cast("long")), "seq").select("seq", "level", "count")


def edit_errors(spark, sf_dir):
    """What makes it unsound to move the tables of level 0 to level 1."""
    now = _placed(spark, sf_dir)
    moved = now.filter("level = 0")
    return files.edit_errors(now, moved, moved.withColumn("level", F.lit(1).cast("long")), "seq").select("seq", "level", "error")


def table_spaces(spark, sf_dir):
    return files.space_ranges(_flushed(spark, sf_dir).withColumn("space", (F.col("user_id") % 4).cast("long")), "seq", "space", "user_id")


def receiving_ranges(spark, sf_dir):
    """Ranges of level 1, by space, that tables of level 2 may put a key into."""
    f = _placed(spark, sf_dir, "space")
    ranges = f.filter("level = 1").select("space", "seq", F.col("min").alias("lo"), F.col("max").alias("hi"))
    return files.receives(ranges, f.filter("level = 2"), inclusive=True)


def level_sizes(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("level").agg(F.count("*").alias("tables"), F.sum("count").alias("entries"), F.sum("deletes").alias("deletes"))


def touching_tables(spark, sf_dir):
    return files.touching(_placed(spark, sf_dir), "seq").select("level", "seq", "min", "before")


def job_overlap(spark, sf_dir):
    f = _placed(spark, sf_dir, "space")
    return files.job_overlap(f.filter("level = 0"), f.filter("level = 1")).select("space", "seq", "lo", "hi")


def worth_cleaning(spark, sf_dir):
    spaces = _placed(spark, sf_dir, "space").groupBy("space").agg(F.count("*").alias("runs"), F.sum("count").alias("entries"), F.sum("deletes").alias("deletes"))
    return files.worth_cleaning(spaces, 0.2)


def set_union_except(spark, sf_dir):
    """Members are made distinct by aggregation, so that only distinct ones are gathered; a user without any stays."""
    side = lambda c, removed: F.transform(c, lambda m: F.struct(m.alias("m"), F.lit(removed).alias("removed")))
    each = history(spark, sf_dir).select("user_id", F.explode_outer(F.concat(side("add", False), side("rem", True))).alias("x"))
    each = each.groupBy("user_id", F.col("x.m").alias("m")).agg(F.max("x.removed").alias("removed"))
    sides = each.groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("either"), F.array_sort(F.collect_list(F.when(~F.col("removed"), F.col("m")))).alias("only"))
    return sides.select("user_id", _text(F.col("either")).alias("either"), _text(F.col("only")).alias("only_added"))


def fold_sum(spark, sf_dir):
    """A merge function of one's own: put sets a number, merges add to it."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", 2).otherwise(3)
    v = e.select("user_id", (-F.col("event_id")).alias("prec"), kind.alias("kind"), (F.col("event_id") % 100).alias("value"))
    out = versions.resolve_with(v, lambda base, ops: F.coalesce(base, F.lit(0).cast("long")) + ops, "long", "user_id", bottom=True, partial=F.sum)
    return out.select("user_id", "value")


def fold_sum_partial(spark, sf_dir):
    """The same for a level with more below: deletes stay, and merges with nothing beneath stay merges."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", 2).otherwise(3)
    v = e.select("user_id", (-F.col("event_id")).alias("prec"), kind.alias("kind"), (F.col("event_id") % 100).alias("value"))
    out = versions.resolve_with(v, lambda base, ops: F.coalesce(base, F.lit(0).cast("long")) + ops, "long", "user_id", bottom=False, partial=F.sum)
    return out.withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


_HISTORY = """h AS (SELECT user_id, event_id, event_type,
    CASE WHEN event_type IN ('signup','purchase') THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END AS kind,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS m FROM events {where}),
t AS (SELECT *, max(CASE WHEN kind <> 3 THEN event_id END) OVER (PARTITION BY user_id) AS term FROM h),
live AS (SELECT * FROM t WHERE term IS NULL OR event_id >= term),
lastm AS (SELECT user_id, m, event_type, row_number() OVER (PARTITION BY user_id, m ORDER BY event_id DESC) AS rn FROM live WHERE kind <> 2)"""
_BOTTOM = "SELECT user_id, count(*) AS n_members, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS members FROM lastm WHERE rn = 1 AND event_type <> 'view' {more} GROUP BY user_id"
_ALL = "WITH " + _HISTORY.format(where="") + " " + _BOTTOM
_FLUSHED = f"""f AS (SELECT user_id, seq, event_id, kind FROM (SELECT user_id, event_id // {BATCH} AS seq, event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind,
    row_number() OVER (PARTITION BY user_id, event_id // {BATCH} ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"""
_TOP = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind FROM events)"
_OVERLAPPING = f"""WITH {_FLUSHED}, g AS (SELECT seq % 3 AS level, seq, min(user_id) AS min, max(user_id) AS max FROM f GROUP BY seq),
p AS (SELECT *, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -seq END NULLS FIRST, min, seq) - 1 AS prec FROM g WHERE max >= 30 AND min < 40)"""

_POSTINGS = r"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS total FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY term"

ORACLE = {
    "resolve_set_bottom": _ALL.format(more=""),
    "range_iter": _ALL.format(more="AND user_id >= 20 AND user_id < 60"),
    "resolve_set_partial": "WITH " + _HISTORY.format(where="") + """,
s AS (SELECT user_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FILTER (WHERE event_type <> 'view') AS a, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FILTER (WHERE event_type = 'view') AS r FROM lastm WHERE rn = 1 GROUP BY user_id),
g AS (SELECT user_id, bool_or(kind = 3) AS ops, bool_or(kind = 1) AS base, bool_or(kind = 2) AS dead FROM live GROUP BY user_id),
k AS (SELECT g.user_id, CASE WHEN NOT ops THEN CASE WHEN base THEN 1 ELSE 2 END WHEN NOT base AND NOT dead THEN 3 WHEN a IS NOT NULL THEN 1 ELSE 2 END AS kind, a, r FROM g LEFT JOIN s USING (user_id))
SELECT user_id, kind, CASE WHEN kind = 2 THEN '' ELSE coalesce(a, '') END AS added, CASE WHEN kind = 3 THEN coalesce(r, '') ELSE '' END AS removed FROM k""",
    "lww_put_delete": f"SELECT user_id, event_id, event_type FROM {_TOP} WHERE rn = 1 AND kind = 1",
    "tombstones_kept": f"SELECT user_id, kind, event_id FROM {_TOP} WHERE rn = 1",
    "merge_all_versions": f"SELECT user_id, event_id, kind, rn - 1 AS prec FROM {_TOP}",
    "merge_runs": f"SELECT user_id, event_id, kind, 2 - event_id % 3 AS prec FROM {_TOP}",
    "seek_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 50",
    "point_get": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42",
    "multi_get": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "locate_large": "SELECT doc_id, octet_length(encode(text)) AS n_bytes, octet_length(encode(text)) >= 4096 AS large FROM documents",
    "flush_batches": f"WITH {_FLUSHED} SELECT user_id, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM f) WHERE rn = 1 AND kind = 1",
    "table_meta": f"WITH {_FLUSHED} SELECT seq, count(*) AS count, count(*) FILTER (WHERE kind = 2) AS deletes, min(user_id) AS min, max(user_id) AS max FROM f GROUP BY seq",
    "files_overlapping": f"{_OVERLAPPING} SELECT level, seq, min, max, prec FROM p",
    "signature": f"{_OVERLAPPING} SELECT sha256(coalesce(string_agg('f' || seq, chr(10) ORDER BY prec), '')) AS signature FROM p",
    "runs_by_space": f"WITH {_FLUSHED} SELECT user_id % 4 AS space, seq, count(*) AS entries, count(*) FILTER (WHERE kind = 2) AS deletes FROM f GROUP BY ALL",
    "compact_then_read": _ALL.format(more=""),
    "tables_read": _ALL.format(more=""),
    "tables_compacted": _ALL.format(more=""),
    "tables_multi_get": _ALL.format(more="AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "get_version": _ALL.format(more="AND user_id = 42"),
    "locate_newest": """SELECT doc_id, octet_length(encode(text)) AS n_bytes, octet_length(encode(text)) >= 4096 AS large, CASE WHEN octet_length(encode(text)) < 4096 THEN octet_length(encode(text)) ELSE 0 END AS inline_bytes
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "merge_order": f"SELECT user_id, event_id, kind, rn - 1 AS prec FROM {_TOP} ORDER BY user_id, prec",
    "holding_tables": f"WITH {_FLUSHED} SELECT seq, count(*) AS count FROM f GROUP BY seq HAVING min(user_id) <= 42 AND max(user_id) >= 42",
    "table_spaces": f"WITH {_FLUSHED} SELECT seq, user_id % 4 AS space, min(user_id) AS min, max(user_id) AS max, count(*) AS count FROM f GROUP BY ALL",
    "receiving_ranges": f"""WITH {_FLUSHED}, g AS (SELECT user_id % 4 AS space, seq, min(user_id) AS min, max(user_id) AS max FROM f GROUP BY ALL)
SELECT space, seq, min AS lo, max AS hi FROM g WHERE seq % 3 = 1 AND EXISTS (SELECT 1 FROM g i WHERE i.space = g.space AND i.seq % 3 = 2 AND i.max >= g.min AND i.min <= g.max)""",
    "edit_errors": f"""WITH {_FLUSHED}, g AS (SELECT greatest(seq % 3, 1) AS level, seq, min(user_id) AS min, max(user_id) AS max FROM f GROUP BY seq)
SELECT seq, level, 'overlap' AS error FROM (SELECT *, max(max) OVER (PARTITION BY level ORDER BY min, max, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) WHERE before >= min""",
    "keyenc_double": """SELECT c_custkey, c_acctbal < 0 AS below, lpad(hex(xor(b, CASE WHEN c_acctbal < 0 THEN 18446744073709551615::UBIGINT ELSE 9223372036854775808::UBIGINT END)), 16, '0') AS key
FROM (SELECT c_custkey, c_acctbal, CAST(CAST(c_acctbal + 0.0::DOUBLE AS BIT) AS UBIGINT) AS b FROM customer)""",
    "keyenc_double_back": "SELECT c_custkey, c_name AS name, c_acctbal + 0.0 AS balance, '07' AS rest, true AS ok FROM customer",
    "fold_sum_partial": """WITH h AS (SELECT user_id, event_id, CASE WHEN event_type IN ('signup','purchase') THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END AS kind FROM events),
t AS (SELECT *, max(CASE WHEN kind <> 3 THEN event_id END) OVER (PARTITION BY user_id) AS term FROM h), l AS (SELECT * FROM t WHERE term IS NULL OR event_id >= term)
SELECT user_id, CASE WHEN bool_and(kind = 3) THEN 3 WHEN bool_or(kind <> 2) THEN 1 ELSE 2 END AS kind, CAST(sum(CASE WHEN kind <> 2 THEN event_id % 100 ELSE 0 END) AS BIGINT) AS value FROM l GROUP BY user_id""",
    "duplicate_key_history": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, n_versions FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_versions,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "keyenc_string": "SELECT c_custkey, hex(encode(c_name)) || '0000' AS key, c_name AS name FROM customer",
    "prefix_end": "SELECT p_partkey, hex(encode(left(p_name, 2) || chr(ascii(substring(p_name, 3, 1)) + 1))) AS upper_bound FROM part",
    "postings_rows": _POSTINGS,
    "postings_coded": _POSTINGS,
    "entry_errors": "SELECT user_id, count(*) AS entries, 0 AS unknown FROM events GROUP BY user_id HAVING count(*) > 1 OR user_id IS NULL",
    "apply_edit": f"WITH {_FLUSHED} SELECT seq, CASE WHEN seq % 5 = 0 THEN 4 ELSE seq % 3 END AS level, count(*) AS count FROM f GROUP BY seq",
    "level_sizes": f"WITH {_FLUSHED} SELECT seq % 3 AS level, count(DISTINCT seq) AS tables, count(*) AS entries, count(*) FILTER (WHERE kind = 2) AS deletes FROM f GROUP BY ALL",
    "touching_tables": f"""WITH {_FLUSHED}, g AS (SELECT seq % 3 AS level, seq, min(user_id) AS min, max(user_id) AS max FROM f WHERE seq % 3 > 0 GROUP BY seq)
SELECT * EXCLUDE (max) FROM (SELECT *, max(max) OVER (PARTITION BY level ORDER BY min, max, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) WHERE before >= min""",
    "job_overlap": f"""WITH {_FLUSHED}, g AS (SELECT user_id % 4 AS space, seq, min(user_id) AS min, max(user_id) AS max FROM f GROUP BY ALL)
SELECT g.space, seq, lo, hi FROM g JOIN (SELECT space, min(min) AS lo, max(max) AS hi FROM g WHERE seq % 3 = 0 GROUP BY space) USING (space) WHERE seq % 3 = 1 AND max >= lo AND min <= hi""",
    "worth_cleaning": f"""WITH {_FLUSHED} SELECT user_id % 4 AS space, count(DISTINCT seq) AS runs, count(*) AS entries, count(*) FILTER (WHERE kind = 2) AS deletes FROM f GROUP BY 1
HAVING count(DISTINCT seq) > 1 AND count(*) FILTER (WHERE kind = 2) > 0 AND count(*) FILTER (WHERE kind = 2) >= 0.2 * count(*) FILTER (WHERE kind <> 2)""",
    "set_union_except": """WITH h AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS m FROM events),
a AS (SELECT DISTINCT user_id, m FROM h WHERE event_type IN ('signup','purchase','click')), r AS (SELECT DISTINCT user_id, m FROM h WHERE event_type = 'view'),
u AS (SELECT user_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS either FROM (SELECT * FROM a UNION SELECT * FROM r) GROUP BY user_id),
x AS (SELECT user_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS only_added FROM (SELECT * FROM a EXCEPT SELECT * FROM r) GROUP BY user_id)
SELECT user_id, coalesce(either, '') AS either, coalesce(only_added, '') AS only_added FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN u USING (user_id) LEFT JOIN x USING (user_id)""",
    "fold_sum": """WITH h AS (SELECT user_id, event_id, CASE WHEN event_type IN ('signup','purchase') THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END AS kind FROM events),
t AS (SELECT *, max(CASE WHEN kind <> 3 THEN event_id END) OVER (PARTITION BY user_id) AS term FROM h), l AS (SELECT * FROM t WHERE term IS NULL OR event_id >= term)
SELECT user_id, CAST(sum(CASE WHEN kind <> 2 THEN event_id % 100 ELSE 0 END) AS BIGINT) AS value FROM l GROUP BY user_id HAVING bool_or(kind <> 2)""",
}

QUERIES = {f.__name__: f for f in (
    resolve_set_bottom, resolve_set_partial, lww_put_delete, tombstones_kept, merge_all_versions, merge_runs, range_iter, seek_page, point_get, multi_get, locate_large, flush_batches, table_meta, files_overlapping,
    signature, runs_by_space, compact_then_read, duplicate_key_history, keyenc_string, keyenc_double, prefix_end, postings_rows, set_union_except, fold_sum,
    tables_read, tables_multi_get, tables_compacted, get_version, locate_newest, merge_order, holding_tables, table_spaces, receiving_ranges, edit_errors, keyenc_double_back, fold_sum_partial, postings_coded, entry_errors, apply_edit, level_sizes, touching_tables, job_overlap, worth_cleaning,
)}
