"""Each query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(catalog.ORACLE[name]).df())


def test_queries_take_all_events(spark):
    whole = rows(catalog.QUERIES["resolve_set_bottom"](spark, DATA).toPandas())
    for name in ("compact_then_read", "tables_read", "tables_compacted"):
        assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == whole, name


def test_double_keys_sort_as_the_numbers(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions.keys import encode_double

    values = [float("-inf"), -1e308, -2.5, -5e-324, 0.0, 5e-324, 1.0, 2.5, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("key", encode_double(F.col("x")))
    assert [r.x for r in df.orderBy("key").collect()] == values


def test_resolve_truth_table(spark):
    from palimpsest.operators.versions import DELETE, MERGE, PUT, resolve_sets

    put, gone = (lambda *a: (PUT, list(a), [])), (DELETE, [], [])
    op = lambda add=(), rem=(): (MERGE, list(add), list(rem))
    cases = [
        ([put(1), put(2)], False, (PUT, [1], [])), ([gone, put(2)], False, (DELETE, [], [])), ([gone, put(2)], True, None), ([op([3]), op((), [1]), put(1, 2)], False, (PUT, [2, 3], [])),
        ([op([3]), gone, put(1, 2)], False, (PUT, [3], [])), ([op((), [1]), gone, put(1)], False, (DELETE, [], [])), ([op((), [1]), gone], True, None), ([op([3]), op((), [100])], False, (MERGE, [3], [100])),
        ([op([3]), op((), [100])], True, (PUT, [3], [])), ([op((), [1]), put(1)], False, (DELETE, [], [])),
    ]
    data = [(k, p, *v) for k, (stack, _, _) in enumerate(cases) for p, v in enumerate(stack)]
    df = spark.createDataFrame(data, "key int, prec int, kind int, add array<bigint>, rem array<bigint>")
    got = {b: {r["key"]: (r["kind"], list(r["add"]), list(r["rem"])) for r in resolve_sets(df, bottom=b).collect()} for b in (False, True)}
    for k, (_, bottom, want) in enumerate(cases):
        assert got[bottom].get(k) == want, k


def test_hot_keys_are_not_gathered(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from palimpsest.operators import versions

    monkeypatch.setattr(versions, "DEALT", 16)
    e = spark.range(600).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 41 > 0, F.col("id") % 7 + 2).alias("user_id"), F.col("id").alias("event_id"))
    e = e.withColumn("event_type", F.when(F.col("event_id") % 97 == 5, "error").when(F.col("event_id") == 100, "purchase").when(F.col("event_id") % 5 == 0, "view").otherwise("click")).withColumn("props", F.concat(F.lit('{"k": '), F.col("event_id") % 9, F.lit("}")))
    e.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("fold_sum", "set_union_except"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "flatten" not in plan and (name != "fold_sum" or "collect_list" not in plan and "Window" not in plan)
        want = [tuple(map(str, r)) for r in c.sql(catalog.ORACLE[name]).fetchall()]
        assert sorted(tuple(map(str, r)) for r in got.filter("user_id is not null").collect()) == sorted(r for r in want if r[0] != "None"), name
    v = e.select("user_id", (-F.col("event_id")).alias("prec"), F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(3).alias("kind"), F.col("event_id").alias("value"))
    assert versions.live_dealt(v, "user_id").select("_deal").distinct().count() > 1
    for bottom in (False, True):
        one = versions.resolve_with(v, lambda b, x: F.aggregate(x, F.coalesce(b, F.lit(0).cast("long")), lambda s, y: s + y), "long", "user_id", bottom=bottom)
        two = versions.resolve_with(v, lambda b, x: F.coalesce(b, F.lit(0).cast("long")) + x, "long", "user_id", bottom=bottom, partial=F.sum)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_flush_and_read_back(spark, tmp_path):
    from palimpsest.operators.versions import last_writer, merge_runs
    from palimpsest.sources.tables import flush, read

    old = spark.createDataFrame([(b"a", 1, "1"), (b"b", 1, "2")], "key binary, kind int, value string")
    new = spark.createDataFrame([(b"a", 2, ""), (b"c", 1, "3")], "key binary, kind int, value string")
    flush(old, f"{tmp_path}/1")
    flush(new, f"{tmp_path}/2")
    got = last_writer(merge_runs(read(spark, f"{tmp_path}/2", f"{tmp_path}/1")), bottom=True)
    assert sorted((bytes(r["key"]), r["value"]) for r in got.collect()) == [(b"b", "2"), (b"c", "3")]
    with pytest.raises(Exception, match="BAD_ENTRY"):
        flush(old.union(old), f"{tmp_path}/3")


def test_flush_rejects_what_no_table_holds(spark, tmp_path):
    from palimpsest.sources.tables import flush

    schema = "key binary, kind int, value binary"
    for k, (data, text) in enumerate([([(None, 1, b"")], "there"), ([(b"", 1, b"")], "empty"), ([(b"a", 9, b"")], "kind"), ([(b"a", None, b"")], "kind"), ([(b"a", 1, b"x"), (b"b", 1, b"y"), (b"a", 2, b"z")], "once each"), ([(b"a", 1, bytes((64 << 20) + 1))], "too large")]):
        with pytest.raises(Exception, match=f"BAD_ENTRY.*{text}"):
            flush(spark.createDataFrame(data, schema), f"{tmp_path}/{k}")
    flush(spark.createDataFrame([], schema), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0
    plan = spark.range(10).withColumn("kind", __import__("pyspark").sql.functions.lit(1))
    flush(plan.repartition(3), f"{tmp_path}/sorted", "id", partitions=2)
    assert sum(1 for _ in Path(f"{tmp_path}/sorted").glob("*.parquet")) == 2
    from palimpsest.sources.tables import placements

    found = placements(spark.read.parquet(f"{tmp_path}/sorted"), "id").collect()
    by_file = {f: [r["id"] for r in sorted(found, key=lambda r: r["row"]) if r["file"] == f] for f in {r["file"] for r in found}}
    assert len(found) == 10 and all(v == sorted(v) for v in by_file.values())


def test_stream_flushes_each_batch_once(spark, tmp_path):
    from palimpsest.operators.versions import last_writer, merge_runs
    from palimpsest.sources.tables import read
    from palimpsest.streaming.ingest import flush_batches

    source, out = tmp_path / "in", tmp_path / "out"
    schema = "key long, seq long, kind int, value string"
    spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (2, 3, 1, "c")], schema).coalesce(1).write.parquet(str(source))
    half = out / f"seq={0:020d}"
    half.mkdir(parents=True)  # a first attempt that wrote no more than this
    (half / "part-00000-half.parquet").write_bytes(b"half")
    run = lambda checkpoint: flush_batches(spark.readStream.schema(schema).parquet(str(source)), str(out), str(tmp_path / checkpoint)).awaitTermination()
    run("first")
    spark.createDataFrame([(2, 4, 2, "")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run("first")
    want = [(1, "b")]
    for _ in range(2):
        found = last_writer(merge_runs(read(spark, *(str(p) for p in sorted(out.iterdir(), reverse=True)))), bottom=True)
        assert sorted((r["key"], r["value"]) for r in found.collect()) == want
        (tmp_path / "first" / "commits" / "1").unlink()  # the last batch is not known to be over: it is tried again
        for crc in (tmp_path / "first" / "commits").glob(".1.crc"):
            crc.unlink()
        run("first")


def test_keys_of_several_parts(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import keys

    texts = [b"", b"a", b"a\0", b"a\0b", b"a\0\0", b"\0", b"\xff", b"ab", b"a\x01", b"\0\xff", b"\x0f\xf0\0"]
    df = spark.createDataFrame([(t, float(k) - 3.5) for k, t in enumerate(texts)], "s binary, x double")
    df = df.withColumn("key", F.concat(keys.encode_string(F.col("s")), keys.encode_double(F.col("x")), keys.encode_string(F.col("s"))))
    df = df.withColumn("a", keys.split_string(F.col("key"))).withColumn("b", keys.split_double(F.col("a.rest"))).withColumn("c", keys.split_string(F.col("b.rest")))
    for r in df.collect():
        assert r.a.ok and r.b.ok and r.c.ok and r.a.value == r.s == r.c.value and r.b.value == r.x and r.c.rest == b"", r
    bad = spark.createDataFrame([(b"",), (b"a",), (b"a\0",), (b"a\0\x01\0\0",), (b"\0\xff",), (None,)], "s binary")
    for r in bad.select("s", keys.split_string(F.col("s")).alias("a"), keys.split_double(F.col("s")).alias("b")).collect():
        assert (r.a is None and r.b is None) if r.s is None else not r.a.ok and r.a.value is None and (r.b.ok == (len(r.s) >= 8)), r
    for x in (float("-inf"), -1.5, -5e-324, 0.0, 5e-324, 1e308, float("inf")):
        got = spark.range(1).select(keys.split_double(keys.encode_double(F.lit(x))).alias("b")).first().b
        assert got.value == x and got.ok
    with pytest.raises(Exception, match="NaN"):
        spark.range(1).select(keys.encode_double(F.lit(float("nan")))).collect()


def test_metadata_of_tables(spark):
    from palimpsest.operators import files

    meta = spark.createDataFrame([("f", 1, "c", "e")], "name string, level int, min string, max string")
    for lo, hi, want in (("a", "c", 0), ("a", "d", 1), ("e", None, 1), ("f", None, 0), (None, "c", 0), (None, None, 1)):
        assert meta.filter(files.overlaps(lo, hi)).count() == want
    assert [meta.filter(files.holds(k)).count() for k in "bcef"] == [0, 1, 1, 0]
    inputs = spark.createDataFrame([(0, "c", "e"), (0, "k", "m"), (1, "a", "z")], "space int, min string, max string")
    ranges = spark.createDataFrame([(0, "f", "h"), (0, "a", "c"), (0, "e", "f"), (0, "m", None), (0, None, None), (2, "a", "z")], "space int, lo string, hi string")
    meets = lambda incl: {(r.space, r.lo, r.hi) for r in files.receives(ranges, inputs, inclusive=incl).collect()}
    assert meets(False) == {(0, "e", "f"), (0, "m", None), (0, None, None)} and meets(True) == meets(False) | {(0, "a", "c")}
    bad = spark.createDataFrame([("g", 1, "e", "g"), ("h", 1, None, None)], meta.schema)
    assert sorted((r.name, r.error) for r in files.edit_errors(meta, meta.limit(0), bad).collect()) == [("g", "overlap"), ("h", "no key range")]
    assert files.edit_errors(meta, meta, bad.filter("name = 'g'")).collect() == []
    with pytest.raises(Exception, match="BAD_EDIT"):
        files.apply_edit(meta, meta.limit(0), bad).collect()


def test_reads_that_need_a_merge_function(spark):
    from palimpsest.operators import reads, versions

    v = spark.createDataFrame([("a", 0, 1, "x" * 10), ("b", 0, 2, None), ("b", 1, 1, "y"), ("c", 0, 1, "z"), ("c", 1, 3, "m")], "key string, prec int, kind int, value string")
    got = {r["key"]: (r["n_bytes"], r["large"], r["value"]) for r in reads.locate_newest(v, "value", least=5).collect()}
    assert got == {"a": (10, True, None), "c": (1, False, "z")}
    merge = spark.createDataFrame([("a", 0, 3, "x")], v.schema)
    with pytest.raises(Exception, match="CORRUPT"):
        reads.locate_newest(merge, "value").collect()
    with pytest.raises(Exception, match="NO_MERGER"):
        versions.last_writer(merge, bottom=True).collect()


def test_a_million_versions_of_one_key(spark):
    from pyspark.sql import functions as F

    from palimpsest.operators.versions import MERGE, resolve_sets

    none = F.array().cast("array<bigint>")
    v = spark.range(1_000_000).select(F.lit(1).alias("key"), F.col("id").alias("prec"), F.when(F.col("id") == 999_000, 1).otherwise(MERGE).alias("kind"), F.array(F.col("id") % 50).alias("add"), F.when(F.col("id") < 10, F.array(F.col("id") % 50 + 1)).otherwise(none).alias("rem"))
    got = resolve_sets(v, bottom=True)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["kind"], sorted(r["add"])) for r in got.collect()] == [(1, [0, *range(11, 50)])]  # what one version adds the next newer one takes away, ten times


def test_posting_lists_as_bytes():
    from decimal import Decimal

    import pyarrow as pa

    from palimpsest.functions import postings

    encode_list = lambda rows: postings.encode_lists(pa.array([None if rows is None else [{"docnum": Decimal(d), "weight": w} for d, w in rows]], postings._LISTS)).to_pylist()[0]

    def decode_list(data):
        got = postings.decode_lists(pa.array([data, b"\x01\x00"], pa.binary())).to_pylist()[0]
        return None if got is None else [(r["docnum"], r["weight"]) for r in got]

    assert encode_list([(3, 4), (131, 5)]) == bytes([1, 2, 3, 4, 128, 1, 5])
    for rows in ([], [(2**64 - 1, 2**32 - 1)], [(9, 1), (2, 7), (2, 7)], None):
        assert decode_list(encode_list(rows)) == rows
    for bad in (b"", b"\x01", b"\x02\x00", b"\x01\x01\x03", b"\x01\x00\x00", b"\x01\x01\x03\x84"):
        with pytest.raises(ValueError, match="CORRUPT"):
            decode_list(bad)


def test_posting_lists_are_coded_before_they_are_shuffled(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from palimpsest.functions.postings import coded, decode, postings

    texts = [(3, "a B\x0bb\n"), (3, " b c "), (70_000, "B"), (70_000, None), (5, ""), (2**40, "É é a")]
    docs = spark.createDataFrame(texts, "id long, body string").repartition(3)
    want = Counter((w, d) for d, t in texts for w in (t or "").lower().split())
    rows = postings(docs, "id", "body").collect()
    assert sorted((r.term, r.docnum, r.weight) for r in rows) == sorted((*k, n) for k, n in want.items())
    lists = coded(docs, "id", "body").withColumn("list", decode(F.col("data"))).collect()
    assert all([x["docnum"] for x in r["list"]] == sorted({x["docnum"] for x in r["list"]}) and {int(x["docnum"]) >> 16 for x in r["list"]} == {r.block} for r in lists)
    assert {(r.term, int(x["docnum"])): x["weight"] for r in lists for x in r["list"]} == want
    assert coded(docs.limit(0), "id", "body").collect() == []
    plan = catalog.postings_coded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "docnum" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)  # no row a posting is shuffled
