"""Line deduplication with DataFrame functions only: first occurrences by range partition and secondary sort.

A line's key, after trimming and lower-casing, goes by two 64-bit hashes of different seeds; keys of equal hashes count as equal (of a
trillion lines some pair is confused with probability 1e-15). Rows (hashes, document, position), one a line, are written once, partitioned by range of hash and
sorted by document and position; the first document of each key is streamed off, and what other documents have of it is lost.
No text moves: what comes out is, for each document that loses lines, its keep bitmap as runs of dropped lines.

Scale: keys are counted first, with partial counts before the shuffle. A key with more than `per_group` lines is dealt over salts of
about as many lines each, by document; the first document of each salt is streamed off as for any key, and only the lines of these
firsts, one document a salt, are compared again. The rest of such a key is lost already, and no other key has a second pass.
Positions of one document are the only thing gathered, bounded by its number of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import narrow, written

MIN_POINTS = 10


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_points: int = MIN_POINTS, per_group: int = 1 << 12) -> DataFrame:
    """One row per text that loses lines: doc_id, digest, n_dropped, runs (the keep bitmap, run-length coded: first dropped line and length).

    Lines are split at \\n. A key of at least `min_points` code points loses all its lines in every document but the one of
    smallest id. Repeated rows of an id are one document: no row of it takes a line from another. Rows are told apart by id and
    digest of the text (xxhash64). A null id is one document, after all others. Null and empty texts are one empty line,
    never dropped.
    """
    texts = narrow(docs, id_col, text_col).filter("text is not null")
    trimmed = F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))
    # lower() would also change letters beyond ASCII: where there are any, A-Z are translated
    key = F.when(F.octet_length(trimmed) == F.char_length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lines = texts.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("doc_id", "digest", "pos", key.alias("key"))
    rows = written(lines.filter(F.char_length("key") >= min_points).select("doc_id", "digest", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2")))
    hot = rows.groupBy("h", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > per_group).select("h", "h2", F.ceil(F.col("n") / per_group).cast("int").alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"), F.lit(-1))  # -1: the key is in one piece
    dealt = rows.join(written(hot), ["h", "h2"], "left").withColumn("salt", salt).drop("salts").repartitionByRange(_partitions(rows), "h", "salt")
    order = Window.partitionBy("h", "h2", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    apart = written(dealt.withColumn("first", F.col("doc_id").eqNullSafe(F.first("doc_id").over(order))).filter("salt >= 0 or not first"))
    # firsts of a salt: all but those of the key's first document are lost too
    firsts = apart.filter("salt >= 0 and first")
    place = lambda: F.struct(F.col("doc_id").isNull(), "doc_id")
    least = firsts.groupBy("h", "h2").agg(F.min(place()).alias("least"))
    late = firsts.join(least, ["h", "h2"]).filter(place() != F.col("least"))
    lost = apart.filter("not first").select("doc_id", "digest", "pos").unionByName(late.select("doc_id", "digest", "pos"))
    drops = lost.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    return drops.select("doc_id", "digest", F.size("at").cast("long").alias("n_dropped"), F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("runs"))


def apply_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, names: tuple[str, str] = ("n_lines", "n_dropped"), **options) -> DataFrame:
    """docs with text_col less its dropped lines, and two columns of the given names: lines before, and lines dropped.

    Every row and column stays; null texts stay null and count one line. Only the two names may not be columns of docs.
    """
    drops = dropped_lines(docs, id_col, text_col, **options).select(F.col("doc_id").alias("__pal_id"), F.col("digest").alias("__pal_digest"), F.col("n_dropped").alias("__pal_dropped"), F.col("runs").alias("__pal_runs"))
    text = F.col(f"`{text_col}`")
    both = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__pal_id")) & (F.xxhash64(text) == F.col("__pal_digest")), "left")
    lines = _lines(text)
    gone = F.flatten(F.transform("__pal_runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")
    both = both.withColumns({names[0]: F.size(lines).cast("long"), names[1]: F.coalesce("__pal_dropped", F.lit(0)).cast("long")})
    return both.withColumn(text_col, F.when(F.col("__pal_runs").isNotNull(), kept).otherwise(text)).drop("__pal_id", "__pal_digest", "__pal_dropped", "__pal_runs")
