"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of each text.

Normalised text: A-Z in lower case, words of letters, digits and everything beyond ASCII, joined by single spaces. Since
every other ASCII byte separates words, byte tables do this at C speed and a word's number leads back to its place in
the original.

Scale: documents never move. The patterns, not the documents, are broadcast, in blocks of at most `block_bytes` of pattern
text; a larger benchmark makes more blocks, each a pass over the documents, whose counts are then joined by a shuffle of hits only. The driver
holds one partition of patterns and one block at a time.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import narrow, slices, written

WINDOW = 10
#: Bytes that separate words become spaces and A-Z become lower case; all others stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """The runs of `size` words of an item, or all its words where it has fewer, each between spaces; as Latin-1, a character a byte."""
    w = words(text)
    return {(b" " + b" ".join(w[i : i + size]) + b" ").decode("latin-1") for i in range(max(1, len(w) - size + 1))} if w else set()


def automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for text, items in patterns:
        a.add_word(text, (text.count(" ") - 1, items))
    a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, the merged runs of words [first, last) inside any occurrence, and the items whose windows occur."""
    w = words(text)
    flat = (b" " + b" ".join(w) + b" ").decode("latin-1") if w else ""
    found = list(a.iter(flat)) if flat else []
    if not found:
        return len(w), [], set()
    spaces = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in found])
    runs, items = [], set()
    for first, last in sorted((int(e) - n, int(e)) for e, (_, (n, _)) in zip(ends, found, strict=True)):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    for _, (_, ids) in found:
        items.update(ids)
    return len(w), runs, items


def _scanner(patterns):
    def run(batches):
        a = automaton(patterns.value)
        for batch in slices(batches):
            n_words, n_hit, items, spans = [], [], [], []
            for t in batch.column("text").to_pylist():
                n, runs, ids = scan(a, t) if len(a) else (len(words(t)), [], set())
                n_words.append(n)
                n_hit.append(sum(b - a_ for a_, b in runs))
                items.append(sorted(ids))
                places = [m.span() for m in _WORD.finditer(t)] if runs else []
                spans.append([{"start": places[x][0], "end": places[y - 1][1], "first": x, "last": y} for x, y in runs])
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, _SPANS)}
            if "sha" in batch.schema.names:
                columns["sha"] = batch.column("sha")
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _blocks(items: DataFrame, size: int, block_bytes: int):
    """The distinct windows with their items, brought to the driver a block at a time."""
    block, used, any_ = [], 0, False
    schema = "pattern string, item string"

    def run(batches):
        for batch in slices(batches):
            rows = [(p, i) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if i is not None for p in windows(t, size)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.string())], names=["pattern", "item"])

    found = items.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(run, schema).groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
    for row in found.toLocalIterator():
        block.append((row["pattern"], list(row["items"])))
        used += len(row["pattern"]) + sum(map(len, row["items"]))
        if used >= block_bytes:
            yield block
            block, used, any_ = [], 0, True
    if block or not any_:
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted ids as strings), spans (code points and words of hit runs).

    A null or empty text has no words and is hit by nothing; an item without words has no window, and an item without id is
    ignored. Rows of one item id together make one item. Repeated documents each get a row. Without items nothing is hit.
    """
    texts, out = narrow(docs, id_col, text_col), None
    sc = docs.sparkSession.sparkContext
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long, first: long, last: long>>"
    blocks = [sc.broadcast(b) for b in _blocks(narrow(items, item_col, item_text), window, block_bytes)]
    if len(blocks) == 1:
        return texts.mapInArrow(_scanner(blocks[0]), schema)
    # Many blocks: each scans the documents; only rows that are hit move, keyed by id and digest of the text.
    texts = texts.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    for patterns in blocks:
        part = texts.mapInArrow(_scanner(patterns), f"{schema}, sha string").filter("n_hit > 0")
        out = part if out is None else out.unionByName(part)
    rows = texts.mapInArrow(_scanner(sc.broadcast([])), f"{schema}, sha string").select("doc_id", "n_words", F.col("sha").alias("own"))
    hits = _merged(out).withColumnRenamed("doc_id", "id")
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")), "left")
    empty = {"items": F.array().cast("array<string>"), "spans": F.array().cast(dict(hits.dtypes)["spans"])}
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, v).alias(c) for c, v in empty.items()))


def _merged(parts: DataFrame) -> DataFrame:
    """The union of runs and items that several automata found in a text."""
    key = ["doc_id", "sha"]
    runs = F.array_sort(F.flatten(F.collect_set("spans")), lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(a["last"] - b["last"]).cast("int"))
    both = parts.groupBy(key).agg(runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def add(done, x):
        top = F.element_at(done, -1)
        grown = F.struct(top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"), top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (x["first"] <= F.get(done, F.size(done) - 1)["last"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    none = F.array().cast("array<struct<start: long, end: long, first: long, last: long>>")
    both = both.withColumn("spans", F.aggregate("runs", none, add)).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"]))
    return both.select(*key, "n_hit", "items", "spans")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, block_bytes: int = 2 << 20) -> DataFrame:
    """docs without the rows whose text holds a window of an item; all columns stay, and so do null and empty texts."""

    def keeper(patterns):
        def run(batches):
            a = automaton(patterns.value)
            for batch in slices(batches):
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not (len(a) and scan(a, t)[1]) for t in texts], pa.bool_()))

        return run

    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(narrow(items, item_col, item_text), window, block_bytes)]
    for k, patterns in enumerate(blocks):
        docs = docs.mapInArrow(keeper(patterns), docs.schema)
        docs = written(docs) if k + 1 < len(blocks) else docs
    return docs
