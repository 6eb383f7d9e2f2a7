"""Exact deduplication by composable polynomial fingerprints.

A text, less its white space, is cut into chunks. Each chunk's polynomial hash is a dot product with powers of a base; the
hashes of neighbours combine by length-shifted arithmetic, hash(a + b) = hash(a) * base ** len(b) + hash(b). So texts of more than `huge` bytes
are dealt over tasks chunk by chunk, hashed apart, and their hashes combined in order. Rows of equal fingerprint and length are then compared with one
representative chunk by chunk, so a collision costs time and never a wrong result.

Scale: only rows of about 100 bytes are grouped, with map-side aggregation. Texts move only for rows whose fingerprint is
shared, dealt by (fingerprint, salt) with at most about `per_salt` rows to a salt; the representative is copied to each salt.
Each comparison holds one representative and one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm.common import narrow, slices, written

CHUNK = 1 << 16
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_069)
_BLANK = b" \t\n\v\f\r"


class Polynomial:
    """Hashes of byte strings modulo `prime`, one for each base."""

    def __init__(self, prime: int = PRIME, bases: tuple[int, ...] = BASES, chunk: int = CHUNK):
        self.prime, self.bases, self.chunk = prime, bases, chunk
        self.weights = []
        for base in bases:
            powers = [1]
            for _ in range(chunk - 1):
                powers.append(powers[-1] * base % prime)
            self.weights.append(np.array(powers[::-1], np.uint64))

    def of_chunk(self, chunk: bytes) -> tuple[int, ...]:
        """The hash of at most `chunk` bytes. Each byte counts one more than its value, so that zeros count."""
        x = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int(np.dot(x, w[self.chunk - len(x) :])) % self.prime for w in self.weights)

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
        """The hash of two neighbouring pieces, from their hashes and the length of the second."""
        return tuple((a * pow(base, right_length, self.prime) + b) % self.prime for a, b, base in zip(left, right, self.bases, strict=True))

    def of(self, data: bytes) -> tuple[int, ...]:
        total = (0,) * len(self.bases)
        for at in range(0, len(data), self.chunk):
            piece = data[at : at + self.chunk]
            total = self.combine(total, self.of_chunk(piece), len(piece))
        return total


def _fingerprints(prime: int, bases: tuple[int, ...], id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("n_points", pa.int64()), ("sha", pa.string())])

    def run(batches):
        poly = Polynomial(prime, bases)
        for batch in slices(batches):
            text = pc.fill_null(batch.column("text"), "")
            fp, n_bytes, sha = [], [], []
            for t in text.cast(pa.binary()).to_pylist():
                t = t.translate(None, _BLANK)
                high, low = poly.of(t)
                fp.append(high << 31 | low)
                n_bytes.append(len(t))
                sha.append(hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(n_bytes, pa.int64()), pc.utf8_length(text).cast(pa.int64()), pa.array(sha)], schema=schema)

    return run


def _pieces(batches):
    """Chunks of long texts, as they stand: (row, at, piece)."""
    for batch in slices(batches, 1):
        row, text = batch.column("row")[0], batch.column("text").cast(pa.binary())[0].as_buffer()
        for at in range(0, len(text), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([at], pa.int64()), pa.array([text[at : at + CHUNK].to_pybytes()], pa.binary())], names=["row", "at", "piece"])


def _piece_hashes(prime: int, bases: tuple[int, ...]):
    """Of each chunk, less its white space, the length, the hashes, and what they shift the hashes before them by."""

    def run(batches):
        poly = Polynomial(prime, bases)
        for batch in slices(batches):
            bare = [p.translate(None, _BLANK) for p in batch.column("piece").to_pylist()]
            found = [[pa.array([poly.of(p)[k] for p in bare], pa.int64()), pa.array([pow(bases[k], len(p), prime) for p in bare], pa.int64())] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), pa.array([len(p) for p in bare], pa.int64()), *found[0], *found[1]], names=["row", "at", "n", "h0", "s0", "h1", "s1"])

    return run


def _huge_fingerprints(texts: DataFrame, prime: int, bases: tuple[int, int]) -> DataFrame:
    """As _fingerprints, for long texts: chunks over tasks, combined by their order."""
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    pieces = rows.select("row", "text").mapInArrow(_pieces, "row long, at long, piece binary").repartition("row", "at")
    hashed = pieces.mapInArrow(_piece_hashes(prime, bases), "row long, at long, n long, h0 long, s0 long, h1 long, s1 long")
    chunks = hashed.groupBy("row").agg(F.sum("n").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("at", "h0", "s0", "h1", "s1"))).alias("chunks"))
    whole = lambda k: F.aggregate("chunks", F.lit(0).cast("long"), lambda done, x: (done * x[f"s{k}"] + x[f"h{k}"]) % prime)
    found = chunks.select("row", "n_bytes", F.shiftleft(whole(0), 31).bitwiseOR(whole(1)).alias("fp"))
    bare = F.translate("text", " \t\n\x0b\x0c\r", "")
    sized = rows.select("row", "doc_id", F.char_length("text").cast("long").alias("n_points"), F.sha2(bare, 256).alias("sha"))
    return sized.join(found, "row").select("doc_id", "fp", "n_bytes", "n_points", "sha")


def same(a: bytes, b: bytes, chunk: int = CHUNK) -> bool:
    """Whether two byte strings are equal, compared a chunk at a time; the first difference ends it."""
    left, right = memoryview(a), memoryview(b)
    return len(a) == len(b) and all(left[at : at + chunk] == right[at : at + chunk] for at in range(0, len(a), chunk))


def _compare(batches):
    """Rows sorted by (fp, n_bytes, salt), the representative first. Yields the rows that differ from it."""
    key, head = None, b""
    for batch in slices(batches):
        out = []
        for row in batch.to_pylist():
            text, now = row["text"].encode().translate(None, _BLANK), (row["fp"], row["n_bytes"], row["salt"])
            if now != key:
                key, head = now, text
            elif not same(head, text):
                out.append((row["doc_id"], row["sha"]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("doc_id").type), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "sha"])


def _differing(texts: DataFrame, rows: DataFrame, per_salt: int) -> DataFrame:
    """Rows (doc_id, sha) of shared fingerprint whose text isn't their representative's."""
    key = ["fp", "n_bytes"]
    shared = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("sha", F.col("doc_id").isNull(), "doc_id")).alias("head")).filter("n > 1")
    # the representative is a text, by digest: all of its copies may stand first in their salt
    shared = shared.select(*key, F.ceil(F.col("n") / per_salt).cast("int").alias("salts"), F.col("head.sha").alias("head_sha"), F.col("head.doc_id").alias("head_id"))
    wanted = rows.join(shared, key).select("doc_id", "sha", *key, "salts", (F.col("head_id").eqNullSafe(F.col("doc_id")) & (F.col("head_sha") == F.col("sha"))).alias("is_head"))
    wanted = wanted.distinct().withColumnRenamed("doc_id", "id")
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]", "")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).filter(F.sha2(blank, 256) == F.col("sha"))
    own = F.array(F.pmod(F.xxhash64("doc_id", "sha"), F.col("salts")).cast("int"))
    dealt = found.select("doc_id", "sha", *key, F.coalesce("text", F.lit("")).alias("text"), "is_head", F.explode(F.when(F.col("is_head"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)).alias("salt"))
    return dealt.repartition(*key, "salt").sortWithinPartitions(*key, "salt", F.desc("is_head")).select(*key, "salt", "doc_id", "sha", "text").mapInArrow(_compare, f"doc_id {dict(texts.dtypes)['doc_id']}, sha string")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prime: int = PRIME, bases: tuple[int, int] = BASES, per_salt: int = 64, huge: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without `[\\x20\\x09-\\x0D]`. Of equal texts the one of most code points stays, then the
    smallest id. A null text counts as empty, and empty texts equal one another. A null id loses every tie. Repeated rows (same id
    and text) each get a row and all have kept alike; several rows of one id are judged each by its own text. An empty table
    gives an empty result. Ids are of any type that has an order. Other columns are ignored.
    """
    texts = narrow(docs, id_col, text_col)
    is_huge = F.coalesce(F.octet_length("text") > huge, F.lit(False))
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)
    usual = texts.filter(~is_huge).mapInArrow(_fingerprints(prime, bases, id_type), f"doc_id {dict(texts.dtypes)['doc_id']}, fp long, n_bytes long, n_points long, sha string")
    rows = written(usual.unionByName(_huge_fingerprints(texts.filter(is_huge), prime, bases))).withColumn("round", F.lit(0))
    unsure, n = rows, 0
    while not (wrong := written(_differing(texts, unsure.drop("round"), per_salt))).isEmpty():
        n += 1  # fingerprints have collided: what differs from its representative gets one of its own
        wrong = wrong.distinct().select(F.col("doc_id").alias("id"), F.col("sha").alias("other"))
        rows = written(rows.join(wrong, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("other")), "left").withColumn("round", F.when(F.col("other").isNotNull(), n).otherwise(F.col("round"))).drop("id", "other"))
        unsure = rows.filter(F.col("round") == n)
    key = ["fp", "n_bytes", "round"]
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = rows.groupBy(key).agg(F.count("*").alias("group_size"), best.alias("best"))
    return rows.join(groups, key).select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_points") == -F.col("best.n"))).alias("kept"), F.col("sha").alias("text_sha256"))
