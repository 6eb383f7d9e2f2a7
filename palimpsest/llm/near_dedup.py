"""Near-duplicate detection: fast similarity sketches, banding, and exact verification on whole shingle sets.

Sketch: t coordinates. In round i < t each shingle is thrown into one bin by a hash of its own; a bin keeps its least (round,
value). Rounds stop when no bin is empty, for most texts after one or two. Rounds t to 2t throw every shingle into bin
i - t, so each coordinate fills whatever the set. Two sets agree in a coordinate with probability equal to their Jaccard
similarity, with concentration as for t independent samples.

Bands: 32 bands of 6 coordinates. A pair of similarity 0.85 is missed by all with probability 3e-7, one of 0.8 with 6e-5; texts
that share a passage and little else (similarity 0.2) meet in a band with probability 6e-5.

Before any text moves, pairs are dropped whose sizes rule out the similarity, or whose sketches do: the lowest bits of all coordinates
agree in a share of (1 + similarity) / 2, and a pair more than six standard deviations below (probability about 1e-9) is no candidate.

Copies (equal sets) collapse to their smallest id first. In each bucket every text is compared with one hub, the smallest, so a bucket of m
copies costs m comparisons. Where a bucket then still has several components, its texts that have a candidate in another one are
compared exactly, in blocks of `block` texts, as are the sketches that say so: each pair of blocks is one group of at most 2 * block rows, whose intersections are one matrix product,
and which returns a forest of the links, never the pairs. So no link is lost to a cap.

Scale: shuffles carry band keys (32 a distinct text), pairs, and the text of documents that are in a pair. A hub's partners are dealt
over salts of about `per_salt` rows, with the hub's text copied to each. The driver sees counts only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import narrow, slices, written
from palimpsest.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 6
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each output bit depends on all input bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: `size` words, A-Z in lower case, or all words where there are fewer."""
    flat = [b" ".join((t or "").encode().lower().split()) for t in texts]
    whole = b"\n".join([*flat, b""])
    data = np.frombuffer(whole, np.uint8)
    up, down = _POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    edge = np.flatnonzero((data == 32) | (data == 10))  # the end of each word
    out, at, first = [], 0, 0
    ends = np.searchsorted(edge, np.cumsum([len(f) + 1 for f in flat]) - 1)  # the edge that ends each text
    for f, last in zip(flat, ends.tolist(), strict=True):
        if not f:
            out.append(np.empty(0, np.uint64))
        else:
            stop = edge[first : last + 1]
            start = np.concatenate([[at], stop[:-1] + 1])
            k = min(size, len(stop))
            s, e = start[: len(start) - k + 1], stop[k - 1 :]
            out.append(np.unique(mix((total[e] - total[s]) * down[s])))
        at += len(f) + 1
        first = last + 1
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each non-empty set; see the module's text."""
    out = np.full((len(sets), t), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate([*sets, np.empty(0, np.uint64)])
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + _U(((i + 1) * _BASE) & (2**64 - 1)))
        place = owner * t + ((h >> _U(40)) % _U(t)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(flat, place, _U(i << 40) | (h & _U((1 << 40) - 1)))
        open_ = (out == _EMPTY).any(axis=1)
        if not open_.all():
            keep = open_[owner]
            owner, x = owner[keep], x[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(_BASE), parts.shape[:2])
    for r in range(rows):
        key = mix(key ^ parts[:, :, r]) * _U(_BASE)
    return key


def low_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, 64 to a word."""
    bits = np.packbits((sketch & _U(1)).astype(np.uint8), axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).copy().view(np.int64)


def most_differing(t: int, percent: int) -> int:
    """The number of differing bits of t that a pair of this similarity has at most, but for six standard deviations."""
    p = (1 + percent / 100) / 2
    return t - int(t * p - 6 * (t * p * (1 - p)) ** 0.5)


def _sketched(size: int, bands: int, rows: int):
    def run(batches):
        for batch in slices(batches, 256):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            drawn = sketches(sets, bands * rows)
            keys, bits = band_keys(drawn, bands, rows).astype(np.int64), low_bits(drawn)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), "bands": keys, "bits": pa.array(bits.tolist(), pa.list_(pa.int64()))})

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(size: int, percent: int):
    def run(batches):
        hub, heads = None, []
        for batch in slices(batches, 128):
            rows = batch.to_pylist()
            out = []
            for row, own in zip(rows, shingle_sets([r["text"] for r in rows], size), strict=True):
                key = (row["hub"], row["salt"])
                if key != hub:
                    hub, heads = key, []
                if row["id"] == row["hub"]:
                    heads.append(own)  # several only if rows repeat an id
                elif any(alike(h, own, percent) for h in heads):
                    out.append((row["id"], row["hub"]))
            yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, size: int, percent: int, per_salt: int) -> DataFrame:
    """Those of the distinct pairs (hub, id) whose whole sets are alike, as (u, v)."""
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts"))
    mine = pairs.groupBy("id").agg(F.collect_set("hub").alias("hubs"))  # bounded by bands and hubs a round
    roles = mine.join(hubs, F.col("id") == F.col("hub"), "full").select(F.coalesce("id", "hub").alias("id"), "hubs", "salts")
    found = texts.join(roles.hint("merge"), F.col("doc_id") == F.col("id")).select("id", "hubs", "salts", F.coalesce("text", F.lit("")).alias("text"))
    as_hub = F.when(F.col("salts").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.col("id").alias("hub"), s.alias("salt"))))
    none = F.array().cast("array<struct<hub: bigint, salt: int>>")
    as_own = F.transform("hubs", lambda h: F.struct(h.alias("hub"), F.lit(None).cast("int").alias("salt")))
    dealt = found.select("id", "text", F.explode(F.concat(F.coalesce(as_hub, none), F.coalesce(as_own, none))).alias("to")).select("id", "text", "to.hub", "to.salt")
    sized = hubs.withColumnRenamed("hub", "of")
    # a partner's salt follows from the hub's size
    own = dealt.filter("salt is null").join(sized, F.col("hub") == F.col("of")).select("hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id", "text")
    heads = dealt.filter("salt is not null").select("hub", "salt", "id", "text")
    ready = heads.unionByName(own).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))
    return ready.mapInArrow(_confirm(size, percent), "u long, v long")


def links(sets: list[np.ndarray], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A forest over the numbers of all sets, with an edge for each two trees that some pair of alike sets joins."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    of, at = of[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(shared.sum()), columns):
        part = slice(*np.searchsorted(at, [low, low + columns]))
        m = np.zeros((len(sets), columns), np.float32)
        m[of[part], at[part] - low] = 1
        both += m @ m.T
    size = np.array([len(x) for x in sets], np.float64)
    root, out = list(range(len(sets))), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None] - both), 1)), strict=True):
        if (p := find(int(x))) != (q := find(int(y))):
            root[q] = p
            out.append((int(x), int(y)))
    return out


def _linked(size: int, percent: int):
    """Rows (key, a, b, id, text) sorted by key and pair of blocks; yields the edges of each group's forest."""

    def run(batches):
        now, ids, texts = None, [], []

        def done():
            found = links(shingle_sets(texts, size), percent) if len(ids) > 1 else []
            pairs = [(ids[x], ids[y]) for x, y in found if ids[x] != ids[y]]
            return pa.RecordBatch.from_pydict({"u": pa.array([max(p) for p in pairs], pa.int64()), "v": pa.array([min(p) for p in pairs], pa.int64())})

        for batch in slices(batches, 128):
            for row in batch.to_pylist():
                group = (row["key"], row["a"], row["b"])
                if group != now:
                    yield done()
                    now, ids, texts = group, [], []
                ids.append(row["id"])
                texts.append(row["text"])
        yield done()

    return run


def in_blocks(texts: DataFrame, members: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Edges (u, v) that join all members (key, id, n) of a key that are alike, n being the key's number of members."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("a"), F.greatest(F.col("own"), o).alias("b"))))
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).select("id", "key", to.alias("to")).groupBy("id").agg(F.collect_list(F.struct("key", "to.a", "to.b")).alias("places"))
    ready = texts.join(dealt.hint("merge"), F.col("doc_id") == F.col("id")).select("id", F.coalesce("text", F.lit("")).alias("text"), F.explode("places").alias("x")).select("x.key", "x.a", "x.b", "id", "text")
    return ready.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "id").mapInArrow(_linked(size, percent), "u long, v long")


def with_candidate(drawn: DataFrame, near, block: int) -> DataFrame:
    """Those (key, id) of drawn (key, id, component, n_id, b_id) for which `near` holds with a row of the same key and another component. A key's
    rows are dealt in blocks, and each pair of blocks is a group of its own; sketches move, not texts."""
    sized = drawn.join(drawn.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "key")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")).withColumn("any", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = sized.select("key", F.col("own").alias("x"), F.col("any").alias("y"), "id", "component", "n_id", "b_id")
    other = sized.select(F.col("key").alias("k"), F.col("any").alias("a"), F.col("own").alias("b"), F.col("component").alias("other"), F.col("n_id").alias("n_hub"), F.col("b_id").alias("b_hub"))
    together = (F.col("key") == F.col("k")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    return mine.join(other, together & (F.col("component") != F.col("other")) & near, "left_semi").select("key", "id").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS, per_salt: int = 64, block: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of shingles (`size` words); component_id
    is the smallest id reachable, and the row of that id is kept. Texts without words, null ones too, have no shingles and are
    linked with nothing. Repeated rows (same id and text) are alike and all kept if their id is. Rows of one id but different
    texts are linked each by its own text. A null id is linked with nothing, has a null component_id and is kept. Ids are integers.
    """
    texts = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = written(texts.mapInArrow(_sketched(size, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"))
    classes = written(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "bits"), "doc_id").alias("x")).select("digest", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.bands").alias("bands"), F.col("x.bits").alias("bits")))
    placed = classes.select("id", F.explode("bands").alias("key"))
    buckets = written(placed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    members = written(placed.join(buckets, "key").filter("id != hub").select("key", "hub", "id", "n"))
    sketch = lambda k: classes.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"b_{k}"))
    differing = sum((F.bit_count(F.get("b_id", w).bitwiseXOR(F.get("b_hub", w))) for w in range(-(-bands * rows // 64))), F.lit(0))
    near = (100 * F.least("n_id", "n_hub") >= percent * F.greatest("n_id", "n_hub")) & (differing <= most_differing(bands * rows, percent))
    pairs = written(members.select("hub", "id").distinct().join(sketch("id"), "id").join(sketch("hub"), "hub").filter(near).select("hub", "id"))
    edges = written(confirmed(texts, pairs, size, percent, per_salt))
    found = written(components(edges))
    left = members.filter("n > 2").select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    left = written(left)
    open_ = left.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key")
    drawn = left.join(open_, "key").join(sketch("id"), "id")
    unsure = with_candidate(written(drawn), near, block)
    unsure = written(unsure)
    if not unsure.isEmpty():
        sized = unsure.join(unsure.groupBy("key").agg(F.count("*").alias("n")), "key")
        edges = written(edges.unionByName(written(in_blocks(texts, sized, size, percent, block))))
        found = written(components(edges))
    label = classes.select("digest", "id").join(found, F.col("id") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("component", "id").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(label, (F.col("digest") == F.col("of")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
