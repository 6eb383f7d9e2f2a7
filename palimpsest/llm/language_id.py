"""Language identification by a byte convolutional network, trained and run in numpy.

Network: byte embedding, filters of widths 2, 3 and 4, maximum over each window of `WINDOW` bytes, softmax. A text is cut
into fixed-length windows, all of them are scored in batches, and their probabilities are averaged by length.

The network is fitted on the driver on a bounded sample of labelled rows: for each language one excerpt from each of
`per_language` hash buckets of its documents, found by one aggregation with map-side minima. The bound is a parameter and
holds for the fit alone. Prediction is narrow, no shuffle, whole texts, a few MB of windows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fold_of, slices

WINDOW, EMBED, FILTERS, WIDTHS = 192, 6, 12, (2, 3, 4)
_SPAN = max(WIDTHS)


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # (_SPAN * EMBED) x filters
    bias: np.ndarray
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """For each place of each window the embeddings of _SPAN bytes, side by side."""
        e = self.embedding[codes].reshape(len(codes), -1)
        n = codes.shape[1] - _SPAN + 1
        view = np.lib.stride_tricks.as_strided(e, (len(e), n, _SPAN * EMBED), (e.strides[0], EMBED * e.strides[1], e.strides[1]))
        return np.ascontiguousarray(view)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        x = self.columns(codes)
        z = (x.reshape(-1, x.shape[2]) @ self.kernel).reshape(len(codes), x.shape[1], -1)
        return softmax(np.maximum(z.max(axis=1) + self.bias, 0) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (ASCII in lower case) as codes padded by zeros, with the text's number and the window's length."""
    data = [t.encode().lower() for t in texts]
    counts = [-(-len(d) // WINDOW) for d in data]
    flat = np.frombuffer(b"".join(d.ljust(n * WINDOW, b"\0") for d, n in zip(data, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
    codes = np.zeros((len(flat), WINDOW + _SPAN - 1), np.uint8)
    codes[:, :WINDOW] = flat
    owner = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts) - 1
    lengths = np.full(len(flat), WINDOW)
    lengths[last] = [len(d) - (n - 1) * WINDOW for d, n in zip(data, counts, strict=True)]
    return codes, owner, lengths


def fit(texts: list[str], labels: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows; the same rows in any order give the same network."""
    pairs = sorted({(t, y) for t, y in zip(texts, labels, strict=True) if t})
    names = sorted({y for _, y in pairs})
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(_SPAN) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    weights = [rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (_SPAN * EMBED, f)) * mask, np.zeros(f), rng.normal(0, 0.2, (f, len(names))), np.zeros(len(names))]
    weights = [w.astype(np.float32) for w in weights]
    net = Network(names, *weights)
    if len(names) < 2:
        return net
    codes, owner, _ = windows([t for t, _ in pairs])
    y = np.array([names.index(pairs[o][1]) for o in owner])
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    share = len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1))  # languages count alike
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            x = net.columns(codes[rows])
            z = (x.reshape(-1, x.shape[2]) @ net.kernel).reshape(len(rows), x.shape[1], f)
            top = z.argmax(axis=1)
            m = np.take_along_axis(z, top[:, None], 1)[:, 0] + net.bias
            h = np.maximum(m, 0)
            p = softmax(h @ net.out + net.out_bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (share[y[rows]] / len(rows))[:, None]
            dm = ((p @ net.out.T) * (m > 0)).astype(np.float32)
            picked = x[np.arange(len(rows))[:, None], top]  # rows x filters x span
            dx = dm[:, :, None] * net.kernel.T[None]
            de = np.zeros_like(net.embedding)
            for j in range(_SPAN):
                at = np.take_along_axis(codes[rows], top + j, 1)
                np.add.at(de, at.reshape(-1), dx[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
            grads = [de, np.einsum("bf,bfs->sf", dm, picked) * mask, dm.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for w, g, a, b in zip(weights, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network | None, texts: list[str | None], rows: int = 96) -> list[tuple[str, float, float]]:
    """For each text the most probable label, its probability, and how certain its windows are of whichever label each is in: the mean of
    their largest probabilities, which a text in several languages has high too. ("und", 0.0, 0.0) for a text that is null or has no letter."""
    at = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    out = [("und", 0.0, 0.0)] * len(texts)
    if not at or not net or not net.labels:
        return out
    codes, owner, lengths = windows([texts[k] for k in at])
    p = np.concatenate([net.probabilities(codes[k : k + rows]) for k in range(0, len(codes), rows)]) * lengths[:, None]
    first = np.searchsorted(owner, np.arange(len(at)))
    total, certain = np.add.reduceat(p, first, axis=0), np.add.reduceat(p.max(axis=1), first)
    size = total.sum(axis=1)
    for k, best, row, most, n in zip(at, total.argmax(axis=1), total, certain, size, strict=True):
        out[k] = (net.labels[best], min(1.0, float(row[best] / n)), min(1.0, float(most / n)))
    return out


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, excerpt: int):
    """At most per_language excerpts of at most `excerpt` characters for each label, each from a place that the id's hash picks."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = rows.filter("label is not null and text is not null and text != ''")
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    start = F.pmod(h, F.greatest(F.lit(1), F.char_length("text") - excerpt)).cast("int") + 1
    picked = rows.select("label", F.pmod(h, F.lit(per_language)).alias("bucket"), F.xxhash64(F.col("doc_id").cast("string")).alias("order"), F.substring("text", start, F.lit(excerpt)).alias("excerpt"))
    return picked.groupBy("label", "bucket").agg(F.min(F.struct("order", "excerpt")).alias("x")).select("label", "x.excerpt")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *, per_language: int = 256, excerpt: int = 768) -> Network | None:
    """The network of the labelled rows of docs, or None where there are none. Null labels and texts are left out. The sample's bounds are
    `per_language` rows of each label and `excerpt` characters of each; they hold for fitting alone."""
    rows = labelled_sample(docs, id_col, text_col, label_col, per_language, excerpt).collect()
    return fit([r["excerpt"] for r in rows], [r["label"] for r in rows]) if rows else None


def languages(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", *, keep: bool = False, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """One row per row of docs: doc_id, and under `names` the label, its probability and, by a third name, how certain the text's windows are
    (with keep, all columns of docs and these).

    A text that is null or has no letter is `und` with score 0, as is every text if there was nothing to learn from. Only the text
    decides. Repeated rows each get a row. With keep, docs must not have columns of these names.
    """
    rows = docs if keep else docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    name = text_col if keep else "text"
    drop = set() if keep else {"text"}

    def run(batches):
        for batch in slices(batches, 256):
            got = predict(net, batch.column(name).to_pylist())
            columns = {c: batch.column(c) for c in batch.schema.names if c not in drop}
            yield pa.RecordBatch.from_pydict(columns | {n: pa.array([g[k] for g in got], pa.float64() if k else pa.string()) for k, n in enumerate(names)})

    schema = rows.drop(*drop).schema
    for k, n in enumerate(names):
        schema = schema.add(n, "double" if k else "string")
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return fold_of(id_col, 3) == 1
