"""Posting lists: (term, docnum, weight) rows, and the same gathered to one sorted array a term and block of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices

#: First byte of a coded list (fixed value).
VERSION = 1
_LISTS = pa.list_(pa.struct([("docnum", pa.decimal128(20, 0)), ("weight", pa.int64())]))


def _counted(batch: pa.RecordBatch, doc: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch's texts, and (word, doc, weight) by word and doc as places in them and numbers; doc has one number a text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
    words = lists.flatten().dictionary_encode()
    code, own = words.indices.to_numpy().astype(np.int64), np.repeat(doc, lists.value_lengths().to_numpy())
    some = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[code]  # splitting leaves empty words at a text's ends
    most = int(doc.max(initial=0)) + 1
    key, weight = np.unique(code[some] * most + own[some], return_counts=True)
    return words.dictionary, key // most, key % most, weight


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, docnum, weight): how often each lower-case word stands in each text."""
    term = F.explode(F.split(F.lower(text_col), "\\s+")).alias("term")
    return docs.select(F.col(id_col).alias("docnum"), term).filter("term != ''").groupBy("term", "docnum").agg(F.count("*").alias("weight"))


def coded(docs: DataFrame, id_col: str, text_col: str, block: int = 1 << 16) -> DataFrame:
    """(term, block, data): the coded lists (see encode_lists) of the docnums of each block, however common the term.

    Each task codes the lists of its own texts, so that what is shuffled is a few bytes a posting and one row for each word of many texts;
    the lists of one term and block are merged as bytes, a batch at a time.
    """

    def run(batches):
        for batch in slices(batches, 1 << 14, 16 << 20):
            ids, doc = np.unique(_unsigned(batch.column("docnum")), return_inverse=True)
            words, code, doc, weight = _counted(batch, doc)
            docnum = ids[doc]
            at = docnum // np.uint64(block)
            first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(at, prepend=at[:1]) != 0))
            data = _coded(docnum, weight.astype(np.uint64), np.diff(first, append=len(code)))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code[first])), pa.array(at[first].astype(np.int64)), data], names=["term", "block", "data"])

    texts = docs.select(F.col(id_col).alias("docnum"), F.lower(text_col).alias("text"))
    parts = texts.mapInArrow(run, "term string, block long, data binary")
    return parts.groupBy("term", "block").agg(F.arrow_udf(merge_lists, "binary")(F.collect_list("data")).alias("data"))


def _varints(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers, seven bits a byte from the lowest, the top bit set on all but a number's last; and how many each has."""
    size = 1 + sum((n >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))
    start, out = np.cumsum(size) - size, np.zeros(size.sum(), np.uint8)
    for k in range(10):
        has = size > k
        out[start[has] + k] = (n[has] >> np.uint64(7 * k)) & np.uint64(127) | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def encode_lists(lists: pa.Array) -> pa.Array:
    """For each list: version, number of postings, then for each posting the step from the docnum before (modulo 2**64) and the weight;
    null for null. All lists of a batch at once."""
    n = np.array(lists.value_lengths().fill_null(0).to_numpy(), np.int64)
    flat = lists.flatten()
    return pc.if_else(lists.is_valid(), _coded(_unsigned(flat.field("docnum")), flat.field("weight").to_numpy().astype(np.uint64), n), None)


def _unsigned(docnum: pa.Array) -> np.ndarray:
    return (docnum.cast(pa.uint64()) if pa.types.is_decimal(docnum.type) else docnum.cast(pa.int64())).to_numpy().astype(np.uint64)


def _coded(docnum: np.ndarray, weight: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of n postings each, which stand end to end, as bytes."""
    first = np.cumsum(n) - n
    before = np.concatenate([docnum[:0], [np.uint64(0)], docnum[:-1]])[: len(docnum)]
    before[first[n > 0]] = 0
    numbers, head = np.empty(2 * len(n) + 2 * len(docnum), np.uint64), 2 * first + 2 * np.arange(len(n))
    body = np.ones(len(numbers), bool)
    body[head] = body[head + 1] = False
    numbers[head], numbers[head + 1] = VERSION, n
    inner = np.flatnonzero(body)
    numbers[inner[0::2]], numbers[inner[1::2]] = docnum - before, weight
    data, size = _varints(numbers)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(size, head))]) if len(n) else np.zeros(1, np.int64)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def merge_lists(parts: pa.Array) -> pa.Array:
    """For each row's coded lists the one of all their postings by docnum, the weights of one docnum being summed."""
    many, flat = parts.value_lengths().to_numpy(), parts.flatten()
    if (many == 1).all():
        return flat
    docnum, weight, n = _decoded(flat)
    row = np.repeat(np.repeat(np.arange(len(many)), many), n)
    order = np.lexsort((docnum, row))
    docnum, weight, row = docnum[order], weight[order], row[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(docnum, prepend=docnum[:1]) != 0))
    weight = np.add.reduceat(weight, first) if len(first) else weight
    return _coded(docnum[first], weight, np.bincount(row[first], minlength=len(many)))


def decode_lists(data: pa.Array) -> pa.Array:
    """What encode_lists was given; an error for anything else."""
    docnum, weight, n = _decoded(data.drop_null())
    items = pa.StructArray.from_arrays([pa.array(docnum, pa.uint64()).cast(pa.decimal128(20, 0)), pa.array(weight.astype(np.int64))], fields=list(_LISTS.value_type))
    full = np.zeros(len(data), np.int64)
    full[data.is_valid().to_numpy(zero_copy_only=False)] = n
    offsets = pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, items, type=_LISTS, mask=data.is_null())


def _decoded(known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The docnums and weights of all lists end to end, and how many each has."""
    sizes = np.array(pc.binary_length(known).to_numpy(), np.int64)
    raw = np.frombuffer(b"".join(known.to_pylist()), np.uint8)
    bad = ValueError("CORRUPT: not a coded posting list")
    last, end = raw < 128, np.cumsum(sizes)
    if not sizes.all() or not last[end - 1].all():
        raise bad
    stop = np.flatnonzero(last)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)[: len(stop)]
    place = np.arange(len(raw)) - np.repeat(start, stop - start + 1)
    if (place > 9).any() or (raw[place == 9] > 1).any():
        raise bad
    value = np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start) if len(raw) else np.empty(0, np.uint64)
    after = np.searchsorted(stop, end - 1) + 1  # numbers up to each list's end
    count = np.diff(after, prepend=0)
    head = after - count
    if (count < 2).any() or (raw[end - sizes] != VERSION).any() or (value[head + 1] != (count - 2) // 2).any() or (count % 2).any():
        raise bad
    inner = np.ones(len(value), bool)
    inner[head] = inner[head + 1] = False
    step, weight, n = value[inner][0::2], value[inner][1::2], (count - 2) // 2
    if (weight >> np.uint64(63)).any():
        raise bad
    total = np.concatenate([[np.uint64(0)], np.cumsum(step, dtype=np.uint64)])
    return total[1:] - np.repeat(total[np.cumsum(n) - n], n), weight, n


def encode(rows: Column) -> Column:
    """Arrays of (docnum, weight) as bytes, a batch at a time."""
    return F.arrow_udf(encode_lists, "binary")(rows)


def decode(data: Column) -> Column:
    """Bytes back as arrays of (docnum, weight), a batch at a time."""
    return F.arrow_udf(decode_lists, "array<struct<docnum: decimal(20,0), weight: bigint>>")(data)
