"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary learnt from text spends few tokens on words and many on random strings. A run of 20 or more
key characters is reported as random when it takes few characters to a token, unless it is a known digest (hexadecimal of a
usual digest's length) or an identifier (UUID, number, words joined or in camel case that each take many characters to a token). Letters
alone are no identifier by that. What the patterns found is left out of a run, and each rest that is long enough is tested.

The bound of 2.0 characters a token is calibrated by test: of random strings of 20 to 64 characters of usual alphabets at least 95 % are
reported, of joined words of a text at most 1 %.

Scale: narrow, no shuffle, whole texts; only candidate runs are tokenised.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from palimpsest.llm.common import narrow, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Equivalent to HEX and its least length, since a run is either long enough or not.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters that a run has at least.
LEAST = 20
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGESTS = (32, 40, 56, 64, 96, 128)
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[+/_=-]+")


def patterns(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, in code points: leftmost and non-overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]


def excluded(run: str, efficiency, most: float) -> bool:
    """Whether a run is a known digest or an identifier, whose own words are each efficient."""
    if _HEX_ONLY.fullmatch(run) and len(run) in DIGESTS or _UUID.fullmatch(run):
        return True
    parts = _PART.findall(run)
    words = [p for p in parts if p.isalpha()]
    digits = sum(len(p) for p in parts if p.isdigit())
    # numbers alone, or words of three letters and more on average with no more than an ending of digits
    return not words or 8 * digits <= len(run) and sum(map(len, words)) >= 3 * len(words) and all(efficiency(w) > most for w in words)


class Efficiency:
    """Characters per token under a tiktoken vocabulary, a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> float:
        return len(run) / len(self.encoding.encode_ordinary(run))


def rests(start: int, end: int, spans: list[tuple[int, int, str]], least: int = LEAST) -> list[tuple[int, int]]:
    """What no span covers of [start, end), in pieces of at least `least`."""
    out = []
    for a, b, _ in sorted(spans):
        if a < end and start < b:
            out.append((start, a))
            start = max(start, b)
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= least]


def scan(text: str | None, efficiency, most: float) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as in KINDS."""
    text = text or ""
    found = patterns(text)
    more = [place for m in _RUN.finditer(text) for place in rests(*m.span(), found)]
    found += [(a, b, "random") for a, b in more if efficiency(run := text[a:b]) <= most and not excluded(run, efficiency, most)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_LOADED: dict = {}


def secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, most: float = 2.0) -> DataFrame:
    """One row per row of docs: doc_id, spans (array of start, end, kind, in code points, end exclusive), by start and kind.

    A null or empty text has none. Repeated rows each get a row, whatever their id. Other columns are ignored.
    `path` names a tiktoken vocabulary that each executor has; `most` is the number of characters per token up to which a run is random.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = Efficiency(path, pattern)
        for batch in slices(batches, 256):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t, _LOADED[path], most)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    texts = narrow(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, spans array<struct<start: long, end: long, kind: string>>")
