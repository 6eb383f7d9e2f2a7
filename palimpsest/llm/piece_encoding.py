"""SentencePiece encoding of merge-type vocabularies by a table of prefixes.

Each prefix of a text has one last token in the text's merge encoding: of the vocabulary matches that end there (an
Aho-Corasick automaton gives them), the one that is compatible with the last token of the prefix before it. Two tokens are
compatible if merging their joined text gives the two again; to test it, merges are undone from the latest on, looking for
an earlier merge that would have crossed the border. The ids are then read off backwards.

Scale: narrow, no shuffle; each text on its own, in one pass. Repeated words are looked up in bounded tables.
"""

from __future__ import annotations

import gc
import hashlib
from itertools import chain, count, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import narrow, slices
from palimpsest.llm.pieces import MERGES, Memo, Vocabulary

_NO_LIMIT = 1 << 60


class MergeEncoder:
    def __init__(self, path: str, memo: int = 500_000):
        self.v = v = Vocabulary(path)
        if v.kind != MERGES:
            raise ValueError("not supported: a vocabulary without merges")
        # Merges go by score, best first; single characters need none.
        order = {s: k + 1 for k, s in enumerate(sorted({v.score[i] for i in v.normal if len(v.text[i]) > 1}, reverse=True))}
        self.rank = {i: order[v.score[i]] if len(v.text[i]) > 1 else 0 for i in v.normal}
        # Pieces of one score are ordered by place alone: pairs of such pieces are tested by merging.
        seen: dict[int, int] = {}
        for i in v.normal:
            seen[self.rank[i]] = seen.get(self.rank[i], 0) + (self.rank[i] > 0)
        self.tied = {i for i in v.normal if seen[self.rank[i]] > 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in v.normal:
            parts, last = self.merge(v.text[i])
            if parts == [v.text[i]]:
                self.automaton.add_word(v.text[i], (i, len(v.text[i])))
                if last:
                    self.halves[i] = (v.id_of[last[0]], v.id_of[last[1]])
        self.automaton.make_automaton()
        self.known = {c for p in v.id_of for c in p if c in v.id_of}
        self.memo, self.fits, self.odd = memo, {}, {}
        self.by_atom = Memo(memo)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merge encoding of a short text by definition (best score first, then leftmost), and its last merge."""
        parts, last, id_of, score = list(text), None, self.v.id_of, self.v.score
        while True:
            best = max(((score[id_of[x]], -k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in id_of), default=None)
            if best is None:
                return parts, last
            k = -best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, a: int, b: int) -> bool:
        text, rank, halves, id_of = self.v.text, self.rank, self.halves, self.v.id_of
        if a in self.tied or b in self.tied:
            return self.merge(text[a] + text[b])[0] == [text[a], text[b]]
        limit = _NO_LIMIT
        while True:
            joined = id_of.get(text[a] + text[b])
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = halves[a][1]
            elif b in halves:
                limit = rank[b] + 1  # an equal merge on the border stands further left, so it comes first
                b = halves[b][0]
            else:
                return True

    def atom(self, text: str) -> list[int]:
        """The ids of a text, from its table of last tokens."""
        n, known, fits, all_pieces = len(text), self.known, self.fits, len(self.v.text)
        last: list = [None] * (n + 1)
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            if start := end - size:
                before = last[start]
                if before is None:
                    if text[start - 1] in known:
                        continue
                else:
                    ok = fits.get(pair := before * all_pieces + i)
                    if ok is None:
                        if len(fits) >= self.memo:
                            fits.clear()
                        ok = fits[pair] = self.compatible(before, i)
                    if not ok:
                        continue
            last[end] = i
        out: list[list[int]] = []
        at, piece = n, self.v.text
        while at:
            if (i := last[at]) is None:  # a character that no piece holds
                at -= 1
                out.append(self.v.bytes_of(text[at]))
            else:
                at -= len(piece[i])
                out.append([i])
        return list(chain.from_iterable(reversed(out)))

    def ids_of(self, atom: str) -> str:
        """The ids of an atom as text. An atom that does not decode to itself is noted in `odd`."""
        got = self.by_atom.find(atom)
        if got is None:
            ids = self.atom(atom)
            got = ",".join(map(str, ids))
            if (text := self.v.decode(ids)) != atom:
                self.odd[atom] = text
            elif len(atom) <= 64:
                self.by_atom.put(atom, got)
        return got

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal with commas, and the text that the ids decode to."""
        if not text:
            return 0, "", ""
        self.odd.clear()
        get, atoms = self.by_atom.get, self.v.atoms(text)
        ids = ",".join([get(a) or self.ids_of(a) for a in atoms])
        if self.odd and not self.v.by_bytes:
            return self.joined(ids)
        if self.odd:
            atoms = [self.odd.get(a, a) for a in atoms]
        return ids.count(",") + 1, ids, "".join(atoms)[len(self.v.prefix) :]

    def joined(self, ids: str) -> tuple[int, str, str]:
        """As encode, of ids some of which are unknown: neighbouring ones become one."""
        own = [i for i, _ in groupby(map(int, ids.split(",")), lambda i, n=count(): (i, -1 if i == self.v.unknown else next(n)))]
        own = [i for i, _ in own]
        text = self.v.decode(own)
        return len(own), ",".join(map(str, own)), text[len(self.v.prefix) :] if text.startswith(" ") or not self.v.prefix else text


_ENCODERS: dict[str, MergeEncoder] = {}


def encoder(path: str) -> MergeEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MergeEncoder(path)
    return _ENCODERS[path]


def piece_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids and the decoded text.

    Ids are those of the sentencepiece library for the vocabulary at `path`, a file that each executor has, without begin or end
    ids. A null or empty text has no ids and decodes to the empty text. Repeated rows each get a row, whatever their id.
    """

    def run(batches):
        enc = encoder(path)
        gc.disable()  # nothing here makes cycles, and the tables are large to walk
        for batch in slices(batches, 256):
            got = [enc.encode(t) for t in batch.column("text").to_pylist()]
            digest = [pa.array([hashlib.sha256(g[k].encode()).hexdigest() for g in got], pa.string()) for k in (1, 2)]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([g[0] for g in got], pa.int64()), "ids_sha256": digest[0], "decoded_sha256": digest[1]}
            if with_ids:
                out |= {"ids": pa.array([np.array(g[1].split(",") if g[1] else [], np.int32) for g in got], pa.list_(pa.int32())), "decoded": pa.array([g[2] for g in got], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    texts = narrow(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
