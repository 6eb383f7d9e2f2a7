"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches; for each end of a match the best score so far and
its number of pieces are kept, and no path. Ties go as in the library: it extends paths from left to right and replaces
the one that it has only by a better one, so of equal scores the one whose last piece begins furthest left stays.

The library keeps sums in single precision and, where the sum up to a character is more than REBASE from zero, counts on from zero there,
with all sums behind it less by as much. So a tie or a near tie may hang on what stands before it. What does not is looked up by word:
with scores that are whole multiples of one unit, none very low, all sums are exact; else, a word whose best path leads by more than
rounding can move keeps that path. For any other word the same sums are formed as in the library, rounding included, from the sum
before it. A vocabulary of merges has a few very low scores, at which sums lose what is less than their last place. Behind its space alone
a word's sums start anew, so that of the sum before there stays only how its first pieces are rounded; a word whose paths lead by more than
that is looked up by word too, any other by that sum modulo the place.

Scale: narrow, no shuffle; each text on its own, whole. Words are looked up in bounded tables.
"""

from __future__ import annotations

import gc
import struct
from math import frexp, inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import narrow, slices
from palimpsest.llm.pieces import Memo, Vocabulary

#: What the library takes off the lowest score for a character that no piece holds (fixed value).
UNKNOWN_PENALTY = 10.0
_SINGLE = struct.Struct("f")
#: Sums of up to this many units are exact in single precision.
_EXACT = 1 << 24
#: How far from zero the library lets a sum go (fixed value).
REBASE = 100_000.0
#: How the sum behind a word comes from the sum before it: not at all, by how first pieces' sums are rounded, by adding, or only by forming all.
SET, MOVED, ADDED, ROUNDED = range(4)


def single(x: float) -> float:
    """x rounded to single precision."""
    return _SINGLE.unpack(_SINGLE.pack(x))[0]


class Counter:
    def __init__(self, path: str, memo: int = 400_000):
        self.v = v = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for i in v.normal:
            self.automaton.add_word(v.text[i], (len(v.text[i]), v.score[i]))
        self.automaton.make_automaton()
        self.unknown = single(min(v.score[i] for i in v.normal) - UNKNOWN_PENALTY)
        self.first = {p: v.score[i] for p, i in v.id_of.items() if len(p) == 1}
        self.known = set(self.first)
        scores = [self.unknown, *(v.score[i] for i in v.normal)]
        usual = [x for x in scores if abs(x) <= REBASE] or [0.0]
        #: whether sums of usual scores are exact: all in one unit, few of them
        self.unit = max(x.as_integer_ratio()[1] for x in usual)
        self.grid = 4 * REBASE * self.unit <= _EXACT
        self.exact = self.grid and len(usual) == len(scores)
        self.place = 2.0 ** (frexp(max(map(abs, scores)) + REBASE)[1] - 24)  # the last place of the lowest sums
        low = [abs(x) for x in scores if abs(x) > REBASE]
        one_place = bool(low) and len({frexp(x + d * REBASE)[1] for x in low for d in (-4, 4)}) == 1  # so that all low sums are rounded alike
        self.slots = int(self.place * self.unit) if self.grid and one_place and self.place * self.unit <= 256 else 0
        self.to_even = 1.5 * 2**52 * self.place
        self.limit = _EXACT / self.unit if self.grid else 0.0
        self.by_atom, self.by_place, self.shared = Memo(memo), Memo(memo // 8), {}

    def matches(self, text: str) -> list[list[tuple[int, float, int]]]:
        """For each end the pieces (start, score, ids) that end there, the longest first; ids is 0 for an unknown character that
        is one of a run."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in text]
        for end, (size, score) in self.automaton.iter(text):
            ends[end].append((end + 1 - size, score, 1))
        for end, found in enumerate(ends):
            if text[end] not in self.known:
                found.append((end, self.unknown, len(text[end].encode()) if self.v.by_bytes else 0))
            if len(found) > 1:
                found.sort()
        return ends

    def atom(self, text: str) -> tuple:
        """(ids, lead, lowest, path) of a word by exact sums: its ids (see runs), by how much its best path leads any other, the sum that is
        furthest from zero at any character, and the scores of that path."""
        best, second, back = [0.0], [-inf], [None]
        for found in self.matches(text):
            first, next_, via = -inf, -inf, None
            for start, score, n in found:
                total = best[start] + score
                if total > first or via is None:
                    first, next_, via = total, first, (start, score, n)
                elif total > next_:
                    next_ = total
            best.append(first)
            second.append(max(next_, *(second[b] + x for b, x, _ in found)))
            back.append(via)
        at, path, ids = len(text), [], []
        while at:
            at, score, n = back[at]
            path.append(score)
            ids.append(n)
        return self.runs(ids[::-1]), best[-1] - second[-1], max(map(abs, best)), path[::-1]

    def runs(self, ids: list[int]) -> tuple[int, bool, bool]:
        """Number of ids, a run of unknown characters being one, and whether such a run stands first and last."""
        if 0 not in ids:
            return sum(ids), False, False
        more = sum(n == 0 and (k == 0 or ids[k - 1] != 0) for k, n in enumerate(ids))
        return sum(ids) + more, ids[0] == 0, ids[-1] == 0

    def program(self, text: str) -> list[list[tuple[int, float, int]]]:
        """For each start the pieces (end, score, ids) that begin there, the shortest first."""
        program: list = [[] for _ in text]
        for end, (size, score) in self.automaton.iter(text):
            program[end + 1 - size].append((end + 1, score, 1))
        if not self.known.issuperset(text):
            for start, char in enumerate(text):
                if char not in self.known:
                    program[start].insert(0, (start + 1, self.unknown, len(char.encode()) if self.v.by_bytes else 0))
        return program

    def rounded(self, text: str, before: float, program=None) -> tuple[tuple[int, bool, bool], float]:
        """The ids of a word and the sum behind it, all sums as the library forms them behind the sum `before`."""
        program = program or self.program(text)
        size, far, exact, runs = len(text), 0, self.limit, not self.v.by_bytes
        best, counts, back = [before, *[None] * size], [0] * (size + 1), [None] * (size + 1)
        for at, found in enumerate(program):
            sum_, n_ids = best[at], counts[at]
            if sum_ < -REBASE or sum_ > REBASE:
                for k in range(at + 1, far + 1):
                    if best[k] is not None:
                        moved = best[k] - sum_
                        best[k] = moved if -exact < moved < exact else single(moved)
                sum_ = 0.0
            for end, score, n in found:
                total, old = sum_ + score, best[end]
                if not -exact < total < exact:
                    total = single(total)
                if old is None or total > old:
                    best[end], counts[end] = total, n_ids + n
                    if runs:
                        back[end] = (at, n)
            if found[-1][0] > far:
                far = found[-1][0]
        if not runs:
            return (counts[-1], False, False), best[-1]
        at, ids = size, []
        while at:
            at, n = back[at]
            ids.append(n)
        return self.runs(ids[::-1]), best[-1]

    def entry(self, atom: str) -> tuple:
        got = self.by_atom.find(atom)
        if got is None:
            got = self.kept(atom)
            if len(atom) <= 64:
                self.by_atom.put(atom, got)
        return got

    def kept(self, atom: str) -> tuple:
        """What holds of a word behind any sum, as far as something does: (ids, how, ...), see walk. How is SET, MOVED or ADDED, or ROUNDED
        for a word that has to be seen behind each sum; with ROUNDED and scores that are not all exact, what atom gives."""
        if self.slots and abs(low := self.first.get(atom[0], self.unknown)) > 4 * REBASE:
            return self.behind_any(atom, low) or (None, ROUNDED)
        ids, lead, lowest, path = self.atom(atom)
        return (self.shared.setdefault(ids, ids), ADDED, sum(path), lowest) if self.grid else (ids, ROUNDED, lead, lowest, path)

    def behind_any(self, atom: str, low: float) -> tuple | None:
        """As kept, for a word whose first character alone leaves the range; None if its ids may hang on the sum before.

        That sum only moves where the sums of the first pieces are rounded, each by half a place at most. So of two paths with one first piece
        the better one stays so, and with two the one that leads by more than a place.
        """
        size, place = len(atom), self.place
        if size == 1:
            return self.rounded(atom, 0.0)[0], SET, 0.0
        best, firsts, counts, q, least = [None] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), 0, 0.0
        for end, (n, score) in self.automaton.iter(atom):  # for each end the longest piece first
            end += 1
            if n == end:
                if n == 1:
                    continue
                if not q:
                    q, least = end, score
                total, first, count = score - least, score, 1
            else:
                if (before := best[end - n]) is None:
                    if score < -REBASE:
                        return None
                    continue
                total, first, count = before + score, firsts[end - n], counts[end - n] + 1
            if score < -REBASE:
                return None
            if (old := best[end]) is None or total > old:
                if old is not None and first != firsts[end] and total - old <= place:
                    return None
                best[end], firsts[end], counts[end] = total, first, count
            elif first != firsts[end] and old - total <= place:
                return None
        # before q all sums are a first character's, and so low that none may be left behind it
        if not q or q > 4 or None in best[q:] or not self.known.issuperset(atom[1:q]):
            return None
        zero, zero_first, margin = 0.0, least, 2 * place
        if min(best[q:]) < margin - REBASE or max(best[q:]) > REBASE - margin:
            for at in range(q + 1, size + 1):
                far = abs(best[at] - zero)
                if far > REBASE + margin:
                    zero, zero_first = best[at], firsts[at]
                elif far >= REBASE - margin:
                    return None
        ids, first = (counts[-1], False, False), firsts[-1]
        ids, moved = self.shared.setdefault(ids, ids), best[-1] - zero - (first - zero_first)
        return (ids, SET, moved) if first == zero_first else (ids, MOVED, moved, low, first, zero_first)

    def count(self, text: str | None) -> int:
        atoms, get, entry = self.v.atoms(text or ""), self.by_atom.get, self.entry
        if self.exact:
            return self.total([(get(a) or entry(a))[0] for a in atoms])
        return self.total(self.walk(atoms))

    def total(self, runs: list[tuple[int, bool, bool]]) -> int:
        n = sum([r[0] for r in runs])
        return n if self.v.by_bytes else n - sum(a[2] and b[1] for a, b in zip(runs[:-1], runs[1:], strict=True))

    def walk(self, atoms: list[str]) -> list[tuple[int, bool, bool]]:
        """The ids of each word, the sums being those of the library from the first word on."""
        out, sum_, get, even = [], 0.0, self.by_atom.get, self.to_even
        for atom in atoms:
            known = get(atom) or self.entry(atom)
            ids, how = known[0], known[1]
            if how == SET:  # the word's first piece, or one that its sums start anew behind, takes away all of the sum before
                sum_ = known[2]
            elif how == MOVED:  # its sums count from where another first piece ends
                _, _, moved, low, first, zero = known
                base = sum_ - (sum_ + low + even - even)
                sum_ = moved + (base + first + even - even) - (base + zero + even - even)
            elif how == ADDED and abs(sum_) + known[3] < REBASE:  # exact, and no sum leaves the range
                sum_ += known[2]
            else:
                ids, sum_ = self.behind(atom, sum_, known)
            out.append(ids)
        return out

    def settled(self, ids: tuple[int, bool, bool], sum_: float) -> tuple[tuple[int, bool, bool], float]:
        """The ids of a word, and the sum that the next one starts from."""
        return ids, 0.0 if sum_ < -REBASE or sum_ > REBASE else sum_

    def case(self, rest: float, low: float, scores: list[float]) -> tuple[list[float], list[float]]:
        """The sums of a word's first pieces from where its first character alone ends, exact and rounded to their last place."""
        to_even, base = self.to_even, rest - single(rest + low)
        exact = [base + score for score in scores]
        return exact, [x + to_even - to_even for x in exact]

    def behind(self, atom: str, before: float, known: tuple) -> tuple[tuple[int, bool, bool], float]:
        """What settled gives for a word behind the sum `before`."""
        if self.slots and len(atom) <= 64 and abs(low := self.first.get(atom[0], self.unknown)) > 4 * REBASE:
            # The first character alone leaves the range from wherever it starts, so behind it sums count from there: all that they keep
            # of `before` is how those of the word's first pieces are rounded.
            rest = before % self.place
            if rest == self.place / 2:  # rounded to the even one of two, which is not the same for all such sums
                return self.settled(*self.rounded(atom, before))
            at = int(rest * self.unit)
            if (found := self.by_place.find(atom)) is None:
                program = self.program(atom)
                numbers, got = bytearray(self.slots), self.settled(*self.rounded(atom, before, program))
                numbers[at] = 1
                scores = [score for _, score, _ in program[0][1:]]
                self.by_place.put(atom, (numbers, [None, got], [None, self.case(rest, low, scores)[1]], scores))
                return got
            numbers, results, cases, scores = found
            if not numbers[at]:
                exact, case = self.case(rest, low, scores)
                if case not in cases:
                    if len(cases) > 255:
                        return self.settled(*self.rounded(atom, before))
                    cases.append(case)
                    results.append(self.settled(*self.rounded(atom, before)))
                # the same holds as far as no sum comes to the middle between two places
                half, unit = self.place / 2, self.unit
                off = [x - y for x, y in zip(exact, case, strict=True)] + [rest if rest < half else rest - self.place]
                first, last = at - int((half + min(off)) * unit) + 1, at + int((half - max(off)) * unit) - 1
                first, last = max(min(first, at), 0), min(max(last, at), self.slots - 1)
                numbers[first : last + 1] = bytes([cases.index(case)]) * (last + 1 - first)
            return results[numbers[at]]
        if len(known) == 5:
            ids, _, lead, lowest, path = known
            size = abs(before) + lowest
            # no sum leaves the range, and two paths' sums are each off by at most 2 ** -24 of their size at each of their characters
            if size < REBASE and lead > len(atom) * 2.0**-22 * size:
                for score in path:
                    before = single(before + score)
                return self.settled(ids, before)
        return self.settled(*self.rounded(atom, before))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_chars (code points), of the vocabulary at `path`, one of merges being read as a
    unigram one.

    n_tokens is the number of ids that the sentencepiece library's encode gives for a unigram vocabulary. A null or empty text has no
    tokens. Repeated rows each get a row, whatever their id. Other columns are ignored.
    """

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        gc.disable()  # nothing here makes cycles, and the tables are large to walk
        for batch in slices(batches, 256):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})

    texts = narrow(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long, n_chars long")
