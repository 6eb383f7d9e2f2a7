"""A sentencepiece vocabulary, read through the library, and the cuts of text at which no piece can cross."""

from __future__ import annotations

import re

import numpy as np
import sentencepiece

#: The visible stand-in for a space inside pieces.
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")
#: Runs of letters and runs of anything else, each with the spaces before it.
_ATOMS = re.compile(r" *[^\W\d_]+| *(?:[^\w ]+|[\d_]+)+| +")


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: an integer, or the bytes of a fixed or delimited one."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


#: Fields of the model file and their values, as its format fixes them: the pieces with their type, and what the specs switch on.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_TYPE, _MODEL_TYPE, _SUFFIX, _PREFIX, _EXTRA, _ESCAPE = 3, 3, 24, 3, 4, 5
UNIGRAM, MERGES = 1, 2
USER_DEFINED, UNUSED = 4, 5


#: Size of the table of characters that stand together.
_PLACES = 1 << 22


def _places(pairs) -> np.ndarray:
    """Where first and second characters have their places in the table."""
    return (pairs[0] * np.uint32(40503) ^ pairs[1]) & np.uint32(_PLACES - 1)


class Vocabulary:
    """Pieces with a plain space in the place of MARK.

    Taken are unigram and merge vocabularies whose normaliser leaves text as it is, with a dummy space in front or without, with pieces
    for bytes or without. Others are refused: with user-defined or unused pieces, spaces at the end of words, or spaces that are not
    escaped.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        parts: dict[int, list] = {_PIECES: [], _TRAINER: [], _NORMALIZER: []}
        for field, value in _fields(lib.serialized_model_proto()):
            parts.setdefault(field, []).append(value)
        trainer, normalizer = ({k: v for part in parts[f] for k, v in _fields(part)} for f in (_TRAINER, _NORMALIZER))
        types = [dict(_fields(piece)).get(_PIECE_TYPE, 1) for piece in parts[_PIECES]]
        self.kind, self.prefix = trainer.get(_MODEL_TYPE, UNIGRAM), " " if normalizer.get(_PREFIX, 1) else ""
        if self.kind not in (UNIGRAM, MERGES) or {USER_DEFINED, UNUSED} & set(types) or trainer.get(_SUFFIX) or not normalizer.get(_ESCAPE, 1):
            raise ValueError("not supported: a vocabulary with user-defined or unused pieces, spaces behind words or not escaped, or neither unigram nor of merges")
        if any(lib.normalize(x) != (self.prefix + x).replace(" ", MARK) for x in (" Ａ ", "  é\n")):
            raise ValueError("not supported: the vocabulary's normaliser changes text")
        self.text = [lib.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        self.score = [lib.get_score(i) for i in range(n)]
        self.byte_id = [-1] * 256
        self.normal = []
        for i in range(n):
            if lib.is_byte(i):
                self.byte_id[int(self.text[i][3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.normal.append(i)
        self.unknown, self.by_bytes = lib.unk_id(), min(self.byte_id) >= 0
        self.value = {i: b for b, i in enumerate(self.byte_id) if i >= 0}
        self.id_of = {self.text[i]: i for i in self.normal}
        self.pairs = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.together = np.zeros(_PLACES, bool)
        self.together[_places(np.array([[ord(c) for c in p] for p in self.pairs], np.uint32).reshape(-1, 2).T)] = True
        self.by_letters = not any(x[1] == " " and x[0] != " " for x in self.pairs) and not any(bool(_LETTER.match(x[0])) != bool(_LETTER.match(x[1])) for x in self.pairs if x[0] != " ")

    def atoms(self, text: str) -> list[str]:
        """The text behind the dummy space, where there is one, cut where no piece crosses; an empty text has no atoms.

        Cuts are where letters and others meet if no piece has both, else wherever two neighbouring characters stand together
        in no piece (or share a place of the table with two that do). A cut more or less changes no id.
        """
        if not text:
            return []
        text = self.prefix + (text.replace(MARK, " ") if MARK in text else text)
        if self.by_letters:
            return _ATOMS.findall(text)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = (np.flatnonzero(~self.together[_places((chars[:-1], chars[1:]))]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def bytes_of(self, char: str) -> list[int]:
        """The ids of a character that no piece holds: its bytes, or the unknown id where the vocabulary has no bytes. Of neighbouring
        unknown ids the library keeps one."""
        return [self.byte_id[b] for b in char.encode()] if self.by_bytes else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as it stands between other pieces: runs of bytes are read as UTF-8, the unknown id as the library shows it."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(" ⁇ " if i == self.unknown else self.text[i])
        return "".join(out) + run.decode(errors="replace")


class Memo(dict):
    """A table of at most two generations of `limit` keys: what has been looked up or added since the last turn, and before it.

    Memory stays bounded on any text, and keys in use are kept.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def find(self, key):
        """The value, None if there is none. What the older generation has is taken over."""
        got = self.get(key)
        if got is None and (got := self.old.pop(key, None)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
