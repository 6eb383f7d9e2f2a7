"""Ids and counts against the sentencepiece library, on vocabularies of both kinds. None is trained: they are written from the pieces of the
dealt file, with scores of all sizes, with and without pieces for bytes and a dummy space."""

import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from palimpsest.llm.piece_encoding import MergeEncoder
from palimpsest.llm.pieces import MERGES, UNIGRAM
from palimpsest.llm.token_counts import Counter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DEALT = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = [(DEALT.id_to_piece(i), DEALT.get_score(i)) for i in range(259, DEALT.get_piece_size())]


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(field, data):
    return number(field << 3 | 2) + number(len(data)) + data


def vocabulary(path, pieces, kind, by_bytes=True, prefix=True, types=None, trainer=b""):
    """A model file of these (piece, score), the unknown and byte pieces being put in front."""
    rows = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * by_bytes + [(t, s, (types or {}).get(t, 1)) for t, s in pieces]
    out = b"".join(part(1, part(1, t.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + number(y)) for t, s, y in rows)
    spec = b"\x18" + number(kind) + (b"\x98\x02\x01" if by_bytes else b"") + trainer
    rule = part(1, b"identity") + b"\x18" + number(prefix) + b"\x20\x00\x28\x01"
    path.write_bytes(out + part(2, spec) + part(3, rule))
    return str(path)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(1)
    letters = list(" a  bthe▁▁\n\t!.,(){}<>éñßü世界ゼ\U0001f600\x00xyingtion0123456789'\"")
    drawn = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(600)]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [*drawn, "", " ", "\U0001f600\U0001f600 \U0001f600x\U0001f600", *(r.text for r in rows if r.text), "der die das und ist im zu " * 4000, "the " * 20000 + "\n  x" * 500]


def test_counts_are_the_librarys(tmp_path, texts):
    cut = lambda by: [(t, struct.unpack("f", struct.pack("f", max(s, -40000) / by))[0]) for t, s in PIECES]
    # the dealt scores, of which a few are very low; whole ones; ones of few and of many binary digits
    cases = [(PIECES, True, True), (PIECES, False, True), (cut(1), True, False), (cut(2048), True, True), (cut(2048), False, True), (cut(3000.7), True, True), (cut(1), False, False)]
    for k, (pieces, by_bytes, prefix) in enumerate(cases):
        path = vocabulary(tmp_path / f"{k}.model", pieces, UNIGRAM, by_bytes, prefix)
        lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Counter(path, memo=500)
        for t in texts:
            assert own.count(t) == len(lib.encode(t)), (k, t[:60])


def test_ties_of_equal_scores_go_as_in_the_library(tmp_path):
    pieces = [(t, -float(len(t))) for t in ("▁", "a", "b", "ab", "ba", "aab", "abab", "▁a", "▁ab", "▁aba")]
    path = vocabulary(tmp_path / "ties.model", pieces, UNIGRAM)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Counter(path)
    rng = np.random.default_rng(3)
    for t in ("".join(rng.choice(list("ab "), rng.integers(0, 30))) for _ in range(400)):
        assert own.count(t) == len(lib.encode(t)), t


def test_merges_are_the_librarys(tmp_path, texts):
    for k, (by_bytes, prefix) in enumerate([(False, True), (True, False), (False, False)]):
        path = vocabulary(tmp_path / f"{k}.model", PIECES, MERGES, by_bytes, prefix)
        lib, own = sentencepiece.SentencePieceProcessor(model_file=path), MergeEncoder(path, memo=500)
        for t in texts:
            ids = lib.encode(t)
            assert own.encode(t) == (len(ids), ",".join(map(str, ids)), lib.decode(ids)), (k, t[:60])


def test_what_is_not_supported_is_refused(tmp_path):
    few = PIECES[:300] + [("▁", -1.0), ("a", -2.0)]
    for k, options in enumerate(({"types": {"a": 4}}, {"types": {"a": 5}}, {"trainer": b"\xc0\x01\x01"})):
        with pytest.raises(ValueError, match="not supported"):
            Counter(vocabulary(tmp_path / f"{k}.model", few, UNIGRAM, **options))
    with pytest.raises(ValueError, match="not supported"):
        MergeEncoder(vocabulary(tmp_path / "unigram.model", few, UNIGRAM))


def test_token_counts_of_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "the end", "x"), (3, "the end", "x"), (3, "the end", "x")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL).collect()
    n = Counter(MODEL).count("the end")
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.n_chars) for r in got))) == sorted(map(str, [(1, 0, 0), (2, 0, 0), (None, n, 7), (3, n, 7), (3, n, 7)]))


def test_most_words_are_counted_once_whatever_the_sum_before(tmp_path, texts, monkeypatch):
    path = vocabulary(tmp_path / "dealt.model", PIECES, UNIGRAM)
    lib, own, seen = sentencepiece.SentencePieceProcessor(model_file=path), Counter(path), []
    formed = Counter.rounded
    monkeypatch.setattr(Counter, "rounded", lambda self, atom, *rest: seen.append(atom) or formed(self, atom, *rest))
    words = {a for t in texts[-250:] for a in own.v.atoms(t)}
    for t in texts[-250:]:
        assert own.count(t) == len(lib.encode(t)), t[:60]
    assert len(seen) < len(words) / 4, (len(seen), len(words))


def test_cuts_are_where_no_piece_crosses(tmp_path, texts):
    v = Counter(vocabulary(tmp_path / "cuts.model", PIECES, UNIGRAM)).v
    assert not v.by_letters
    for t in texts:
        atoms = v.atoms(t)
        assert "".join(atoms) == (" " + t.replace("▁", " ") if t else "")
        assert not any(a[-1] + b[0] in v.pairs for a, b in zip(atoms[:-1], atoms[1:], strict=True))
