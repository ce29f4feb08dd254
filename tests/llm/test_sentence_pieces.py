"""SentencePiece models of both kinds, with every setting of the normaliser, against the sentencepiece library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tradewind.llm.sentence_pieces import Codec, round_trip


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes((n & 127 | 128,))
        n >>= 7
    return out + bytes((n,))


def field(number: int, value) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(kind: int, trim: bool, prefix: bool) -> tuple[bytes, int]:
    """A small model's file and its number of pieces; kind 1 has unigram scores, kind 2 merges."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(w, -1.0 - i * 0.37 - 3 * (len(w) == 1), 1) for i, w in enumerate("▁ ▁the ▁cat ▁c a t th e s ▁s at ▁a h c r b".split())]
    body = b"".join(field(1, field(1, p) + field(2, score) + field(3, k)) for p, score, k in pieces)
    return body + field(2, field(3, kind) + field(35, 1)) + field(3, field(1, "identity") + field(3, int(prefix)) + field(4, int(trim)) + field(5, 1)), len(pieces)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_codec_equals_the_library(tmp_path, kind, trim, prefix):
    body, size = model(kind, trim, prefix)
    path = tmp_path / "own.model"
    path.write_bytes(body)
    there, own, rng = sentencepiece.SentencePieceProcessor(model_file=str(path)), Codec(str(path)), random.Random(kind)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 259, 260, 261, rng.randrange(size), rng.randrange(3, 259)]) for _ in range(rng.randrange(1, 8))]
        assert own.decode(ids) == there.decode(ids), ids
    texts = ["".join(rng.choice(["the", " ", "cat", "s", "at", "é", "  ", "\n", "▁", "日"]) for _ in range(rng.randrange(12))) for _ in range(2000)]
    for t, (ids, same) in zip(texts, own.encode(texts), strict=True):
        assert same and np.frombuffer(ids, "<u4").tolist() == there.encode(t), t


def test_every_single_id_decodes_like_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    there, own = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    assert all(own.decode([i]) == there.decode([i]) for i in range(there.get_piece_size()))


def test_small_bound_changes_nothing():
    """Pieces that were dropped are learned again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    wide, narrow = Codec(path), Codec(path, bound=2000)
    texts = [" ".join(f"word{i * k % 37} x{k}" for i in range(30)) for k in range(200)]
    for at in range(0, 200, 10):
        assert wide.encode(texts[at : at + 10]) == narrow.encode(texts[at : at + 10])
    assert narrow.size <= 2000 + 400 * 100 and len(narrow.older) < len(wide)


def test_round_trip(docs, rows, none):
    there = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in round_trip(docs).collect()}
    for i, t, *_ in rows:
        back = there.decode(there.encode(t or ""))
        assert (got[i].round_trip, got[i].decoded_sha256) == (back == (t or ""), hashlib.sha256(back.encode()).hexdigest())
        assert got[i].same_ids and got[i].n_tokens == len(there.encode(t or ""))
    assert round_trip(none).count() == 0
