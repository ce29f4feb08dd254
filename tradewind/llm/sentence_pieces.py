"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is parsed field by field, and a tokenizer of the other
library is rebuilt from it: the normaliser (its table of replacements, the
removal of extra white space, the prefix), the white-space marker, and either
unigram scores or the merges that a byte-pair model's scores imply, both with
byte fallback.

Where no piece holds a marker behind another character (this is checked when
the model is read), a normalised text is cut before each run of markers, and at
line ends where no piece holds one; its ids are those of the cut pieces.  A worker keeps the ids of pieces within a
bound of bytes; new ones are encoded in batches by the library's own threads.
Parity is verified for each new piece, so ``same_ids`` says of every row whether
the sentencepiece library gives the same ids for all of it.  Decoding is equal
to that library's for every list of ids.

Defined results: a null or empty text has no ids and decodes to an empty text;
rows may repeat, and null ids pass through; columns named in ``keep`` pass
through whatever their names; an empty table gives no rows; a null list of ids
decodes to null; bytes that aren't UTF-8 decode to one U+FFFD each.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.byte_bpe import holes, tokenizer_path

#: Fixed values of the public model format: field numbers, kinds of models and of pieces, and the marker.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARKER = "▁"
#: A message that ends a model's file and sets its normaliser's add_dummy_prefix (field 3) to false.
NO_PREFIX = bytes((NORMALIZER << 3 | 2, 2, 3 << 3, 0))


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields; numbers of a fixed width as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"a field of wire type {kind} isn't expected in a model")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model(NamedTuple):
    """What a model's file says."""

    pieces: list[tuple[str, float, int]]  # piece, score, kind
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim: bool
    escape: bool

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        pieces = []
        for number, value in parts:
            if number == PIECES:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        trainer = dict(fields(next((v for n, v in parts if n == TRAINER), b"")))
        rules = dict(fields(next((v for n, v in parts if n == NORMALIZER), b"")))
        model = cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), rules.get(2, b""), *(bool(rules.get(k, 1)) for k in (3, 4, 5)))
        if trainer.get(24, 0) or not model.escape or model.kind not in (UNIGRAM, BPE) or any(k in (USER_DEFINED, UNUSED) for *_, k in pieces):
            raise ValueError("models with white space as suffix, unescaped white space, user-defined or unused pieces aren't supported")
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, the best score first."""
        score = {p: s for p, s, k in self.pieces if k == NORMAL}
        place = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = []
        for whole, s in score.items():
            for cut in range(1, len(whole)):
                a, b = whole[:cut], whole[cut:]
                if a in score and b in score:
                    found.append((-s, place[whole], place[a], place[b], a, b))
        return [(a, b) for *_, a, b in sorted(found)]

    def library(self):  # noqa: ANN201
        """The same model for the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unknown = next((i for i, (*_, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        if self.kind == BPE:
            made = models.BPE(vocab, self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            made = models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, self.byte_fallback)
        out = Tokenizer(made)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            # a marker in the text counts as white space at its end only; ^ and $ would match at every line
            steps += [normalizers.Replace(Regex(f"\\A +|[ {MARKER}]+\\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARKER)] if self.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
        out.decoder = decoders.Sequence(
            [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])]
        )
        return out


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that isn't UTF-8."""
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("tradewind-each-byte", _each_byte)


class Codec(dict):
    """Little-endian ids by normalised piece, and the way back.

    Two generations of pieces are kept, of at most ``bound`` bytes each: pieces
    that are met again move to the younger one, so frequent ones always stay.
    """

    #: Bytes that an entry takes besides its piece and its ids, about.
    ENTRY = 200

    def __init__(self, path: str, bound: int = 96 << 20) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model, self.bound, self.size = Model.read(path), bound, 0
        self.older: dict[str, bytes] = {}
        rebuilt = self.model.library()
        self.plain = not self.model.charsmap and not self.model.trim
        self.normalizer = rebuilt.normalizer
        # pieces are normalised already: the libraries must not add a prefix to them
        self.of_pieces = Tokenizer(rebuilt.model)
        if self.plain:
            with open(path, "rb") as f:
                self.original = sentencepiece.SentencePieceProcessor(model_proto=f.read() + NO_PREFIX)
        else:
            self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        safe = not any(MARKER in p.lstrip(MARKER) for p, *_ in self.model.pieces)
        line = "\n" if self.model.byte_fallback and not any("\n" in p for p, *_ in self.model.pieces) else ""
        inner = f"{MARKER}*[^{MARKER}{line}]+|{MARKER}+"
        self.cut = re.compile((f"{line}|" * bool(line) + inner) if safe else "(?s:.+)").findall
        self.odd: set[str] = set()  # pieces for which the two libraries differ
        self.spelled = [_spelled(p, k) for p, _, k in self.model.pieces]
        self.silent = {i for i, (*_, k) in enumerate(self.model.pieces) if k == CONTROL}
        self.marked = {i for i, (p, _, k) in enumerate(self.model.pieces) if k == NORMAL and p.startswith(MARKER)}

    def normal(self, text: str) -> str:
        """The text as the model's pieces spell it."""
        if not text:
            return text
        if self.plain:
            return (MARKER if self.model.dummy_prefix else "") + text.replace(" ", MARKER)
        return self.normalizer.normalize_str(text)

    def learn(self, new: list[str], batch: int = 1000) -> dict[str, bytes]:
        """Ids of new pieces, by the library's threads, held against the other library's."""
        got = self.of_pieces.encode_batch([new[i : i + batch] for i in range(0, len(new), batch)], is_pretokenized=True, add_special_tokens=False)
        parts = [(np.array(p.ids, "<u4"), np.bincount(np.array(p.word_ids, np.int64), minlength=min(batch, len(new) - k * batch))) for k, p in enumerate(got)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        raw, ends = ids.tobytes(), np.cumsum(np.append(0, 4 * sizes)).tolist()
        known = {p: raw[a:b] for p, a, b in zip(new, ends, ends[1:])}
        if self.plain:
            there = self.original.encode(new, num_threads=1)
            flat = np.fromiter(chain.from_iterable(there), "<u4")
            if not np.array_equal(flat, ids) or not np.array_equal(sizes, [*map(len, there)]):
                self.odd |= {p for p, own in zip(new, there) if known[p] != np.array(own, "<u4").tobytes()}
        return known

    def keep(self, known: dict[str, bytes]) -> None:
        """Adds pieces to the younger generation, which becomes the older one when it is full."""
        self.update(known)
        self.size += self.ENTRY * len(known) + sum(map(len, known)) + sum(map(len, known.values()))
        if self.size > self.bound:
            self.older, self.size = dict(self), 0
            self.clear()

    def _found(self, new: set[str], slice_: int = 20_000) -> dict[str, bytes]:
        """Ids of pieces that the younger generation lacks; a fixed number of them is learned at a time."""
        known = {p: self.older[p] for p in new & self.older.keys()}
        rest = [p for p in new if p not in known]
        for at in range(0, len(rest), slice_):
            known |= self.learn(rest[at : at + slice_])
        self.keep(known)
        return known

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids, whether both libraries give them) of each text."""
        cuts = [self.cut(self.normal(t)) for t in texts]
        parts = [[*map(self.get, cut)] for cut in cuts]
        gaps = [holes(own) for own in parts]
        if new := {cut[j] for cut, at in zip(cuts, gaps) for j in at}:
            known = self._found(new)
            for cut, own, at in zip(cuts, parts, gaps):
                for j in at:
                    own[j] = known[cut[j]]
        out = [b"".join(own) for own in parts]
        if self.plain:
            return [(ids, not self.odd or self.odd.isdisjoint(cut)) for ids, cut in zip(out, cuts)]
        there = self.original.encode(texts, num_threads=1)
        return [(ids, ids == np.array(i, "<u4").tobytes()) for ids, i in zip(out, there)]

    def _lead(self, ids: list[int]) -> int:
        """Markers at the text's begin that are no spaces: the first piece's, and with trimming those of all until one spells more."""
        n = 0
        for i in ids:
            if i in self.silent:
                continue
            if i not in self.marked:
                break
            n += 1
            if not self.model.trim or len(self.spelled[i]) > 1:
                break
        return n

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for, as the sentencepiece library gives it."""
        text = self._decoded(ids) if self.silent.isdisjoint(ids) else "".join([self._decoded(own) for own in self._between(ids)])
        return text[self._lead(ids) :] if self.model.dummy_prefix or self.model.trim else text

    def _decoded(self, ids: list[int]) -> str:
        body = b"".join([*map(self.spelled.__getitem__, ids)])
        try:
            return body.decode()
        except UnicodeDecodeError:
            return body.decode(errors="tradewind-each-byte")

    def _between(self, ids: list[int]) -> Iterator[list[int]]:
        """The ids between control pieces: bytes on both sides of one aren't read together."""
        at = 0
        for k, i in enumerate(ids):
            if i in self.silent:
                yield ids[at:k]
                at = k + 1
        yield ids[at:]


def _spelled(piece: str, kind: int) -> bytes:
    """What a piece stands for in decoded text; the sign of unknown pieces is a fixed value of the library."""
    if kind == BYTE:
        return bytes((int(piece[3:5], 16),))
    return {CONTROL: b"", UNKNOWN: " \u2047 ".encode()}.get(kind, piece.replace(MARKER, " ").encode())


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The worker's codec for a model's file."""
    path = model if os.sep in model else tokenizer_path(model)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(
    docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keep: tuple[str, ...] = ("doc_id",), chars: int = 1 << 20
) -> DataFrame:
    """The columns of keep with ids, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and same_ids."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [f"_{i}" for i in range(len(keep))]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(model)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, chars):
                got = known.encode(part.column(part.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *(len(i) // 4 for i, _ in got)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(i for i, _ in got), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], ids, pa.array(np.diff(ends)), pa.array([zlib.crc32(i) for i, _ in got], pa.int64()), pa.array([s for _, s in got], pa.bool_())],
                    [*names, "ids", "n_tokens", "ids_crc32", "same_ids"],
                )

    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, keep)), "ids array<int>, n_tokens bigint, ids_crc32 bigint, same_ids boolean"])
    given = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.mapInArrow(encoded, schema).withColumnsRenamed(dict(zip(names, keep)))


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keep: tuple[str, ...] = ("doc_id",), chars: int = 1 << 20) -> DataFrame:
    """The columns of keep with n_tokens, ids_crc32, same_ids, round_trip (the ids decode to the text) and decoded_sha256.

    A text is encoded and decoded in one pass, by one worker; neither ids nor
    texts leave it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [f"_{i}" for i in range(len(keep))]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(model)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, chars):
                texts = part.column(part.num_columns - 1).to_pylist()
                got = known.encode(texts)
                back = [known.decode(np.frombuffer(i, "<u4").tolist()) for i, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                        pa.array([zlib.crc32(i) for i, _ in got], pa.int64()),
                        pa.array([s for _, s in got], pa.bool_()),
                        pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    ],
                    [*names, "n_tokens", "ids_crc32", "same_ids", "round_trip", "decoded_sha256"],
                )

    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, keep)), "n_tokens bigint, ids_crc32 bigint, same_ids boolean, round_trip boolean, decoded_sha256 string"])
    given = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.mapInArrow(checked, schema).withColumnsRenamed(dict(zip(names, keep)))


def decode(rows: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", to: str = "text", items: int = 1 << 18) -> DataFrame:
    """The rows with their ids replaced by the text that they stand for."""
    rest = [c for c in rows.columns if c not in (ids, to)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(model).decode
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, items):
                texts = [None if i is None else back(i) for i in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*rest, to])

    return rows.select(*rest, F.col(ids)).mapInArrow(decoded, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{to}` string"]))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings or lists in a column have about so many bytes or items together."""
    own = batch.column(column)
    length = pc.binary_length(own) if pa.types.is_string(own.type) or pa.types.is_large_string(own.type) else pc.list_value_length(own)
    group = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False) + 64) // size
    at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield batch.slice(a, b - a)
