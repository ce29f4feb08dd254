"""Packing of documents into token windows by the sum-of-squares rule.

A document's ids are followed by an end id.  Full windows are cut off a long
document's front; what is left is placed online: an array holds, for each fill
level, how many windows are filled up to it, and the piece goes to the level
(or to a new window) where the sum of the squared counts over all partially
filled levels becomes smallest.  Of equal levels the fullest is taken, and of
the windows at a level the latest.

Every task packs the rows of its own input split, so nothing is shuffled and a
lost task packs the same rows again.  A sequence's id is the task's number and
a running number in it.  When a task ends, or holds more than ``max_open`` open
windows, these are joined end to end, the fullest last, and cut again at full
windows; what remains is cut into sequences whose lengths are powers of two,
which need no padding.

Defined results: a null or empty text is a document of the end id alone; rows
may repeat and are packed each; ids of any type pass through, null ones too; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.byte_bpe import byte_letters, groups, holes, pieces, rows, special_pattern, tokenizer_path

#: Bits of a sequence's id that number the sequences of one task.
RUNNING_BITS = 36


class PieceIds(dict):
    """Little-endian ids by piece of text, from the tokenizers library, kept within a bound."""

    def __init__(self, path: str, bound: int = 300_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        # the file's model alone: the pieces are cut already, and are given in the vocabulary's letters
        self.library, self.bound = Tokenizer(whole.model), bound
        self.letters = {chr(b): c for c, b in byte_letters().items()}
        self.table = str.maketrans(self.letters)
        special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.special = special_pattern(special)
        self.fixed = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, all by one call of the library; they are kept as well."""
        if len(self) + len(new) > self.bound:
            self.clear()
        plain = [p for p in new if "\0" not in p]
        words = "\0".join(plain).encode().decode("latin-1").translate(self.table).split(self.letters["\0"]) if plain else []
        odd = [p for p in new if "\0" in p]
        words += [p.encode().decode("latin-1").translate(self.table) for p in odd]
        got = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1)).tolist()
        ids = np.array(got.ids, "<u4").tobytes()
        known = {w: ids[4 * a : 4 * b] for w, a, b in zip((*plain, *odd), ends, ends[1:])}
        self.update(known)
        return known

    def _pieces(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            return [p for i, s in enumerate(self.special.split(text)) for p in (pieces(s) if i % 2 == 0 else [s])]
        return pieces(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        """All ids of each text; special strings are one id each, as the library does by default."""
        self.update(self.fixed)
        found = [self._pieces(t) for t in texts]
        parts = [[*map(self.get, cut)] for cut in found]
        gaps = [holes(own) for own in parts]
        new = {cut[j] for cut, at in zip(found, gaps) for j in at}
        if new:
            known = self.learn([*new])
            for cut, own, at in zip(found, parts, gaps):
                for j in at:
                    own[j] = known[cut[j]]
        return [b"".join(own) for own in parts]


_LIBRARIES: dict[str, PieceIds] = {}


def piece_ids(tokenizer: str) -> PieceIds:
    """The worker's cache for a tokenizer's file."""
    path = tokenizer_path(tokenizer)
    if path not in _LIBRARIES:
        _LIBRARIES[path] = PieceIds(path)
    return _LIBRARIES[path]


class SumOfSquares:
    """Open windows by fill level; a piece is (document's values, start, ids as bytes)."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # 0 and the full level stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Puts a piece smaller than a window into one; returns the window if that fills it."""
        n, w = self.level, self.window
        # change of the sum of squares for a window at level h that rises to h + size
        change = 2 * (n[size : w + 1] - n[: w + 1 - size]) + 2
        change[-1] = 1 - 2 * n[w - size]  # the window becomes full and is counted no more
        usable = n[: w + 1 - size] > 0
        usable[0] = True
        change[0] = 2 * n[size] + 1
        change = np.where(usable, change, np.iinfo(np.int64).max)
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = self.open[h].pop() if h else []
        if h:
            n[h] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if h + size == w:
            return pieces
        self.open[h + size].append(pieces)
        n[h + size] += 1
        self.n_open += 1
        return None

    def drain(self) -> Iterator[tuple]:
        """All pieces in open windows, which are closed, the emptiest first."""
        for pieces in (p for at in self.open for p in at):
            yield from pieces
        self.__init__(self.window)


def lengths(rest: int, window: int) -> list[int]:
    """Sequence lengths for a stretch of ids: full windows, then powers of two, the largest first."""
    out = [window] * (rest // window)
    return out + [1 << b for b in range(window.bit_length(), -1, -1) if (rest % window) >> b & 1]


class Packer:
    """Packs one task's documents; emits (document's values, start, ids, sequence, offset)."""

    def __init__(self, window: int, max_open: int) -> None:
        self.squares, self.window, self.max_open = SumOfSquares(window), window, max_open
        self.sequence = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids in pieces:
            yield doc, start, ids, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc: tuple, ids: bytes) -> Iterator[tuple]:
        w = self.window
        n = len(ids) // 4
        for at in range(0, n - n % w, w):
            yield from self._close([(doc, at, ids[4 * at : 4 * (at + w)])])
        if n % w:
            if full := self.squares.place((doc, n - n % w, ids[4 * (n - n % w) :]), n % w):
                yield from self._close(full)
            if self.squares.n_open > self.max_open:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """Joins the open windows and cuts them anew, without padding."""
        rest = list(self.squares.drain())
        sizes = lengths(sum(len(p[2]) // 4 for p in rest), self.window)[::-1]
        free, pieces = sizes.pop() if sizes else 0, []
        for doc, start, ids in rest:
            while ids:
                taken = ids[: 4 * free]
                pieces.append((doc, start, taken))
                start, ids, free = start + len(taken) // 4, ids[len(taken) :], free - len(taken) // 4
                if not free:
                    yield from self._close(pieces)
                    free, pieces = sizes.pop() if sizes else 0, []


def pack(
    docs: DataFrame,
    window: int = 2048,
    end_id: int = 1,
    tokenizer: str = "byte_bpe_50k.json",
    doc_id: str = "doc_id",
    text: str = "text",
    max_open: int = 4096,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves as an array.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << RUNNING_BITS
        known, packer = piece_ids(tokenizer), Packer(window, max_open)
        id_type = None

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = {
                "doc_id": pa.array([o[0][0] for o in out], id_type),
                "start": pa.array([o[1] for o in out], pa.int64()),
                "length": pa.array([len(o[2]) // 4 for o in out], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(o[2]) for o in out], pa.int64()),
                "doc_tokens": pa.array([o[0][1] for o in out], pa.int64()),
                "sequence_id": pa.array([base + o[3] for o in out], pa.int64()),
                "offset": pa.array([o[4] for o in out], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(o[2], "<u4").astype(np.int32) for o in out], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        out: list[tuple] = []
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for some in groups(rows(iter((batch,)), "doc_id", "text")):
                for (i, _), got in zip(some, known.ids([t or "" for _, t in some]), strict=True):
                    out += packer.add((i, len(got) // 4 + 1), got + end)
                if len(out) > 2000:
                    yield table(out)
                    out = []
        out += packer.flush()
        if out:
            yield table(out)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        packed, schema + ", ids array<int>" * with_ids
    )
