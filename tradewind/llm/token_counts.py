"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer.

The transducer reads a piece byte by byte.  Its state is what the future can
still depend on: the longest suffix that begins some token, and at each place
in it the last token of the text up to there with the tokens emitted since.  A
transition is annotated with the change in the number of emitted tokens, which
may be negative, as a byte can merge tokens.  The last token of every prefix is
the longest token that ends there and stays apart from the last token before it
under the merge rule; there is exactly one.  States are compiled when first met
and kept within a bound, so the automaton is deterministic and its memory fixed.

A chunk of text acts on the automaton as a map from the state before it to the
state and count after it.  As every piece ends before white space that follows
another character, a chunk with such a place maps all states to one: the map is
the text before its first such place, the tokens between, and the text behind
its last.  A chunk without one is its text.  These maps compose associatively:
a text is cut into chunks, each chunk's map is made by itself, and the maps are
composed pairwise, level by level, so that no more than two of them are joined
at a time.  A row lies in one task, so its chunks are counted there; other rows
go on in other tasks, and nothing is shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows may
repeat and null ids pass through; an empty table gives no rows; special strings are one token each, as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.byte_bpe import SAFE_CUT, ByteBpeFile, pieces, rows, special_pattern, tokenizer_path


class CountTransducer:
    """Deterministic automaton over bytes whose transitions carry emitted-token counts."""

    def __init__(self, spec: ByteBpeFile, max_states: int = 200_000) -> None:
        self.spec, self.max_states = spec, max_states
        self.starts = {t[:n] for t in spec.vocab for n in range(1, len(t) + 1)}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        # state: (suffix, last token at each place from before the suffix on, tokens emitted since that place)
        self.keys: list[tuple] = [(b"", (b"",), (0,))]
        self.ids: dict[tuple, int] = {self.keys[0]: 0}
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def _stay_apart(self, a: bytes, b: bytes) -> bool:
        if not a:
            return self.spec.merge(b) == [b]
        if (known := self.apart.get((a, b))) is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[a, b] = self.spec.merge(a + b) == [a, b]
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, since = self.keys[state]
        text = suffix + bytes((byte,))
        for at in range(len(text)):  # the longest token that ends here and stays apart
            token = text[at:]
            if token in self.spec.vocab and self._stay_apart(last[at], token):
                break
        delta = 1 - since[at]
        ends, counts = (*last, token), (*(n + delta for n in since), 0)
        while text and text not in self.starts:
            text, ends, counts = text[1:], ends[1:], counts[1:]
        # places whose text begins no token are forgotten, so that more texts share a state
        live = [at for at in range(len(text)) if text[at:] in self.starts] + [len(text)]
        base = len(ends) - len(text) - 1
        key = (text, tuple(ends[base + at] if at in live else None for at in range(len(text) + 1)), tuple(counts[base + at] if at in live else 0 for at in range(len(text) + 1)))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        self.arcs[state][byte] = to, delta
        return to, delta

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        if len(self.keys) > self.max_states:
            self._clear()
        state = total = 0
        arcs = self.arcs
        for byte in piece:
            arc = arcs[state].get(byte) or self._compile(state, byte)
            state = arc[0]
            total += arc[1]
        return total


class _Counts(dict):
    """Count by piece, kept within a bound."""

    def __init__(self, transducer: CountTransducer, bound: int = 600_000) -> None:
        super().__init__()
        self.transducer, self.bound = transducer, bound

    def __missing__(self, piece: str) -> int:
        n = self.transducer.count(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= self.bound:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    """Counts of whole texts, and state maps of chunks with their composition."""

    def __init__(self, path: str) -> None:
        spec = ByteBpeFile(path)
        self.special = special_pattern(spec.special)
        self.strings = set(spec.special)
        self.known = _Counts(CountTransducer(spec))
        self.first, self.last = regex.compile(SAFE_CUT), regex.compile("(?r)" + SAFE_CUT)

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.strings):
            parts = self.special.split(text)
            return sum(1 if p in self.strings else self._plain(p) for p in parts if p)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.known.__getitem__, pieces(text)))

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens between, tail); tail is None, and head the chunk, where no place cuts it safely.

        A special string holds no white space, so a safe place never lies inside one.
        """
        first = self.first.search(chunk)
        if first is None:
            return chunk, 0, None
        a, b = first.start(), self.last.search(chunk).start()
        return chunk[:a], self.count(chunk[a:b]) if b > a else 0, chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if x[2] is None:
            return self.state_map(x[0] + y[0]) if y[2] is None else (x[0] + y[0], y[1], y[2])
        if y[2] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.count(x[2] + y[0]) + y[1], y[2]

    def in_chunks(self, text: str, chars: int) -> int:
        """Tokens of a text by its chunks' maps; a text of one chunk is counted as it is."""
        if len(text) <= chars:
            return self.count(text)
        return self.scan([self.state_map(text[at : at + chars]) for at in range(0, len(text), chars)])

    def scan(self, maps: list[tuple]) -> int:
        """Tokens of the whole text: neighbours are composed, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.count(head) + between + (self.count(tail) if tail else 0)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(tokenizer: str) -> TokenCounter:
    """The worker's counter for a tokenizer's file."""
    path = tokenizer_path(tokenizer)
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_chars: int = 1 << 14,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row; columns other than the id and the text aren't read."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer)
        for batch in batches:
            n = [known.in_chunks(t, chunk_chars) for (t,) in rows(iter((batch,)), "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
