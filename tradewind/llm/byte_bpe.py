"""What token counting and packing share: a byte-level BPE tokenizer's file and its cut into pieces.

The tokenizer's own pattern cuts a text into pieces, and no token crosses a
piece.  A piece ends before every white-space character that follows another
kind of character, whatever stands around it: such places cut a text safely.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex

#: The tokenizer's pattern for pieces (a fixed value of the public file format), words first; and what it is on ASCII.
PIECES = regex.compile(r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PIECES = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
SAFE_CUT = r"(?<=\S)(?=\s)"


def tokenizer_path(name: str) -> str:
    """Where the executor's installation keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Byte by the printable letter that stands for it in byte-level vocabularies.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpeFile:
    """Vocabulary, merge ranks and special strings of a tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE file with the usual pattern and no normaliser is needed")
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.vocab = {plain(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(plain(a), plain(b)): r for r, (a, b) in enumerate(pairs)}

    def merge(self, piece: bytes) -> list[bytes]:
        """Tokens of a short byte string by the merge rule: the lowest rank first, the leftmost of equals."""
        parts, rank = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def pieces(text: str) -> list[str]:
    """A text without special strings, cut by the tokenizer's pattern."""
    return (ASCII_PIECES if text.isascii() else PIECES).findall(text)


def special_pattern(special: dict[str, int]) -> regex.Pattern | None:
    """A pattern that splits special strings off, if there are any."""
    strings = sorted(special, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def groups(found: Iterator[tuple], chars: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows whose last value is a text, gathered up to a number of characters."""
    some, size = [], 0
    for row in found:
        some.append(row)
        size += len(row[-1] or "") + 64
        if size > chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def holes(values: list) -> list[int]:
    """The places of None."""
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out
