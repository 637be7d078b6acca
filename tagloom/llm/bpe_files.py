"""Public tokenizer files and what is cached of them in each Python worker.

The files lie outside the repository; their path is a parameter of every operator.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import regex


@lru_cache(maxsize=4)
def pattern() -> regex.Pattern:
    """The public pre-tokenizer pattern with the white-space class the reference libraries use.

    Python's ``\\s`` also holds U+001C to U+001F, which are no White_Space in Unicode.
    """
    space = r"\p{White_Space}"
    p = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"{space}+(?!\P{{White_Space}})").replace(r"|\s+", rf"|{space}+")
    return regex.compile(p)


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The inverse of the printable stand-ins for bytes in .json vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> tuple[dict[tuple[bytes, bytes], int], tuple[str, ...]]:
    """(left, right) -> rank of a .json byte-level BPE file, and its special strings."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    back = byte_of_char()
    raw = lambda s: bytes(back[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    return {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}, tuple(t["content"] for t in file["added_tokens"])


@lru_cache(maxsize=2)
def token_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memory(dict):
    """A bounded memo: ``self[piece]`` computes what is missing; the older half goes when it is full."""

    def __init__(self, make, most: int = 1 << 18):
        super().__init__()
        self.make, self.most, self.longest = make, most, 64

    def __missing__(self, piece):
        made = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                for key in list(self)[: self.most // 2]:
                    del self[key]
            self[piece] = made
        return made


#: A space that is no safe cut: more white space follows it, or the end.
IRREGULAR = re.compile(r" (?:\s|$)")
#: A longer run of spaceless characters is not remembered; texts are cut into about so many characters.
BLOCK = 1 << 20


def blocks(text: str) -> Iterator[str]:
    """``text`` in blocks cut before a space that a character other than white space follows.

    There every match of the pattern ends: what is before is matched as at the end of a text, and
    the space opens the next match.  So block by block is the same as the whole text.
    """
    at, n = 0, len(text)
    while n - at > 2 * BLOCK:
        cut = text.find(" ", at + BLOCK)
        while 0 <= cut and (cut + 1 >= n or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Chunks:
    """Sums or joins over the matches of a text, by memo of whole space-delimited chunks.

    ``one``: what a match gives; ``fold``: what an iterable of such gives (for instance sum).
    """

    def __init__(self, one: Callable, fold: Callable, most: int):
        self.pieces = Memory(one, most)
        self.fold = fold
        self.chunks = Memory(lambda part: self.matched(" " + part), most)
        self.chunks.longest = 24

    def matched(self, text: str):
        return self.fold(map(self.pieces.__getitem__, pattern().findall(text)))

    def each(self, text: str) -> Iterator:
        """Partial results in the order of the text."""
        if not text:
            return
        for block in blocks(text) if len(text) > 2 * BLOCK else (text,):
            if IRREGULAR.search(block):
                yield self.matched(block)
                continue
            first, *rest = block.split(" ")
            if first:
                yield self.matched(first)
            yield from map(self.chunks.__getitem__, rest)
