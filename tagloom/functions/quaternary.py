"""Quaternary Hamming codes: tags over four bases that correct one substitution."""

from __future__ import annotations

from itertools import product

CODE = "ATCG"


def parity_positions(size: int) -> list[int]:
    """Powers of two up to ``size``; positions count from 1."""
    return [1 << k for k in range(size.bit_length()) if 1 << k <= size]


def tag_size(messages: int) -> int:
    """The shortest tag whose message positions can tell that many messages apart."""
    m = 1
    while 4**m < messages:
        m += 1
    p = 1
    while 2**p < m + p + 1:
        p += 1
    return m + p


def encode(message: list[int], extra: bool = True) -> str:
    """The tag of a message of digits 0 to 3: parity digits make every covered sum 0 modulo 4.

    With ``extra`` a digit over all others leads, which tells one error from two.
    """
    size = len(message)
    while size - len(parity_positions(size)) < len(message):
        size += 1
    word = [0] * (size + 1)
    rest = iter(message)
    for i in range(1, size + 1):
        if i & (i - 1):
            word[i] = next(rest)
    for p in parity_positions(size):
        word[p] = -sum(word[i] for i in range(1, size + 1) if i & p and i != p) % 4
    if extra:
        word[0] = -sum(word[1:]) % 4
    return "".join(CODE[x] for x in (word if extra else word[1:]))


def correct(tag: str, extra: bool = True) -> str | None:
    """The nearest code word; None if more than one base is wrong (as far as the code can tell)."""
    word = [CODE.find(c) for c in tag]
    if min(word, default=-1) < 0:
        return None
    word = word if extra else [0, *word]
    size = len(word) - 1
    at, values = 0, set()
    for p in parity_positions(size):
        off = sum(word[i] for i in range(1, size + 1) if i & p) % 4
        if off:
            at |= p
            values.add(off)
    overall = sum(word) % 4 if extra else None
    if not at:
        if extra and overall:
            word[0] = (word[0] - overall) % 4
        return "".join(CODE[x] for x in (word if extra else word[1:]))
    if len(values) > 1 or at > size or (extra and overall not in values):
        return None
    word[at] = (word[at] - values.pop()) % 4
    return "".join(CODE[x] for x in (word if extra else word[1:]))


def all_tags(count: int, size: int | None = None, extra: bool = True) -> list[str]:
    """The first ``count`` code words of the (shortest fitting) size, without the leading digit in ``size``."""
    size = size or tag_size(count)
    digits = size - len(parity_positions(size))
    if 4**digits < count:
        raise ValueError(f"{size} bases hold {4**digits} tags, not {count}")
    out = []
    for message in product(range(4), repeat=digits):
        if len(out) == count:
            break
        out.append(encode(list(message), extra))
    return out
