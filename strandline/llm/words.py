"""Words of many texts at once, as arrays: bounds, hashes and what they look like.

A word is a run of ASCII letters, digits and bytes above 127.  Its hash covers the text lower-cased
(A-Z and the Latin-1 capitals).  Texts are laid end to end and worked through in slabs, so memory
follows the slab and the number of words, not the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLAB = 2 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 63]] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _MULT, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    doc: np.ndarray        # index of the text
    start: np.ndarray      # byte offsets over all texts laid end to end, a line feed after each
    end: np.ndarray
    hash: np.ndarray
    number: np.ndarray     # digits only
    capital: np.ndarray    # starts with a capital
    opens: np.ndarray      # first word of a text, line or sentence
    data: bytes

    def __len__(self) -> int:
        return len(self.doc)

    def runs(self, n_docs: int) -> np.ndarray:
        """Where the words of each text begin, with the total at the end."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def _unspaced(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the characters of scripts written without spaces: those that begin with the bytes
    E2 BA to E9 (CJK and kana), EF A4 to EF BF (compatibility and full-width forms) or F0 A0 to F0 B3 (rare ideographs)."""
    after = np.concatenate([part[1:], np.zeros(1, dtype=np.uint8)])
    three = ((part >= 0xE3) & (part <= 0xE9)) | ((part == 0xE2) & (after >= 0xBA)) | ((part == 0xEF) & (after >= 0xA4))
    four = (part == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
    start = np.flatnonzero(three | four)
    return start, np.minimum(start + np.where(four[start], 4, 3), len(part))


def _slab(part: np.ndarray, unspaced: bool = False) -> list[np.ndarray]:
    word = _WORD[part]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if unspaced:
        a, b = _unspaced(part)
        # A word ends where such a character starts, and another one starts behind it.
        start, end = (np.union1d(start, np.concatenate([a, b[(b < len(part)) & word[np.minimum(b, len(part) - 1)]]])),
                      np.union1d(end, np.concatenate([b, a[(a > 0) & word[a - 1]]])))
    low = _FOLD[part]
    lead = np.flatnonzero(part[:-1] == 0xC3) + 1
    c = part[lead]
    low[lead[(c >= 0x80) & (c <= 0x9E) & (c != 0x97)]] += 32
    up, down = _powers(len(part) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(part)], dtype=np.uint64)])
    h = mix((total[end] - total[start]) * down[start])
    digit = np.concatenate([[0], np.cumsum((part >= 48) & (part <= 57))])
    number = digit[end] - digit[start] == end - start
    first = part[start]
    second = part[np.minimum(start + 1, len(part) - 1)] if len(part) else first
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stop = np.concatenate([[0], np.cumsum(_STOP[part])])
    before = np.concatenate([[0], end[:-1]]) if len(end) else end
    opens = stop[start] - stop[before] > 0
    return [start, end, h, number, capital, opens]


def scan(texts: list[str | None], *, unspaced: bool = False) -> Words:
    """The words of ``texts``; with ``unspaced``, each Chinese or Japanese character is a word of its own."""
    parts = [(t or "").encode() for t in texts]
    data = b"\n".join(parts) + b"\n"
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    doc_start = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if parts else np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    out: list[list[np.ndarray]] = []
    at = 0
    while at < len(raw):
        to = min(len(raw), at + SLAB)
        cut = to
        while cut < len(raw) and cut > at and _WORD[raw[cut - 1]]:
            cut -= 1
        while cut == at or (cut < len(raw) and _WORD[raw[cut - 1]]):  # one word longer than a slab
            to = min(len(raw), to + SLAB)
            gaps = np.flatnonzero(~_WORD[raw[at:to]])
            cut = at + int(gaps[-1]) + 1 if len(gaps) else to
            if to == len(raw):
                break
        found = _slab(raw[at:cut], unspaced)
        found[0], found[1] = found[0] + at, found[1] + at
        out.append(found)
        at = cut
    start, end, h, number, capital, opens = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, dtype=np.int64)] * 6
    doc = np.searchsorted(doc_start, start, "right") - 1
    # A slab begins inside a sentence: its first word opens one only if the bytes before say so.
    for found in out[1:]:
        if len(found[0]):
            k = int(np.searchsorted(start, found[0][0]))
            opens[k] = bool(_STOP[raw[(end[k - 1] if k else 0):start[k]]].any())
    if len(doc):
        opens[np.flatnonzero(np.diff(np.concatenate([[-1], doc])) > 0)] = True
    return Words(doc, start, end, h, number, capital, opens, data)


def word_hash(word: str) -> int:
    """The hash that ``scan`` gives this one word."""
    return int(scan([word]).hash[0])
