"""Words of texts as 64-bit hashes, made with numpy on UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Those bytes occur in no multi-byte
UTF-8 sequence, so words of bytes are words of code points. The hash of a word is a polynomial in
its bytes modulo 2**64, taken from prefix sums and freed of the word's position by the inverse of
the base, then mixed; it depends on the word alone and is the same on every executor.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []

#: By byte: white space, which ends a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: By byte: all ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _SEGMENT + 4096)
        new = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            new.append(np.cumprod(p))
        _powers[:] = new
    return _powers[0], _powers[1]


def _segments(data: np.ndarray, ends: np.ndarray):
    """(begin, end) of segments that end behind a byte which ends words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _SEGMENT)
        while end < len(data):
            gap = np.flatnonzero(ends[data[end : end + 65536]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(len(data), end + 65536)
        yield at, end
        at = end


def _hash_segment(b: np.ndarray, lower: bool, ends: np.ndarray, prefixes: tuple[int, ...]):
    """(starts, ends, hashes, hashes of prefixes by length) of the words in `b`."""
    step = np.diff(np.concatenate(([True], ends[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    v = b.astype(np.uint64) + np.uint64(1)
    if lower:
        v[(b >= 65) & (b <= 90)] += np.uint64(32)
    power, inverse = _tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(v * power[: len(b)], out=sums[1:])
    free = inverse[start]
    heads = []
    for k in prefixes:
        head = mix((sums[np.minimum(start + k, end)] - sums[start]) * free + np.uint64(k << 32))
        heads.append(np.where(end - start > k, head, np.uint64(0)))
    return start, end, mix((sums[end] - sums[start]) * free + (end - start).astype(np.uint64)), heads


class Words:
    """The words of some texts: those of text i are at offsets[i]:offsets[i + 1] of each array.

    hashes: 64-bit; lengths: in code points, if asked for; prefixes: for each length k asked for,
    hashes of the words' first k bytes, 0 where a word has no more than k. Texts are taken together
    and cut behind word ends into segments of about a megabyte, so memory beyond the texts and
    these arrays is that of one segment, or of the longest word."""

    def __init__(self, texts: list[str], lower: bool = True, ends: np.ndarray = SPACE, lengths: bool = False, prefixes: tuple[int, ...] = ()):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        begins = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=begins[1:])
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        found: list[tuple] = []
        for at, to in _segments(data, ends):
            b = data[at:to]
            start, end, h, heads = _hash_segment(b, lower, ends, prefixes)
            size = np.empty(0, np.int64)
            if lengths:
                points = np.zeros(len(b) + 1, np.int64)
                np.cumsum((b & 0xC0) != 0x80, out=points[1:])
                size = points[end] - points[start]
            found.append((start + at, h, size, *heads))
        start, self.hashes, self.lengths, *self.prefixes = map(np.concatenate, zip(*found, strict=True))
        self.offsets = np.searchsorted(start, begins)


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    w = Words(texts, lower)
    return w.hashes, w.offsets


def hash_of(word: str) -> int:
    """The hash of one word; A-Z are lowered."""
    return int(word_hashes([word])[0][0])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of `n` consecutive words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _M2 + h[i : len(h) - n + 1 + i]
    return mix(out)
