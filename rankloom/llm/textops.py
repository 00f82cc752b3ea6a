"""Vectorised text helpers for the operators of this subpackage.

Texts are handled as one UTF-8 byte buffer per chunk (several short texts, or
one long text), so that numpy passes replace per-word Python. All hashes are
deterministic across processes: polynomial hashes modulo 2**64 over a fixed
random byte table, finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand."""
    have = _POW.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 2)
        both = []
        for b in (_BASE, _INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 16 * CHUNK_BYTES:      # of one very long text: not kept
            return both[0], both[1]
        have = _POW["p"] = (both[0], both[1])
    return have


class Rolling:
    """Hashes of any slices of a uint64 sequence in constant time each."""

    def __init__(self, values: np.ndarray):
        pw, self._inv = _powers(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * pw[:len(values)], out=self._sum[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inv[start])

    def windows(self, m: int) -> np.ndarray:
        """Hash of every slice of ``m`` values, by its start."""
        s, n = self._sum, len(self._sum) - m
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((s[m:] - s[:-m]) * self._inv[:n])


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Split texts (bytes) into runs of about ``limit`` bytes: yields
    ``(first, last)`` index pairs; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def encode(values) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        word = ~_SPACE[self.buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(lens + 1)
        self.text_start = self.text_end - lens - 1
        #: of each text: its first word and one past its last
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)
        self.count = self.last - self.first

    def hashes(self, lower: bool = False) -> np.ndarray:
        buf = self.buf
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        return Rolling(_TABLE[buf]).slices(self.start, self.end)

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum in each window of ``w`` keys (the leftmost of
    equal ones, comparing the upper 40 bits)."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = max(24, int(len(keys)).bit_length())
    low = np.uint64((1 << bits) - 1)
    x = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < w:
        x = np.minimum(x[:n], x[w - size:w - size + n])
    return (x[:n] & low).astype(np.int64)


def seeds(values: np.ndarray, owner: np.ndarray, k: int, window: int):
    """Content-defined cover of all windows of ``window`` values.

    Each window inside one owner is assigned the smallest-hash ``k``-gram in
    it. Equal windows choose the same ``k``-gram at the same offset, so equal
    windows always share a seed. Returns, per chosen seed: its position, hash,
    the first window it stands for, and how many (consecutive) windows.
    """
    none = np.zeros(0, np.int64)
    if len(values) < window:
        return none, none.astype(np.uint64), none, none
    roll = Rolling(values)
    grams = roll.windows(k)
    pos = sliding_argmin(grams, window - k + 1)
    inside = owner[:len(pos)] == owner[window - 1:window - 1 + len(pos)]
    win = np.flatnonzero(inside)
    if not len(win):
        return none, none.astype(np.uint64), none, none
    at = pos[win]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (win[1:] != win[:-1] + 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(win)])))
    return at[first], grams[at[first]], win[first], n
