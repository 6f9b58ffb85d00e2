"""Sets of word n-grams of texts, as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_GAP] = 0
_STEP = 0x9E3779B97F4A7C15
_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the step and of its inverse, as many as were asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            n = max(n, 1 << 14)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _STEP, np.uint64)]))
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(_STEP, -1, 2**64), np.uint64)]))
        return cls.up, cls.down


def _pieces(data: bytes):
    """A text in pieces that end between words."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut < at:  # a word longer than a piece
            ends = [e for e in (data.find(c, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if e >= 0]
            cut = min(ends, default=len(data) - 1)
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:]


class Words:
    """The words of a piece of lower-cased UTF-8: where each starts and ends, and hashes of any bytes of the piece."""

    def __init__(self, piece: bytes):
        self.data = np.frombuffer(piece, np.uint8)
        gap = np.concatenate([[True], _GAP[self.data], [True]])
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = turn[0::2], turn[1::2]
        up, self._down = _Powers.of(len(self.data))
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.data] * up[: len(self.data)])])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each start to its end."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, A-Z lower-cased."""
    if not text:
        return np.zeros(0, np.uint64)
    found = [Words(piece) for piece in _pieces(text.encode("utf-8", "surrogatepass").lower())]
    out = [w.hashes(w.start, w.end) for w in found]
    return out[0] if len(out) == 1 else np.concatenate(out)


def pieces_of(texts: list[str | None]):
    """(numbers of the texts, piece) of texts, A-Z lower-cased, as UTF-8: short texts together, a newline between them, long ones in pieces that end between words.

    numbers: for a piece of several texts the place in it where each begins, as pairs (text, place).
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if held and size + len(data) > PIECE:
            yield _together(held)
            held, size = [], 0
        if len(data) > PIECE:
            for piece in _pieces(data):
                yield [(i, 0)], piece
        elif data:
            held.append((i, data))
            size += len(data) + 1
    if held:
        yield _together(held)


def _together(held: list[tuple[int, bytes]]) -> tuple[list[tuple[int, int]], bytes]:
    at, places = 0, []
    for i, data in held:
        places.append((i, at))
        at += len(data) + 1
    return places, b"\n".join(d for _, d in held)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted set of a text's shingles; all its words as one, if it has fewer than width; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _MIX[i]
    return np.unique(mix(h + np.uint64(k)))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums over a set."""
    a, b = mix(shingles * _MIX[14]).sum(dtype=np.uint64), mix(shingles ^ _MIX[15]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
