"""Vectorised word and n-gram hashes over many texts at once (NumPy, no loop over words)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Odd bases, so that powers have inverses modulo 2**64: for bytes, and two for words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; kept for the next call."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(prefix: np.ndarray, down: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    return (prefix[stop] - prefix[start]) * down[start]


class Words:
    """Words of many texts: hash, length and last byte, text number; each text's first word and number of words."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8) if texts else np.zeros(0, dtype=np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, white, True].astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        up, down = powers(BASES[0], len(data) + 1)
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=prefix[1:])
        self.hash = mix(spans(prefix, down, start, stop) ^ (stop - start).astype(np.uint64))
        self.size, self.last = stop - start, data[stop - 1] if len(stop) else np.zeros(0, dtype=np.uint8)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = np.searchsorted(start, offsets)
        self.first, self.count = at[:-1], np.diff(at)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def ngrams(self, n: int, base: int = BASES[1]) -> np.ndarray:
        """Hash of the n words from each word on; meaningful only where they are of one text (see ``whole``)."""
        size = len(self.hash)
        if size < n:
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(base, size + 1)
        prefix = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:-1], out=prefix[1:])
        return mix((prefix[n:] - prefix[: size + 1 - n]) * down[: size + 1 - n])

    def whole(self, n: int) -> np.ndarray:
        """True where n words of the same text start."""
        size = len(self.hash)
        return self.doc[n - 1 :] == self.doc[: size + 1 - n] if size >= n else np.zeros(0, dtype=bool)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    out, have = values, 1
    steps = [(1, values)]
    while have * 2 <= width:
        out = pick(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
        steps.append((have, out))
    if have < width:
        rest = width - have
        size = max(0, len(values) - width + 1)
        out = pick(out[:size], out[rest : rest + size])
    return out
