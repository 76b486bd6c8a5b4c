"""Words of many texts at once, as 64-bit hashes in numpy arrays: no Python step for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240607)
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd multiplier, so it has an inverse modulo 2^64.
RATIO = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(RATIO), -1, 1 << 64))
#: Separators between words: ASCII white space; or everything but ASCII letters, digits and bytes of other scripts.
_ascii = np.arange(256)
IS_SPACE = np.isin(_ascii, [0, 9, 10, 11, 12, 13, 32])
IS_BREAK = ~(((_ascii >= 48) & (_ascii <= 57)) | ((_ascii >= 97) & (_ascii <= 122)) | ((_ascii >= 65) & (_ascii <= 90)) | (_ascii >= 128))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out, step = np.ones(1, np.uint64), int(base)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & (1 << 64) - 1
    return out[:n]


@dataclass
class Words:
    """Hashes of the words of a list of texts, one after another, with byte spans in the joined buffer."""

    hash: np.ndarray
    first: np.ndarray  # word index at which each text begins, and the end
    start: np.ndarray  # byte span of each word in buf
    end: np.ndarray
    buf: np.ndarray
    origin: np.ndarray  # byte at which each text begins in buf, and the end

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def words(texts: list[bytes], breaks: np.ndarray = IS_SPACE) -> Words:
    """Words of UTF-8 texts; equal words have equal hashes wherever they stand."""
    joined = b"\0".join(texts) + b"\0"
    buf = np.frombuffer(joined, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    origin = np.concatenate([[0], np.cumsum(size)]) if len(texts) else np.zeros(1, np.int64)
    sep = breaks[buf]
    sep[origin[1:] - 1] = True
    inside = ~sep
    prev = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & ~prev)
    end = np.flatnonzero(sep & prev)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_KEYS[buf] * powers(RATIO, len(buf)), dtype=np.uint64)])
    h = (sums[end] - sums[start]) * powers(INVERSE, len(buf))[start] if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, origin)
    return Words(mix(h), first, start, end, buf, origin)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words, and where each text's begin. A text of fewer than n words, but some, has one shingle of all of them."""
    h, first = w.hash, w.first
    count = w.count()
    total = len(h)
    run = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n):
        run = run * RATIO + h[k : k + len(run)]
    many = np.maximum(count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    pos = np.repeat(first[:-1] - at[:-1], many) + np.arange(at[-1])
    out = run[np.minimum(pos, len(run) - 1)] if len(run) else np.zeros(at[-1], np.uint64)
    for d in np.flatnonzero((count > 0) & (count < n)):
        x = int(count[d])
        for v in h[first[d] : first[d + 1]].tolist():
            x = x * int(RATIO) + v & (1 << 64) - 1
        out[at[d]] = np.uint64(x)
    return mix(out), at
