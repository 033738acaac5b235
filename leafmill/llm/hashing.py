"""Words and word n-grams as 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """bytes -> 64-bit hash, remembered for up to `most` words; then the memory starts afresh."""

    def __init__(self, most: int = 1 << 20):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n ids, by doubling: a polynomial in _MULT, mixed; none if there are fewer than n ids."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    total = len(ids) - n + 1
    with np.errstate(over="ignore"):
        return mixed(_windows(ids, n, total) + np.uint64(n))


#: Longer words (in bytes) are hashed one by one.
_LONG_WORD = 64
_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, A-Z lowered, and where each text's begin, and the last's end.
    A word is hashed eight bytes at a time, all words at once."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n" + b"\n".join(parts).lower() + b"\n" * 9
    inside = ~_WHITE[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64) * _MULT
        some, done = np.arange(len(starts)), 0
        while len(some):
            out[some] = mixed(out[some] * _MULT + (eight[starts[some] + done] & _MASKS[np.minimum(size[some] - done, 8)]))
            done += 8
            some = some[(size[some] > done) & (size[some] <= _LONG_WORD)]
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + size[k]])
    begin = np.cumsum([1] + [len(p) + 1 for p in parts])
    return out, np.searchsorted(starts, begin)


def _windows(ids: np.ndarray, n: int, total: int) -> np.ndarray:
    out, done, block, width, power = np.zeros(total, dtype=np.uint64), 0, ids, 1, _MULT
    while done < n:
        if n & width:  # block holds hashes of windows of `width`
            out = out * power + block[done : done + total]
            done += width
        if done < n:
            block = block[:-width] * power + block[width:]
            power, width = power * power, 2 * width
    return out
