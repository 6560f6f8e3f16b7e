"""Hashed words and word shingles of many texts at once, in NumPy."""

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int):
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts; ends[i] words belong to texts up to i."""
    raw = [t.encode() for t in texts]
    b = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    gap = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(b))
    total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)
    hashes = mix((total[end - 1] - total[begin - 1]) * inverse[begin])
    limit = np.cumsum([len(r) + 1 for r in raw]) if raw else np.empty(0, int)
    return hashes, np.searchsorted(begin, limit)


def shingles(h: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, values) of one text's runs of WORDS words, or of all its words if it has fewer; value: of each word, a
    shingle's is the mean of its words'."""
    n = min(WORDS, len(h))
    if not n:
        return h[:0], value[:0]
    m = len(h) - n + 1
    out, mean = np.zeros(m, np.uint64), np.zeros(m, np.float32)
    for i in range(n):
        out += h[i : i + m] * _MIX[i]
        mean += value[i : i + m]
    return mix(out), mean / n


class Numbers:
    """Numbers of distinct 64-bit hashes (none is 0) in a table with open addressing, all looked up at once."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.number = np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.number[slot[hit]]
            more = ~hit & (key != 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """Numbers hashes that find() doesn't know, from first on."""
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            alone = np.zeros(len(todo), bool)
            alone[np.unique(slot, return_index=True)[1]] = True
            put = free & alone
            self.keys[slot[put]] = h[todo[put]]
            self.number[slot[put]] = first + todo[put]
            todo, slot = todo[~put], np.where(free, slot, (slot + 1) & ((1 << self.bits) - 1))[~put]
