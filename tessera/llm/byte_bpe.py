"""Ids of a byte-level BPE tokenizer file, by the tokenizers library, with a memory of chunks seen before.

The tokenizer's pre-tokenizer always starts a new token at a space that a non-space follows, so the ids of a text are
those of its chunks between such spaces, joined. Each chunk is encoded by the library once per worker; after that it is
found by a hash of its bytes and compared byte by byte, all chunks of a block of texts at once.
"""

import json
import os

import numpy as np

from .shingles import Numbers, _powers_to, mix

#: Chunks remembered by one Python worker, then it starts anew; and the slots of their table. 150 MB at most.
MEMORY = 1_500_000
SLOT_BITS = 22
#: New chunks are encoded in one go up to so many bytes, and texts looked up.
GO = 1 << 16
BLOCK = 1 << 21
#: What may follow a space where a chunk begins: printable ASCII, and first bytes of characters none of which is white.
_STARTS = np.zeros(256, bool)
_STARTS[0x21:0x7F] = True
_STARTS[0xC3:0xF5] = True
_STARTS[[0xE1, 0xE2, 0xE3]] = False
_loaded: dict[str, "ByteBpe"] = {}


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., size[0] numbers of it, then those of begin[1], and so on."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - (end - size), size)


class Memory:
    """Chunks with their ids: entry numbers by hash, and pools of their bytes and ids."""

    def __init__(self):
        self.numbers = Numbers(SLOT_BITS)
        self.n = 0
        self.pools = {"byte": np.empty(1 << 20, np.uint8), "id": np.empty(1 << 20, np.uint32)}
        self.used = {"byte": 0, "id": 0}
        self.begin = {k: np.empty(1 << 16, np.int64) for k in self.pools}
        self.size = {k: np.empty(1 << 16, np.int64) for k in self.pools}

    def add(self, h: np.ndarray, chunks: list[bytes], ids: list[bytes]) -> None:
        """Distinct hashes that numbers doesn't know."""
        for kind, parts in (("byte", chunks), ("id", ids)):
            flat = np.frombuffer(b"".join(parts), self.pools[kind].dtype)
            size = np.array([len(p) for p in parts], np.int64) // flat.itemsize
            at, m = self.used[kind], self.n + len(parts)
            self.pools[kind] = _room(self.pools[kind], at + len(flat))
            self.pools[kind][at : at + len(flat)] = flat
            for table, values in ((self.begin, at + np.cumsum(size) - size), (self.size, size)):
                table[kind] = _room(table[kind], m)
                table[kind][self.n : m] = values
            self.used[kind] = at + len(flat)
        self.numbers.add(h, self.n)
        self.n += len(h)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.empty(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.memory = Memory()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks that begin with a space, encoded joined; a byte-level token has a character for each byte."""
        out, at = [], 0
        while at < len(chunks):
            group, held = [], 0
            while at < len(chunks) and held < GO:
                group.append(chunks[at])
                held += len(group[-1])
                at += 1
            raw = self._ids([b"".join(group).decode()])[0]
            ends = np.cumsum(self.bytes_of[np.frombuffer(raw, "<u4")])
            stops = 4 * (np.searchsorted(ends, np.cumsum([len(g) for g in group]), "left") + 1)
            out += [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        return out

    def _look_up(self, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks of b one after another, how many each has)."""
        power, inverse = _powers_to(len(b) + 1)
        total = np.r_[np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])]
        h = mix((total[begin + size] - total[begin]) * inverse[begin]) | np.uint64(1)
        m = self.memory
        entry = m.numbers.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            found, first = np.unique(h[new], return_index=True)
            first = new[first]
            chunks = [b[x : x + n].tobytes() for x, n in zip(begin[first].tolist(), size[first].tolist())]
            m.add(found, chunks, self._encode(chunks))
            entry[new] = m.numbers.find(h[new])
        n_ids = m.size["id"][entry]
        same = m.size["byte"][entry] == size
        right = m.pools["byte"][spread(m.begin["byte"][entry[same]], size[same])] == b[spread(begin[same], size[same])]
        ends = np.cumsum(size[same])
        wrong = np.r_[np.flatnonzero(~same), np.flatnonzero(same)[np.unique(np.searchsorted(ends, np.flatnonzero(~right), "right"))]]
        if not len(wrong):
            return m.pools["id"][spread(m.begin["id"][entry], n_ids)], n_ids
        # Two chunks with one hash: these few are encoded anew.
        own = dict(zip(wrong.tolist(), self._encode([b[begin[i] : begin[i] + size[i]].tobytes() for i in wrong])))
        parts = [np.frombuffer(own[i], "<u4") if i in own else m.pools["id"][x : x + n] for i, (x, n) in enumerate(zip(m.begin["id"][entry].tolist(), n_ids.tolist()))]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text: its ids as little-endian unsigned 32-bit integers."""
        if self.memory.n > MEMORY:
            self.memory = Memory()
        # Added tokens are cut out before anything else, so texts that hold one go to the library whole.
        special = [any(a in t for a in self.added) for t in texts]
        raw = [b"" if s else t.encode() for t, s in zip(texts, special)]
        b = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        start = np.cumsum(sizes + 1) - sizes - 1
        begin = np.flatnonzero((b[:-1] == 32) & _STARTS[b[1:]])
        upto = np.searchsorted(begin, start + sizes)  # chunks of texts up to each
        before = np.r_[0, upto[:-1]]
        following = np.r_[begin[1:], len(b)] if len(begin) else begin
        end = np.minimum(following, (start + sizes)[np.searchsorted(start, begin, "right") - 1]) if len(begin) else begin
        stop = np.where(upto > before, begin[np.minimum(before, max(0, len(begin) - 1))] if len(begin) else 0, start + sizes)
        heads = self._ids([t if s else r[: int(x)].decode() for t, s, r, x in zip(texts, special, raw, stop - start)])
        flat, counts, lo = [], [], 0
        while lo < len(begin):  # a block of chunks at a time
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + BLOCK, "right")))
            ids, n = self._look_up(b[begin[lo] : end[hi - 1]], begin[lo:hi] - begin[lo], end[lo:hi] - begin[lo:hi])
            flat.append(ids)
            counts.append(n)
            lo = hi
        ids = np.concatenate([np.empty(0, np.uint32), *flat]).astype("<u4")
        at = np.r_[0, np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))]
        return [h + ids[x:y].tobytes() for h, x, y in zip(heads, at[before].tolist(), at[upto].tolist())]


def byte_bpe(path: str) -> ByteBpe:
    """The worker's own encoder for this file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
