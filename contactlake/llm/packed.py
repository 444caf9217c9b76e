"""Many texts in one byte array: word, line and k-gram hashes with numpy.

Texts lie one after the other as UTF-8, each followed by a line feed.  Every
place j has the word w_j of the eight bytes from there; ``H[i] = sum_{j<i}
scatter(w_j) * M**j (mod 2**64)`` gives the hash of a string of eight bytes and
more as ``(H[end-7] - H[start]) * M**-start``, a shorter one is its own word;
``mix`` finishes it.  ``scatter`` is not linear, so strings built to cancel out
in a polynomial of their bytes (Thue-Morse words) do not here.  Equal strings
always have equal hashes; unequal ones collide with about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
M = 0x9E3779B97F4A7C15 | 1
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_tables: dict = {}


def _folded() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    if "f" not in _tables:
        t = np.arange(256, dtype=np.uint8)
        t[65:91] += 32
        _tables["f"] = t
    return _tables["f"]


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, little-endian, zeros after the end."""
    w = np.zeros(len(buf) + 7, np.uint64)
    w[:len(buf)] = buf
    for shift in (1, 2, 4):
        w[:len(w) - shift] |= w[shift:] << U(8 * shift)
    return w[:len(buf)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**j and M**-j for j <= n."""
    have = _tables.get("p")
    if have is None or len(have[0]) <= n:
        out = []
        for base in (M, pow(M, -1, 2**64)):
            p = np.full(max(n + 1, 1 << 16), U(base), np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _tables["p"] = tuple(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and that of its next part."""
    return mix(a * U(0xD6E8FEB86659FD93) + b)


def word_bytes(letters_only: bool = False) -> np.ndarray:
    """Which bytes belong to words: all but the six ASCII space characters, or
    ASCII letters, digits and every byte of a non-ASCII character."""
    t = np.ones(256, bool)
    if letters_only:
        t[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            t[a:b] = True
    else:
        t[list(SPACES)] = False
    return t


class Packed:
    """``buf`` and, per text, [start, end) in it."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else sizes
        self.end = self.start + sizes
        self.n = len(texts)
        self._prefix: dict = {}

    @classmethod
    def unpacked(cls, raw: bytes, sizes: np.ndarray) -> "Packed":
        """From ``buf`` and the texts' sizes."""
        self = cls([])
        self.buf = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(sizes.astype(np.int64) + 1)
        self.end, self.start, self.n = ends - 1, ends - 1 - sizes, len(sizes)
        return self

    def part(self, first: int, stop: int) -> "Packed":
        """The texts first .. stop - 1 alone."""
        out = Packed([])
        a, b = self.start[first], self.end[stop - 1] + 1
        out.buf, out.start, out.end, out.n = self.buf[a:b], self.start[first:stop] - a, self.end[first:stop] - a, stop - first
        return out

    def _bytes(self, fold: bool) -> np.ndarray:
        return _folded()[self.buf] if fold else self.buf

    def prefix(self, fold: bool) -> np.ndarray:
        if fold not in self._prefix:
            n = len(self.buf)
            w = _words(self._bytes(fold))
            w *= U(0xD1342543DE82EF95)
            w ^= w >> U(32)
            w *= _powers(n)[0][:n]
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(w, out=h[1:])
            self._prefix[fold] = h
        return self._prefix[fold]

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
        h = self.prefix(fold)
        size = end - start
        out = (h[np.maximum(end - 7, start)] - h[start]) * _powers(len(self.buf))[1][start]
        short = np.flatnonzero(size < 8)
        if len(short):
            at = start[short, None] + np.arange(8)
            word = self._bytes(fold)[np.minimum(at, len(self.buf) - 1)].astype(np.uint64)
            word[np.arange(8) >= size[short, None]] = 0
            out[short] = (word << (U(8) * np.arange(8, dtype=np.uint64))).sum(1, dtype=np.uint64)
        return mix(out + size.astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k >= 8 bytes (also of those across two texts)."""
        h = self.prefix(False)
        n = max(0, len(self.buf) - k + 1)
        return mix((h[k - 7:k - 7 + n] - h[:n]) * _powers(len(self.buf))[1][:n])

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the maximal runs of member bytes."""
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = member[self.buf]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def text_of(self, position: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position."""
        return np.searchsorted(self.start, position, side="right") - 1

    def counts(self, member: np.ndarray) -> np.ndarray:
        """Member bytes in each text."""
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(member[self.buf], out=c[1:])
        return c[self.end] - c[self.start]


def texts_of(batch, column: str = "text") -> list[bytes]:
    import pyarrow as pa
    col = batch.column(batch.schema.get_field_index(column))
    return [b if b is not None else b"" for b in col.cast(pa.binary()).to_pylist()]


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted uint64 as differences, byte plane by byte plane (compresses well)."""
    d = np.diff(h, prepend=U(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width, which is the first byte."""
    top = int(c.max()) if len(c) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = np.ascontiguousarray(c.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def bounds(parts: int) -> np.ndarray:
    """Lower ends of ``parts`` equal ranges of the 64-bit hashes, but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
