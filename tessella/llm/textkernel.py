"""Vectorised word work on Arrow text columns: places, 64-bit hashes and rolling windows of words, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WORD_BASE, SEED = U64(0xC2B2AE3D27D4EB4F | 1), 42
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
CHUNK = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64, for i below n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = U64(pow(int(base), -1, 1 << 64))
        n = max(n, 1 << 16)
        up, down = np.full(n, base, U64), np.full(n, inverse, U64)
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return have[0][:n], have[1][:n]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of data at once, shorter ones dropping out as the longer go on."""
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    at8, at4 = np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,)), np.ndarray((len(buf) - 3,), "<u4", buf.data, strides=(1,))
    # 16 bits are sorted by radix.
    order = np.argsort(length if length.max(initial=0) >> 16 else length.astype(np.uint16), kind="stable")
    pos, size = start[order].astype(np.int64), length[order].astype(np.int64)
    end = pos + size
    wrap = lambda *x: U64(sum(map(int, x)) % 2**64)
    s = U64(seed)
    h = np.full(len(pos), wrap(s, P5), U64)
    lane = lambda x: _rotl(x * P2, 31) * P1
    big = int(np.searchsorted(size, 32))
    if big < len(pos):
        acc = [np.full(len(pos) - big, v, U64) for v in (wrap(s, P1, P2), wrap(s, P2), s, wrap(s, -int(P1)))]
        p, stripes = pos[big:], size[big:] // 32
        for k in range(int(stripes[-1])):
            f = int(np.searchsorted(stripes, k, "right"))
            for j in range(4):
                acc[j][f:] = _rotl(acc[j][f:] + at8[p[f:] + 32 * k + 8 * j] * P2, 31) * P1
        v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            v = (v ^ lane(a)) * P1 + P4
        h[big:] = v
        pos[big:] += 32 * stripes
    h += size.astype(U64)
    for _ in range(3):
        i = np.flatnonzero(end - pos >= 8)
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ lane(at8[pos[i]]), 27) * P1 + P4
        pos[i] += 8
    i = np.flatnonzero(end - pos >= 4)
    h[i] = _rotl(h[i] ^ (at4[pos[i]].astype(U64) * P1), 23) * P2 + P3
    pos[i] += 4
    for _ in range(3):
        i = np.flatnonzero(end > pos)
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ (buf[pos[i]].astype(U64) * P5), 11) * P1
        pos[i] += 1
    h ^= h >> U64(33)
    h *= P2
    h ^= h >> U64(29)
    h *= P3
    h ^= h >> U64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


class Words:
    """The words of a run of texts: starts, ends (bytes in buf), doc (row), and per row the first word's place in at."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, n = buf, offsets, len(buf)
        inside = ~((buf == 32) | ((buf - np.uint8(9)) < 5))
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        first, last = offsets[:-1], offsets[1:] - 1
        full = last >= first
        before[first[full]] = after[last[full]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.at))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """XXH64 of each word, or of its first `most` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return xxh64(self.buf, self.starts, ends - self.starts)


def spaced(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by single spaces, with each word's start and end there."""
    size = w.ends - w.starts
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    shift = np.repeat(start - w.starts, size)
    from_ = np.repeat(w.starts, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    out[from_ + shift] = w.buf[from_]
    return out, start, start + size


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def rolling(h: np.ndarray, w: int) -> np.ndarray:
    """Hash of each w consecutive word hashes (also across texts: see together())."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(WORD_BASE, len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[w:] - sums[:-w]) * down[:n] + U64(w))


def together(doc: np.ndarray, w: int) -> np.ndarray:
    """Which of those windows lie in one text."""
    return doc[w - 1 :] == doc[: max(0, len(doc) - w + 1)]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) of runs of rows of at most limit bytes, or of one longer row. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
