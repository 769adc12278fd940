"""Periodic runs: stretches of words that repeat with one period, found after masking what cannot be part of any.

A run of at least `least` words and two periods equals itself shifted by its period q, over length - q words. That overlap
is at least max(least - q, q), which is never below k = least / 2, rounded up: every word of a run lies in a k-word sequence
that its document holds twice. So words outside repeated k-grams are masked, what is left falls into segments (once more
masked by repeats inside the segment alone), and only segments of `least` words or more go to Main and Lorentz's halving:
at each middle, every period is extended to both sides, all middles of one depth and all segments at once. Extensions
compare rolling hashes of words; each run found is then compared word by word, and other hashes are taken should any differ.

Everything happens inside a document, so nothing is shuffled. A text takes about 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textkernel import U64, Words, chunks, mix, powers, rolling, spaced, together

LEAST = 12
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass
class Slices:
    """Slices of buf, as spaced() reads them."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _twice(key: np.ndarray) -> np.ndarray:
    """Which keys are there more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _segments(h: np.ndarray, group: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the stretches covered by k-grams that their group holds twice; windows lie in one group."""
    windows = np.flatnonzero(together(group, k))
    again = windows[_twice(mix(rolling(h, k)[windows] + group[windows].astype(U64) * U64(0x9E3779B97F4A7C15)))]
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + k, -1)
    covered = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0) | np.r_[False, covered[1:] & covered[:-1] & (group[1:] != group[:-1]), False])
    begin, end = (edge[:-1], edge[1:]) if len(edge) else (edge, edge)
    long = covered[begin] & (end - begin >= least) if len(begin) else np.zeros(0, bool)
    return begin[long], end[long]


def surviving(h: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of words (hashes h, documents doc) that may hold runs."""
    k = (least + 1) // 2
    group = doc.astype(np.int64)
    for _ in range(2):
        begin, end = _segments(h, group, k, least)
        # What lies outside is a group of one word each, which holds no window.
        group = -1 - np.arange(len(h), dtype=np.int64)
        for_ = np.repeat(np.arange(len(begin)), end - begin)
        group[_ranges(begin, end - begin)] = for_
    return begin, end


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, `size` of them, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Extensions:
    """How far two places of a sequence agree to the right and to the left, by hashes of stretches."""

    def __init__(self, x: np.ndarray, longest: int, seed: int):
        self.n, self.steps = len(x), int(longest).bit_length()
        self.base = U64((int(mix(np.array([seed], U64))[0]) | 1) & (2**64 - 1))
        up, self.down = powers(self.base, len(x) + 1)
        self.sums = np.zeros(len(x) + 1, U64)
        np.cumsum(mix(x.astype(U64) + U64(seed)) * up[: len(x)], out=self.sums[1:])

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[a + size] - self.sums[a]) * self.down[a] == (self.sums[b + size] - self.sums[b]) * self.down[b]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from a and from b > a."""
        out = np.zeros(len(a), np.int64)
        for j in range(self.steps, -1, -1):
            more = out + (1 << j)
            i = np.flatnonzero(b + more <= self.n)
            out[i[self._same(a[i], b[i], more[i])]] += 1 << j
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch up to a and up to b > a, both included."""
        out = np.zeros(len(a), np.int64)
        for j in range(self.steps, -1, -1):
            more = out + (1 << j)
            i = np.flatnonzero(a + 1 - more >= 0)
            out[i[self._same(a[i] + 1 - more[i], b[i] + 1 - more[i], more[i])]] += 1 << j
        return out


def _least_period(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) of one stretch, the one of the least period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)]]


def halving(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, seed: int = 1) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs in x[begin:end] of each segment; segments are parted by unique values."""
    reach = Extensions(x, int((end - begin).max(initial=1)), seed)
    found = []
    lo, hi = begin, end
    while len(lo):
        mid = (lo + hi) // 2
        for size, to_right in ((hi - mid, True), (mid - lo, False)):
            q = _ranges(np.ones(len(mid), np.int64), size)
            m = np.repeat(mid, size)
            a, b = (m, m + q) if to_right else (m - q, m)
            # A run that crosses the middle has the words left of a and b alike, or those right of them.
            i = np.flatnonzero(x[a - 1] == x[b - 1] if to_right else x[a] == x[b])
            a, b, q = a[i], b[i], q[i]
            right, left = reach.right(a, b), reach.left(a - 1, b - 1)
            i = np.flatnonzero((right + left >= q) & (b - a + right + left >= least))
            found.append(_least_period(np.stack([a[i] - left[i], b[i] + right[i], q[i]], 1)))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        wide = hi - lo >= least
        lo, hi = lo[wide], hi[wide]
    rows = _least_period(np.concatenate(found))
    size = rows[:, 1] - rows[:, 0] - rows[:, 2]
    at = _ranges(rows[:, 0], size)
    if (x[at] != x[at + np.repeat(rows[:, 2], size)]).any():
        return halving(x, begin, end, least, seed + 1)
    return rows


def runs_of(w: Words, src: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) by start, then period, in numbers of w's words; word i counts as word src[i]."""
    if not len(src):
        return np.zeros((0, 3), np.int64)
    begin, end = surviving(w.hashes()[src], w.doc, least)
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    size = end - begin
    at = src[_ranges(begin, size)]
    # Words as numbers, told apart by their bytes.
    bytes_ = w.ends[at] - w.starts[at]
    letters = w.buf[_ranges(w.starts[at], bytes_)]
    told = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, np.cumsum(bytes_)].astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
    own = np.cumsum(size + 1) - size - 1  # each segment ends in a value of its own
    x = np.empty(int(size.sum()) + len(size) + 1, np.int64)
    x[_ranges(own + 1, size)] = told.indices.to_numpy()
    x[np.r_[0, own + size + 1]] = len(told.dictionary) + np.arange(len(size) + 1)
    rows = halving(x, own + 1, own + 1 + size, least)
    shift = (begin - own - 1)[np.searchsorted(own, rows[:, 0], "left") - 1]
    rows[:, :2] += shift[:, None]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those outside runs, and each run's first period."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    return np.cumsum(gone[:-1]) == 0


def looped(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, the text of this document is its words a to a + p - 1 over and over; None: it stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def sources(w: Words, ids: list[int | None] | None) -> np.ndarray:
    """The word that stands at each place, with some documents looped by their ids."""
    src = np.arange(len(w.starts))
    for i, doc_id in enumerate(ids or ()):
        first, last = int(w.at[i]), int(w.at[i + 1])
        if (loop := looped(doc_id, last - first)) is not None:
            a, p = loop
            src[first + a : last] = first + a + np.arange(last - first - a) % p
    return src


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, length, period of every run of docs (doc_id, text), start by word number from 0.

    Null and empty texts have none. Repeated rows give theirs each; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w = Words(buf, offsets)
                rows = runs_of(w, np.arange(len(w.starts)), least)
                doc = w.doc[rows[:, 0]].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
                values = [batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), rows[:, 0] - w.at[doc], rows[:, 1] - rows[:, 0], rows[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in values], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with each run in text cut to its first period; texts without runs stay as they are, others are joined by spaces.

    All rows and columns stay. Null and empty texts stay.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, _, buf, offsets in chunks(batch.column("text")):
                w = Words(buf, offsets)
                rows = runs_of(w, np.arange(len(w.starts)), least)
                keep = kept_words(len(w.starts), rows)
                for i in np.unique(w.doc[rows[:, 0]]).tolist() if len(rows) else ():
                    at = w.at[i] + np.flatnonzero(keep[w.at[i] : w.at[i + 1]])
                    texts[a + i] = bytes(spaced(Slices(w.buf, w.starts[at], w.ends[at]))[0][:-1]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(c).type) if c == "text" else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def _rows(doc_ids: list[int | None], w: Words, least: int) -> list[tuple]:
    src = sources(w, doc_ids)
    found = runs_of(w, src, least)
    keep = np.flatnonzero(kept_words(len(src), found))
    text, start, end = spaced(Slices(w.buf, w.starts[src[keep]], w.ends[src[keep]]))
    text, at = text.tobytes(), np.searchsorted(w.doc[keep], np.arange(len(doc_ids) + 1))
    of = np.searchsorted(w.doc[found[:, 0]] if len(found) else np.zeros(0, np.int64), np.arange(len(doc_ids) + 1))
    out = []
    for i, doc_id in enumerate(doc_ids):
        mine = found[of[i] : of[i + 1]]
        mine = np.stack([mine[:, 0] - w.at[i], mine[:, 1] - mine[:, 0], mine[:, 2]], 1)
        listed = "".join("%d,%d,%d\n" % tuple(r) for r in mine.tolist())
        best = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        kept = text[start[at[i]] : end[at[i + 1] - 1]] if at[i + 1] > at[i] else b""
        out.append((doc_id, len(mine), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """DIGEST of every row of docs (doc_id, text), a tenth of which are looped by their ids (looped()).

    Null and empty texts have no words, no runs and null run columns. A null doc_id loops nothing. Repeated rows give one
    row each, an empty table none; other columns are not read.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, buf, offsets in chunks(batch.column("text")):
                columns = zip(*_rows(ids[a:b], Words(buf, offsets), least), strict=True)
                types = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
