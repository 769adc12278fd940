"""Substring dedup: repeated runs of words, found by fixed-block anchors.

Any run of W words holds a whole block of B = (W + 1) // 2 words of its text cut at multiples of B. So every text indexes
its blocks and probes with every rolling window of B words: where a probe meets a block that is not its own, a repeat may
pass. Around those hits only, windows of W words are compared over the whole corpus; the union of the equal ones is the
maximal exact repeats of at least W words, whose words are removed.

Both comparisons run in hash buckets, as packed arrays rather than rows (6 bytes a probe). Within a batch equal hashes are
sent once, so a passage that a third of all documents share costs one entry a batch, and no task receives a group that
grows with the copies. Answers go back to the batch that asked, and from it to the documents.
Anchors are compared by short hashes and may err, which only makes more windows be compared. Windows are compared by the
BLAKE2b digest of their words, 96 bits of it inside a bucket that further bits choose: texts that differ cannot be made to
agree, and none of n windows does so by chance but with odds of n * n / 2^(97 + log2 buckets).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stored, row_key, stored
from tessella.llm.textkernel import U64, Words, chunks, mix, rolling, spaced, together

WINDOW = 35
BATCH_BYTES, BATCH_DOCS, NOBODY = 16 << 20, 16000, 0x3FFF
BUCKET_BYTES, MIN_BUCKETS = 4 << 20, 256
BUCKET, ANSWER = "bucket int, batch long, kind int, a binary, b binary", "batch long, a binary, b binary"


def _pack(hashes: np.ndarray, tags: np.ndarray, docs: np.ndarray, block: np.ndarray, buckets: int, wide: bool) -> Iterator[tuple]:
    """Rows (bucket, kind, a, b) of one batch: kind 0 asks, kind 2 is what the batch knows by itself.

    hashes choose the bucket by their upper half; compared are the lower half and, if wide, the tags (anchors: both are the
    short name, bucket above 32 compared bits). Equal pairs are sent once, marked as repeated, with nobody to answer.
    """
    order = np.lexsort((tags, hashes)) if wide else np.argsort(hashes)
    h, t, d, blk = hashes[order], tags[order], docs[order], block[order]
    if not len(h):
        return
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    many = size > 1
    known = np.repeat(many, size)
    bucket = _bucket(h, buckets) if wide else h >> U64(32)
    yield -1, 2, d[known].astype(np.uint16).tobytes(), t[known].tobytes()
    ask_doc = np.where(many, NOBODY, d[first]).astype(np.uint16)
    meta = ask_doc | (many.astype(np.uint16) << np.uint16(14)) | (np.logical_or.reduceat(blk, first).astype(np.uint16) << np.uint16(15))
    value, tag = h[first].astype(np.uint32), t[first]
    b = bucket[first]
    cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        yield int(b[i]), 0, meta[i:j].tobytes(), value[i:j].tobytes() + (tag[i:j].tobytes() if wide else b"")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)


class _Batch:
    """Documents and their hashes until they are sent."""

    def __init__(self, buckets: int, wide: bool):
        self.buckets, self.wide = buckets, wide
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = self.bytes = 0

    def add(self, keys: np.ndarray, h: np.ndarray, t: np.ndarray, doc: np.ndarray, block: np.ndarray, n_bytes: int) -> None:
        self.parts.append((h, t, doc + self.docs, block))
        self.keys.append(keys)
        self.docs += len(keys)
        self.bytes += n_bytes

    def full(self) -> bool:
        return self.docs >= BATCH_DOCS // 2 or self.bytes >= BATCH_BYTES

    def rows(self) -> pa.RecordBatch | None:
        if not self.docs:
            return None
        h, t, doc, block = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys = np.concatenate(self.keys)
        # Named by its documents and hashes, so that a task run again names it alike.
        name = int(np.bitwise_xor.reduce(mix(keys.view(U64).ravel() + np.arange(keys.size, dtype=U64))) ^ U64(len(h))) & (2**63 - 1)
        out = [(-1, 1, keys.tobytes(), b""), *_pack(h, t, doc, block, self.buckets, self.wide)]
        anywhere = name % self.buckets  # rows that only pass through
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] if x[0] >= 0 else anywhere for x in out], pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())],
            ["bucket", "batch", "kind", "a", "b"],
        )


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of key, which arrive together."""
    now, rows = None, []
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        values = columns[key].to_numpy(zero_copy_only=False)
        for i in range(len(values)):
            if values[i] != now:
                if rows:
                    yield now, rows
                now, rows = values[i], []
            rows.append({c: x[i] for c, x in columns.items()})
    if rows:
        yield now, rows


def _compare(wide: bool, blocks: bool):
    """Answers of each bucket: (batch, docs, hashes) where a hash stands twice or more (and in some text as a block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            out = [(r["batch"].as_py(), r["a"].as_py(), r["b"].as_py() if r["kind"].as_py() == 2 else None) for r in rows if r["kind"].as_py()]
            asks = [r for r in rows if not r["kind"].as_py()]
            if asks:
                metas = [np.frombuffer(r["a"].as_buffer(), np.uint16) for r in asks]
                sent = [r["b"].as_py() for r in asks]
                meta, value = np.concatenate(metas), np.concatenate([np.frombuffer(x, np.uint32, len(m)) for x, m in zip(sent, metas, strict=True)])
                tag = np.concatenate([np.frombuffer(x, U64, len(m), 4 * len(m)) for x, m in zip(sent, metas, strict=True)]) if wide else value
                batch = np.repeat(np.arange(len(asks)), [len(m) for m in metas])
                order = np.lexsort((value, tag)) if wide else np.argsort(value, kind="stable")
                v, t, m = value[order], tag[order], meta[order]
                first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])))
                size = np.diff(np.append(first, len(v)))
                hit = (size > 1) | (np.bitwise_or.reduceat(m, first) & np.uint16(1 << 14) > 0)
                if blocks:
                    hit &= np.bitwise_or.reduceat(m, first) & np.uint16(1 << 15) > 0
                doc = m & np.uint16(NOBODY)
                chosen = np.flatnonzero(np.repeat(hit, size) & (doc != NOBODY))
                chosen = chosen[np.argsort(batch[order[chosen]], kind="stable")]
                owner = batch[order[chosen]]
                cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner)) if len(owner) else [0]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    pick = chosen[i:j]
                    # Without tags the bucket's bits are the upper half, up to the division; the lower half names the rest.
                    h = t[pick] if wide else v[pick].astype(U64) | (U64(bucket) << U64(32))
                    out.append((asks[owner[i]]["batch"].as_py(), doc[pick].tobytes(), h.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["batch", "a", "b"])

    return run


def _address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k_id, k_text, hits) of the documents of each batch that got answers. The batch's own row has a null in b."""
    for _, rows in _runs(batches, "batch"):
        keys = next(np.frombuffer(r["a"].as_buffer(), np.int64).reshape(-1, 2) for r in rows if not r["b"].is_valid)
        answers = [r for r in rows if r["b"].is_valid]
        doc = np.concatenate([np.frombuffer(r["a"].as_buffer(), np.uint16) for r in answers] or [np.zeros(0, np.uint16)])
        if not len(doc):
            continue
        h = np.concatenate([np.frombuffer(r["b"].as_buffer(), U64) for r in answers])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
        doc, h = doc[new], h[new]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        hits = [x.tobytes() for x in np.split(h, first[1:])]
        who = keys[doc[first]]
        yield pa.RecordBatch.from_arrays([pa.array(who[:, 0]), pa.array(who[:, 1]), pa.array(hits, pa.binary())], ["_tsl_id", "_tsl_text", "_tsl_hits"])


def _answers(asked: DataFrame, buckets: int, wide: bool, blocks: bool, name: str) -> DataFrame:
    """k_id, k_text, hits of all documents that got an answer; repeated rows get one of theirs."""
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    met = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(wide, blocks), ANSWER)
    back = met.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_address, "_tsl_id long, _tsl_text long, _tsl_hits binary")
    return stored(back.groupBy("_tsl_id", "_tsl_text").agg(F.first("_tsl_hits").alias("_tsl_hits")), name)


def _keys_of(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False)[a:b].astype(np.int64) for c in ("_tsl_id", "_tsl_text")], axis=1)


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """The name that an anchor's hash has in answers."""
    return (_bucket(h, buckets) << U64(32)) | (h & U64(0xFFFFFFFF))


def _anchors(window: int, buckets: int):
    size = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batch(buckets, wide=False)
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w = Words(buf, offsets)
                h = rolling(w.hashes(), size)
                ok = together(w.doc, size)
                place = np.arange(len(h)) - w.at[w.doc[: len(h)]]
                h, doc, block = _short(h[ok], buckets), w.doc[: len(ok)][ok], place[ok] % size == 0
                for i in range(0, b - a, BATCH_DOCS // 2):  # so many documents at most
                    pick = (doc >= i) & (doc < i + BATCH_DOCS // 2)
                    held.add(_keys_of(batch, a + i, min(b, a + i + BATCH_DOCS // 2)), h[pick], h[pick], doc[pick] - i, block[pick], int(pick.sum()) * 6)
                    if held.full() and (out := held.rows()) is not None:
                        yield out
        if (out := held.rows()) is not None:
            yield out

    return run


def _near(w: Words, hits: list[bytes | None], window: int, buckets: int) -> np.ndarray:
    """Windows (by first word) that hold a hit anchor."""
    size = (window + 1) // 2
    ok = together(w.doc, window)
    if not len(ok):
        return np.zeros(0, np.int64)
    short = _short(rolling(w.hashes(), size), buckets)
    hit = _member(short, w.doc[: len(short)], hits) & together(w.doc, size)
    seen = np.concatenate([[0], np.cumsum(hit)])
    i = np.flatnonzero(ok)
    return i[seen[i + window - size + 1] > seen[i]]


def _digests(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """Two 64-bit numbers per window: BLAKE2b of its words, joined by single spaces, which no word holds."""
    text, start, end = spaced(w)
    data = text.tobytes()
    name = hashlib.blake2b
    return np.frombuffer(b"".join([name(data[a:b], digest_size=16).digest() for a, b in zip(start[at].tolist(), end[at + window - 1].tolist(), strict=True)]), U64).reshape(-1, 2)


def _member(values: np.ndarray, doc: np.ndarray, hits: list[bytes | None]) -> np.ndarray:
    """Whether each value is among its own document's hits."""
    lists = [np.frombuffer(x, U64) if x else np.zeros(0, U64) for x in hits]
    have = np.concatenate(lists) if lists else np.zeros(0, U64)
    if not len(have):
        return np.zeros(len(values), bool)
    salt = lambda d: mix(d.astype(U64) + U64(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return np.isin(values ^ salt(doc), have ^ salt(owner))


def _windows(window: int, buckets: int, more: int):
    """The windows near the hits, as questions over the whole corpus. buckets: of the anchors, more: of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batch(more, wide=True)
        for batch in batches:
            hits = batch.column("_tsl_hits").to_pylist()
            for a, b, buf, offsets in chunks(batch.column("text")):
                w = Words(buf, offsets)
                at = _near(w, hits[a:b], window, buckets)
                name, doc = _digests(w, at, window), w.doc[at]
                for i in range(0, b - a, BATCH_DOCS // 2):
                    pick = (doc >= i) & (doc < i + BATCH_DOCS // 2)
                    held.add(_keys_of(batch, a + i, min(b, a + i + BATCH_DOCS // 2)), name[pick, 0], name[pick, 1], doc[pick] - i, np.zeros(int(pick.sum()), bool), int(pick.sum()) * 14)
                    if held.full() and (out := held.rows()) is not None:
                        yield out
        if (out := held.rows()) is not None:
            yield out

    return run


def repeated(buf: np.ndarray, offsets: np.ndarray, near: list[bytes | None], hits: list[bytes | None], window: int, buckets: int) -> tuple[Words, np.ndarray]:
    """The words of some texts and which of them a repeated window covers."""
    w = Words(buf, offsets)
    gone = np.zeros(len(w.starts) + 1, np.int64)
    if any(hits):
        at = _near(w, near, window, buckets)
        at = at[_member(_digests(w, at, window)[:, 1], w.doc[at], hits)]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
    return w, np.cumsum(gone[:-1]) > 0


def _buckets(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(MIN_BUCKETS, size // BUCKET_BYTES)


def _hits(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """k_id, k_text, near, hits of each document with repeated windows: its hit anchors, and those windows' 64-bit names."""
    if window < 3:
        raise ValueError("window: 3 words or more")
    keyed = docs.select(*row_key(), "text")
    anchors = _answers(keyed.mapInArrow(_anchors(window, buckets), BUCKET), buckets, wide=False, blocks=True, name="anchor-hits")
    near = keyed.join(anchors, ["_tsl_id", "_tsl_text"])
    found = _answers(near.mapInArrow(_windows(window, buckets, buckets), BUCKET), buckets, wide=True, blocks=False, name="window-hits")
    out = stored(found.join(anchors.withColumnRenamed("_tsl_hits", "_tsl_near"), ["_tsl_id", "_tsl_text"]), "repeated-windows")
    drop_stored(anchors)
    drop_stored(found)
    return out


def _with_hits(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """docs, k_id, k_text, near and hits (null: none)."""
    return docs.select("*", *row_key()).join(_hits(docs, window, buckets), ["_tsl_id", "_tsl_text"], "left")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Null and empty texts: no words, the digest of ''. Null doc_id stays null. Repeated rows are repeats of each other and
    lose the same words. Texts shorter than the window are kept whole. Other columns are not read; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, hits = batch.column("_tsl_near").to_pylist(), batch.column("_tsl_hits").to_pylist()
            n, removed, sha = [], [], []
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, gone = repeated(buf, offsets, near[a:b], hits[a:b], window, buckets)
                count = np.bincount(w.doc[gone], minlength=b - a)
                data = buf.tobytes()
                for i in range(b - a):
                    text = data[offsets[i] : offsets[i + 1]].split()
                    n.append(len(text))
                    if count[i]:
                        text = [x for x, g in zip(text, gone[w.at[i] : w.at[i + 1]].tolist(), strict=True) if not g]
                    removed.append(int(count[i]))
                    sha.append(hashlib.sha256(b" ".join(text)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = _buckets(slim)
    return _with_hits(slim, window, buckets).select("doc_id", "text", "_tsl_near", "_tsl_hits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words of text cut out, white space before them included; all rows and columns stay.

    Null and empty texts stay as they are; a text that loses all its words keeps what white space ends it. Repeated rows are
    repeats of each other. Columns of any name go through. An empty table gives no rows.
    """
    names, buckets = docs.columns, _buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, hits, texts = batch.column("_tsl_near").to_pylist(), batch.column("_tsl_hits").to_pylist(), []
            valid = batch.column("text").is_valid().to_pylist()
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, gone = repeated(buf, offsets, near[a:b], hits[a:b], window, buckets)
                drop = np.zeros(len(buf) + 1, np.int32)
                which = np.flatnonzero(gone)
                first = which == w.at[w.doc[which]]
                begin = np.where(first, offsets[w.doc[which]], w.ends[np.maximum(which - 1, 0)])
                np.add.at(drop, begin, 1)
                np.add.at(drop, w.ends[which], -1)
                keep = np.cumsum(drop[:-1]) == 0
                for i in range(b - a):
                    piece = buf[offsets[i] : offsets[i + 1]]
                    texts.append(piece[keep[offsets[i] : offsets[i + 1]]].tobytes().decode() if valid[a + i] else None)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return _with_hits(docs, window, buckets).select(*names, "_tsl_near", "_tsl_hits").mapInArrow(run, docs.schema)


def oracle(window: int = WINDOW) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + {window - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d WHERE len(ws) >= {window})),
h AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
x AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS w FROM h),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS w, unnest(ws) AS t FROM d),
k AS (SELECT w.r AS r, count(x.w) AS gone, string_agg(CASE WHEN x.w IS NULL THEN t END, ' ' ORDER BY w.w) AS kept FROM w LEFT JOIN x ON w.r = x.r AND w.w = x.w GROUP BY w.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r"""
