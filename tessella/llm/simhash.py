"""SimHash near-duplicates, linked through deletion-variant signatures.

Fingerprints within 2 bits of each other, cut into 2 segments of 32 bits, have a segment that differs by 1 bit at most.
Each segment is indexed under its 32 variants with one bit wiped, so such a pair meets under at least one equal key:
an equality join finds every link, and the full fingerprints verify it. Copies share a fingerprint, so the join runs over
distinct fingerprints, and a key's members give a spanning forest of their links rather than all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.shared import drop_stored, row_key, stored
from tessella.llm.textkernel import P3, U64, Words, chunks, lower_ascii, mix, spaced, xxh64

SHINGLE, BITS = 3, 2
PAIRS, SMALL, LARGE = 4, 16, 4096
NEAR_SHINGLE, SIMILARITY, TABLES, WIDTH, WILD = 5, 0.8, 32, 20, 7


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each) of all k-word shingles; a shorter text that has words is one shingle."""
    text, start, end = spaced(w)
    count = np.diff(w.at)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), per)
    first = np.repeat(w.at[:-1] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    last = first + np.minimum(count, k)[doc] - 1
    return xxh64(text, start[first], end[last] - start[first]), doc


def _votes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By document and bit: how far the shingles that set it are over half (doubled)."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, first, axis=0, dtype=np.int32) * 2 - size[:, None].astype(np.int32)


def fingerprints_of(w: Words, k: int) -> np.ndarray:
    """64 bits per document: those set in over half of its shingles' hashes; 0 without words."""
    out = np.zeros(len(w.at) - 1, U64)
    h, doc = shingle_hashes(w, k)
    if len(h):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, len(h)))
        out[doc[first]] = np.packbits(_votes(h, first, size) > 0, axis=1, bitorder="little").view(U64).ravel()
    return out


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each): the distinct shingles of each document, in order."""
    h, doc = shingle_hashes(w, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return h[new], doc[new]


def keys_of(w: Words, k: int, tables: int, width: int, wild: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name of the set, fingerprints, keys, wide) per document, of its set of shingles.

    wide: further bits of the fingerprint's kind, tables * width rounded up to 64s, as words of 64. keys are tables * wild ints: each segment
    of them with one bit wiped, which is in turn each of the `wild` bits with the closest votes, the ones that an edit flips.
    """
    n, more = len(w.at) - 1, -(-tables * width // 64)
    name, fp, keys, wide = np.zeros(n, U64), np.zeros(n, U64), np.full((n, tables * wild), -1, np.int32), np.zeros((n, more), U64)
    h, doc = shingle_sets(w, k)
    if not len(h):
        return name, fp, keys, wide
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size, who = np.diff(np.append(first, len(h))), doc[first]
    name[who] = mix(np.add.reduceat(mix(h + P3), first) + size.astype(U64))
    fp[who] = np.packbits(_votes(h, first, size) > 0, axis=1, bitorder="little").view(U64).ravel()
    votes = np.concatenate([_votes(mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)), first, size) for j in range(more)], axis=1)
    wide[who] = np.packbits(votes > 0, axis=1, bitorder="little").view(U64)
    votes = votes[:, : tables * width].reshape(len(who), tables, width)
    value = ((votes > 0) << np.arange(width)).sum(axis=2).astype(np.int64)
    close = np.argpartition(np.abs(votes), wild - 1, axis=2)[:, :, :wild]
    # A key names its table and the wiped bit, then the other bits.
    packed = (np.arange(tables)[None, :, None] << (width + 5)) | (close << width) | (value[:, :, None] & ~(1 << close))
    keys[who] = packed.reshape(len(who), -1).astype(np.int32)
    return name, fp, keys, wide


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """The kept columns and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprints_of(Words(lower_ascii(buf), offsets), shingle) for _, _, buf, offsets in chunks(batch.column("_tsl_text"), 1 << 20)]
            fp = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    slim = docs.select(*keep, F.col("text").alias("_tsl_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return slim.mapInArrow(run, f"{schema}, fp long")


def _forest(f: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct f."""
    left = f
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                yield np.full(len(found), x, U64), found
                queue.extend(found)
                left = left[~near]


def _links(f: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The forest, or for very many members those of smaller groups that still hold every link.

    A link's fingerprints agree in at least one of bits + 1 pieces.
    """
    if len(f) <= LARGE:
        yield from _forest(f, bits)
        return
    cuts = np.linspace(0, 64, bits + 2).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        piece = (f >> U64(a)) & U64((1 << int(b - a)) - 1)
        order = np.argsort(piece, kind="stable")
        g, p = f[order], piece[order]
        for part in np.split(g, np.flatnonzero(p[1:] != p[:-1]) + 1):
            if len(part) > 1:
                yield from _forest(part, bits)


def _complete(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The named columns of runs of rows with complete keys (the first name); rows come sorted by key."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(new[0]):
            continue
        if rows >= 200_000 and new[0][-1] != held[0][0][0]:  # the last key may go on in the next batch
            new = [np.concatenate(x) for x in zip(*held, new, strict=True)]
            cut = int(np.searchsorted(new[0], new[0][-1]))
            yield [x[:cut] for x in new]
            held, rows = [[x[cut:] for x in new]], len(new[0]) - cut
        else:
            held.append(new)
            rows += len(new[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _distinct(pairs) -> np.ndarray:
    """The distinct (a, b) of parts (two arrays each), as signed longs, the lesser first."""
    pairs = [p for p in pairs if len(p[0])]
    if not pairs:
        return np.zeros((0, 2), np.int64)
    ab = np.stack([np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True)], axis=1)
    return np.unique(np.sort(ab, axis=1), axis=0)


def _linker(bits: int):
    def edges(keys: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of complete groups, keys sorted."""
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        small = np.repeat(size, size) <= PAIRS
        for d in range(1, min(PAIRS, int(size.max(initial=1)))):
            i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= bits]
            yield f[i], f[i + d]
        for a in np.flatnonzero(size > PAIRS):
            yield from _links(f[first[a] : first[a] + size[a]], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f in _complete(batches, ["key", "fp"]):
            ab = _distinct(edges(keys, f.view(U64)))
            if len(ab):
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return run


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, size) of each run of equal keys."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return first, np.diff(np.append(first, len(keys)))


def _candidates(tight: int, loose: int):
    """From (key, fp, name) sorted: a, b to verify first, without key; and name, fp of all that have a loose link, with key.

    A key's two members are a pair. Of more, a forest of tight links comes first; their loose links are left to _across(),
    which knows what the forest has joined.
    """

    def some(keys: np.ndarray, f: np.ndarray, names: np.ndarray):
        first, size = _groups(keys)
        of = np.repeat(size, size)
        live, parent = np.zeros(len(keys), bool), np.full(len(keys), -1)
        pairs = []
        for d in range(min(SMALL, int(size.max(initial=1))) - 1, 0, -1):
            i = np.flatnonzero((keys[d:] == keys[:-d]) & (of[d:] <= SMALL))
            differ = np.bitwise_count(f[i] ^ f[i + d])
            near = i[differ <= loose]
            two = of[near] == 2
            pairs.append((names[near[two]], names[near[two] + 1]))
            near = near[~two]
            live[near] = live[near + d] = True
            close = i[differ <= tight]
            parent[close + d] = close
        child = np.flatnonzero((parent >= 0) & (of > 2))
        pairs.append((names[child], names[parent[child]]))
        for a in np.flatnonzero(size > SMALL):
            g, who = f[first[a] : first[a] + size[a]], names[first[a] : first[a] + size[a]]
            u, at, back, count = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
            touched = count > 1
            for x, y in _links(u, loose):
                touched[np.searchsorted(u, x)] = touched[np.searchsorted(u, y)] = True
            live[first[a] : first[a] + size[a]] = touched[back]
            same = np.flatnonzero(g[1:] == g[:-1])
            pairs.append((who[same], who[same + 1]))
            for x, y in _links(u[touched], tight):
                pairs.append((who[at[np.searchsorted(u, x)]], who[at[np.searchsorted(u, y)]]))
        return _distinct(pairs), np.flatnonzero(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f, names in _complete(batches, ["key", "fp", "name"]):
            ab, i = some(keys, f.view(U64), names.view(U64))
            if len(ab):
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.nulls(len(ab), pa.int32())], ["a", "b", "key"])
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(f[i]), pa.array(keys[i])], ["a", "b", "key"])

    return run


def _across(loose: int, far: int | None = None):
    """From (key, fp, name, root) sorted by key and root: all loose links between members with different roots.

    far: of the wide bits, which then come as well (a column wide), at most so many differ.
    """

    def near(f: np.ndarray, wide: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(f[i] ^ f[j]) <= loose
        if wide is not None and ok.any():
            i, j = np.broadcast_arrays(i, j)
            ok[ok] = np.bitwise_count(wide[i[ok]] ^ wide[j[ok]]).sum(axis=1, dtype=np.int64) <= far
        return ok

    def some(keys: np.ndarray, f: np.ndarray, names: np.ndarray, roots: np.ndarray, wide: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, size = _groups(keys)
        of = np.repeat(size, size)
        for d in range(1, min(SMALL, int(size.max(initial=1)))):
            i = np.flatnonzero((keys[d:] == keys[:-d]) & (of[d:] <= SMALL) & (roots[d:] != roots[:-d]))
            i = i[near(f, wide, i, i + d)]
            yield names[i], names[i + d]
        for a in np.flatnonzero(size > SMALL):
            r = roots[first[a] : first[a] + size[a]]
            if r[0] == r[-1]:
                continue
            start, count = _groups(r)
            most = start[np.argmax(count)]
            for s, n in zip(start, count, strict=True):
                if s == most:
                    continue
                # Each of its members with those of later groups, and with the largest, which is not begun from.
                other = first[a] + np.concatenate([np.arange(s + n, len(r)), np.arange(most, most + count.max()) if most < s else np.zeros(0, np.int64)])
                for x in range(first[a] + s, first[a] + s + n):
                    y = other[near(f, wide, np.array([x]), other)]
                    yield np.full(len(y), names[x]), names[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f, names, roots, *wide in _complete(batches, ["key", "fp", "name", "root", *([] if far is None else ["wide"])]):
            bits = np.frombuffer(b"".join(wide[0]), U64).reshape(len(keys), -1) if wide else None
            ab = _distinct(some(keys, f.view(U64), names.view(U64), roots, bits))
            if len(ab):
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return run


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: links (bits or fewer differ) that connect what is connected, of prints (distinct fp).

    The wiped-bit keys fit any number of bits, cut into bits // 2 + 1 segments. A key's members share all of a segment
    but one bit; they are held as 8 bytes each by one task at a time.
    """
    segments = bits // 2 + 1
    cuts = np.linspace(0, 64, segments + 1).astype(int).tolist()
    keys = []
    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)" if segments > 1 else "fp"
        keys.append(f"transform(sequence(0, {b - a - 1}), j -> xxhash64({n}, j, {part} & ~shiftleft(1L, j)))" if b - a > 32 else f"transform(sequence(0, {b - a - 1}), j -> shiftleft(cast({a} + j AS BIGINT), 32) | ({part} & ~shiftleft(1L, j)))")
    return _joined(prints.select("fp", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("key")), bits)


def _joined(variants: DataFrame, bits: int) -> DataFrame:
    """Links among the fp that share a key, of variants (fp, key)."""
    parts = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return variants.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_linker(bits), "a long, b long")


def cluster(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    Null and empty texts: fingerprint 0. Null doc_id stays null and is no component's name unless all its ids are null.
    Repeated rows share a component. Other columns are not read; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, "doc_id"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), bits))
    linked = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(names, "root").select(F.col("node").alias("n_fp"), "component_id")
    of = stored(nodes.join(named, F.col("fp") == F.col("n_fp"), "left").select(F.col("fp").alias("n_fp"), F.when(F.col("n_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "components")
    return prints.join(of, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """name, set (distinct shingle hashes) of nodes (name, _tsl_id, _tsl_text), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("_tsl_words"), 1 << 20):
                h, doc = shingle_sets(Words(lower_ascii(buf), offsets), shingle)
                at = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("name").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["name", "set"])

    texts = docs.select(*row_key(), F.col("text").alias("_tsl_words")).join(nodes.hint("shuffle_hash"), ["_tsl_id", "_tsl_text"])
    return texts.select("name", "_tsl_words").mapInArrow(run, "name long, set array<long>").groupBy("name").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar by exact Jaccard."""
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("name").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """_tsl_id, _tsl_text of the documents (see row_key()) that another one of their group replaces.

    similarity: of two sets of shingles (exact Jaccard). At 0.8 15 % of SimHash bits differ, more than segments of one 64-bit
    fingerprint can hold apart, so keys come from TABLES * WIDTH further bits: each segment is indexed under its WILD most
    likely flips, wiped one at a time. Pairs that meet and differ in at most three standard errors more of 64 bits than is
    expected, and in the further bits likewise, are candidates; only the sets decide. Documents with one set are one node.
    A key's tight forest is verified first; then every candidate pair whose ends are not yet joined by verified links is.
    The least document of a group stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("_tsl_words"), 1 << 20):
                name, fp, keys, wide = keys_of(Words(lower_ascii(buf), offsets), shingle, TABLES, WIDTH, WILD)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_tsl_id").slice(a, b - a), batch.column("_tsl_text").slice(a, b - a), pa.array(name.view(np.int64)), pa.array(fp.view(np.int64)), lists, pa.array([x.tobytes() for x in wide], pa.binary())], ["_tsl_id", "_tsl_text", "name", "fp", "keys", "wide"])

    slim = docs.select(*row_key(), F.col("text").alias("_tsl_words"))
    prints = stored(slim.mapInArrow(run, "_tsl_id long, _tsl_text long, name long, fp long, keys array<int>, wide binary"), "near-fingerprints")
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    within = lambda bits: int(bits * angle + 3 * math.sqrt(bits * angle * (1 - angle)))
    tight, loose, far = int(64 * angle), within(64), within(-(-TABLES * WIDTH // 64) * 64)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = prints.groupBy("name").agg(F.first(F.struct("fp", "keys")).alias("x")).select("name", "x.fp", F.explode("x.keys").alias("key"))
    met = stored(variants.repartition(parts, "key").sortWithinPartitions("key", "fp", "name").mapInArrow(_candidates(tight, loose), "a long, b long, key int"), "near-candidates")
    pairs = stored(met.where("key IS NULL").select("a", "b").distinct(), "near-pairs")
    live = met.where("key IS NOT NULL").select("key", F.col("b").alias("fp"), F.col("a").alias("name"))
    asked = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).union(live.select("name")).distinct()
    least = prints.groupBy("name").agg(F.min(F.struct("_tsl_id", "_tsl_text")).alias("l"), F.first("wide").alias("wide"))
    nodes = stored(least.join(asked, "name").select("name", "l.*", "wide"), "near-nodes")
    sets = stored(_sets(docs, nodes.drop("wide"), shingle), "near-sets")
    sure = stored(_verified(pairs, sets, similarity), "near-verified")
    named = live.join(nodes.select("name", "wide"), "name").join(components(sure).select(F.col("node").alias("name"), "root"), "name", "left").select("key", "fp", "name", F.coalesce("root", "name").alias("root"), "wide")
    rest = stored(named.repartition(parts, "key").sortWithinPartitions("key", "root", "fp", "name").mapInArrow(_across(loose, far), "a long, b long").distinct(), "near-rest")
    roots = components(sure.union(_verified(rest.join(pairs, ["a", "b"], "left_anti"), sets, similarity)))
    whose = stored(prints.select("_tsl_id", "_tsl_text", "name").join(roots.select(F.col("node").alias("name"), "root"), "name", "left").select("_tsl_id", "_tsl_text", F.coalesce("root", "name").alias("root")), "near-groups")
    least = whose.groupBy("root").agg(F.min("_tsl_id").alias("l_id"), F.min(F.struct("_tsl_id", "_tsl_text"))["_tsl_text"].alias("l_text"))
    least = stored(least, "near-least")
    out = stored(whose.join(least, "root").where("_tsl_id <> l_id OR _tsl_text <> l_text").select("_tsl_id", "_tsl_text").distinct(), "near-duplicates")
    for x in (prints, met, sets):
        drop_stored(x)
    return out


def keep_one(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, with one document of each group of near-duplicates.

    Texts without words are one group. A null doc_id is the least. Of repeated rows (id and text) one stays. An empty
    table gives no rows.
    """
    gone = near_duplicates(docs, shingle, similarity)
    keyed = docs.select("*", *row_key())
    kept = keyed.join(gone.hint("shuffle_hash"), ["_tsl_id", "_tsl_text"], "left_anti")
    if keyed.groupBy("_tsl_id", "_tsl_text").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_tsl_id", "_tsl_text"])
    return kept.select(docs.columns)


def digest(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return cluster(docs, shingle, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
