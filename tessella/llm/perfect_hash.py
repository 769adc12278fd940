"""Minimal perfect hashes of 64-bit keys, built in blocks by Spark tasks and probed with stored-key verification.

A key belongs to a block by its hash. In its block it takes the first level at which no other key of the block has its
bit; the slot is the rank of that bit, so slots of n keys are 0 to n - 1, block after block. Keys are stored by slot, and
a probe that meets another key than its own finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import stored
from tessella.llm.textkernel import U64, mix

#: Keys a block holds on average; bytes of one broadcast of blocks.
KEYS, BYTES = 1 << 14, 64 << 20
GOLDEN = U64(0x9E3779B97F4A7C15)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys ^ GOLDEN) % U64(blocks)).astype(np.int64)


def _bit(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(keys + U64((level + 1) * int(GOLDEN) % 2**64)) % size).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, the bits in 64-bit words, places of the keys by slot); keys are distinct."""
    sizes, words, order, left = [], [], [], np.arange(len(keys))
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _bit(keys[left], len(sizes), U64(size))
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        order.append(left[mine][np.argsort(at[mine])])
        left = left[~mine]
        if len(sizes) > 200:
            raise ValueError("two equal keys")
    return sizes, np.concatenate(words), np.concatenate(order)


@dataclass
class Part:
    """Some consecutive blocks: starts[block, level] are offsets in bits, keys are by slot, the first slot is `base`."""

    blocks: int
    first: int
    base: int
    starts: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, blocks: int, first: int, base: int, sizes: list[list[int]], words: list[np.ndarray], keys: list[np.ndarray]) -> Part:
        depth = max(map(len, sizes))
        padded = np.array([s + [0] * (depth - len(s)) for s in sizes], np.int64)
        ends = np.cumsum(padded.ravel()).reshape(padded.shape)
        all_ = np.concatenate(words)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(all_), dtype=np.int64)])
        return cls(blocks, first, base, np.concatenate([ends - padded, ends[:, -1:]], 1), all_, ranks, np.concatenate(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in these blocks."""
        out = np.full(len(keys), -1, np.int64)
        block = block_of(keys, self.blocks) - self.first
        left = np.flatnonzero((block >= 0) & (block < len(self.starts)))
        for level in range(self.starts.shape[1] - 1):
            b, k = block[left], keys[left]
            size = self.starts[b, level + 1] - self.starts[b, level]
            some = size > 0
            left, b, k, size = left[some], b[some], k[some], size[some]
            if not len(left):
                break
            at = self.starts[b, level] + _bit(k, level, size.astype(U64))
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            slot = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            same = self.keys[slot] == k[hit]
            out[left[hit][same]] = slot[same] + self.base
            left = left[~hit]
        return out


@dataclass
class Slots:
    """A hash over all keys of a table. rows: slot, key and the table's other columns; parts: broadcasts of Part, in order of slots."""

    size: int
    rows: DataFrame
    parts: list

    def destroy(self) -> None:
        for p in self.parts:
            p.destroy()


def find(parts: list, keys: np.ndarray) -> np.ndarray:
    """Slot of each key by broadcast parts, -1 for none. More parts than one are read one after the other."""
    out = parts[0].value.slots(keys) if parts else np.full(len(keys), -1, np.int64)
    for p in parts[1:]:
        here = p.value.slots(keys)
        out = np.where(here >= 0, here, out)
    return out


def _blocked(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(U64), blocks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

    return run


def _build(rest: list[str]):
    def run(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy().view(U64)
        sizes, words, order = build(keys)
        by = table.take(pa.array(order)).combine_chunks()
        items = pa.StructArray.from_arrays([by[c].combine_chunks() for c in ["key", *rest]], names=["key", *rest])
        return pa.table({
            "block": table["block"][:1], "n": pa.array([len(keys)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": pa.array([words.tobytes()], pa.binary()),
            "keys": pa.array([keys[order].tobytes()], pa.binary()), "items": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), items),
        })

    return run


def hashed(table: DataFrame, name: str, part_bytes: int = BYTES, block_keys: int = KEYS) -> Slots:
    """The hash of a stored table with a column key (long, distinct); an empty table has no slots.

    Blocks hold some block_keys keys each and are built in as many tasks as there are. Their bits and keys come to the
    driver and go out again in parts of part_bytes or less, each destroyed by Slots.destroy().
    """
    spark, rest = table.sparkSession, [c for c in table.columns if c != "key"]
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    blocks = max(1, -(-table.count() // block_keys))
    item = ",".join(f"{c}:{kinds[c]}" for c in ["key", *rest])
    told = table.select("key", *rest).mapInArrow(_blocked(blocks), ", ".join(f"{c} {kinds[c]}" for c in ["key", *rest]) + ", block long")
    built = stored(told.groupBy("block").applyInArrow(_build(rest), f"block long, n long, sizes array<long>, words binary, keys binary, items array<struct<{item}>>"), f"{name}-hash")
    sizes = built.select("block", "n", (F.octet_length("words") + F.octet_length("keys")).alias("bytes")).orderBy("block").collect()
    bases, base, groups = [], 0, []
    for r in sizes:
        bases.append((r.block, base))
        if not groups or groups[-1]["bytes"] + r.bytes > part_bytes:
            groups.append({"first": r.block, "base": base, "bytes": 0})
        groups[-1]["bytes"] += r.bytes
        groups[-1]["last"] = r.block
        base += r.n
    parts = []
    for g in groups:
        # Blocks without keys are none of the table's rows; they stand as empty ones here.
        rows = {r.block: r for r in built.where(F.col("block").between(g["first"], g["last"])).select("block", "sizes", "words", "keys").collect()}
        of = [rows.get(b) for b in range(g["first"], g["last"] + 1)]
        part = Part.of(blocks, g["first"], g["base"], [list(r.sizes) if r else [0] for r in of], [np.frombuffer(r.words if r else b"", "<u8") for r in of], [np.frombuffer(r.keys if r else b"", "<u8") for r in of])
        parts.append(spark.sparkContext.broadcast(part))
    first = spark.createDataFrame(bases, "block long, base long")
    items = built.select("block", F.posexplode("items").alias("at", "item")).join(first, "block")
    slot: Column = (F.col("base") + F.col("at")).alias("slot")
    return Slots(base, items.select(slot, "item.*"), parts)
