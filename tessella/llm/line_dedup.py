"""Line dedup: content-defined chunks of lines that stand elsewhere in the corpus, at two scales.

A rolling hash over the hashes of two neighbouring lines with words chooses where chunks end, so that boundaries move along
with their lines: a passage has the same chunks wherever it stands, but for its ends. Chunks (of three such lines or more)
are compared over the corpus; of equal ones the one in the least document and place stays, the others go, but only after
their bytes were compared with its bytes. Repeats that hold no whole chunk, and what of a repeat lies beyond its first and
last chunk, are extended to by the finer scale: a boundary at every line, so two lines are a chunk. Those inside of chunks
that have gone are not compared again. So a repeated run of two lines goes from its first line to its last, blank lines
inside along with it; a chunk that overlaps the one that stays goes from where that ends. Every line that goes has an equal
one at a lesser place, down to one that stays. A chunk that very many documents share is summed before it is sent. Texts
move three times: to fetch the chunks to compare, at either scale, and to drop lines. These joins sort and may spill, at
every size alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import WORD, drop_stored, let, row_key, stored, text_of

#: One in MODULUS places is a boundary; lines of a chunk at most.
MODULUS, LONGEST = 4, 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_words(lines: Column) -> Column:
    """Numbers of the lines with words."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))


def windows_of(lines: Column) -> Column:
    """Array of struct(a, n, h): first line, number of lines and hash of every two lines with words and what is between."""

    def pairs(full: Column) -> Column:
        window = lambda k: F.struct(F.get(full, k).alias("a"), (F.get(full, k + 1) - F.get(full, k) + 1).alias("n"), F.xxhash64(F.get(lines, F.get(full, k)), F.get(lines, F.get(full, k + 1))).alias("h"))
        return F.when(F.size(full) > 1, F.transform(F.sequence(F.lit(0), F.size(full) - 2), window))

    return let(with_words(lines), pairs)


def chunks_of(lines: Column) -> Column:
    """Array of struct(a, n, h) of the chunks of three lines with words or more: first line, number of lines, hash.

    A chunk ends after the two lines whose rolling hash is 0 modulo MODULUS, and after LONGEST lines at the latest.
    """

    def cut(full: Column, hashes: Column) -> Column:
        m = F.size(full)
        ends = F.transform(F.sequence(F.lit(0), m - 2), lambda k: F.when(F.pmod(F.xxhash64(F.get(hashes, k), F.get(hashes, k + 1)), F.lit(MODULUS)) == 0, k + 2))
        return F.concat(F.array(F.lit(0)), F.filter(ends, lambda e: e.isNotNull() & (e < m)), F.array(m))

    def bounded(cuts: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda j: F.sequence(F.get(cuts, j), F.get(cuts, j + 1) - 1, F.lit(LONGEST)))
        return F.concat(F.flatten(pieces), F.slice(cuts, -1, 1))

    def chunks(full: Column, hashes: Column, cuts: Column) -> Column:
        def one(j: Column) -> Column:
            first, end = F.get(cuts, j), F.get(cuts, j + 1)
            a, last = F.get(full, first), F.get(full, end - 1)
            return F.struct(a.alias("a"), (last - a + 1).alias("n"), F.xxhash64(F.slice(hashes, first + 1, end - first)).alias("h"), (end - first).alias("m"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), one), lambda c: c["m"] >= 3)

    def of(full: Column) -> Column:
        hashes = F.transform(full, lambda i: F.xxhash64(F.get(lines, i)))
        return F.when(F.size(full) > 2, let(hashes, lambda hs: let(let(cut(full, hs), bounded), lambda cuts: chunks(full, hs, cuts))))

    return let(with_words(lines), of)


def _copies(docs: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """_tsl_id, _tsl_text, run (struct(a, to)): chunks (_tsl_id, _tsl_text, a, n, h) that stand at a lesser place byte for byte."""
    place = F.struct("_tsl_id", "_tsl_text", "a", "n")
    many = chunks.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    many = stored(many, f"{name}-hashes")  # a join of two tables, so that Spark can split a hot chunk
    mine = (F.col("_tsl_id") == F.col("first._tsl_id")) & (F.col("_tsl_text") == F.col("first._tsl_text"))
    begin = F.when(mine, F.greatest(F.col("a"), F.col("first.a") + F.col("first.n"))).otherwise(F.col("a"))
    here = chunks.join(many, "h").select("_tsl_id", "_tsl_text", F.struct("a", "n", "h", (place == F.col("first")).alias("first"), begin.alias("begin")).alias("c"))
    by = stored(here.groupBy("_tsl_id", "_tsl_text").agg(F.collect_set("c").alias("c")), f"{name}-repeated")
    # The bytes of every chunk whose hash repeats: its lines with words.
    with_text = docs.select(*row_key(), F.col("text").alias("t")).join(by.hint("merge"), ["_tsl_id", "_tsl_text"])
    body = lambda ls, c: F.concat_ws("\n", F.filter(F.slice(ls, c["a"] + 1, c["n"]), lambda x: x.rlike(WORD)))
    bodies = let(lines_of(F.col("t")), lambda ls: F.transform("c", lambda c: F.struct(c["a"].alias("a"), c["n"].alias("n"), c["h"].alias("h"), c["first"].alias("first"), c["begin"].alias("begin"), body(ls, c).alias("body"))))
    bytes_ = stored(with_text.select("_tsl_id", "_tsl_text", F.explode(bodies).alias("c")).select("_tsl_id", "_tsl_text", "c.*"), f"{name}-bytes")
    first = bytes_.where("first").groupBy("h").agg(F.first("body").alias("kept"))
    same = bytes_.where("NOT first AND begin < a + n").join(first, "h").where("body = kept")
    out = stored(same.select("_tsl_id", "_tsl_text", F.struct(F.col("begin").alias("a"), (F.col("a") + F.col("n") - 1).alias("to")).alias("run")), f"{name}-copies")
    for x in (many, by, bytes_):
        drop_stored(x)
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """_tsl_id, _tsl_text, _tsl_gone (array of struct(a, to)): the runs of lines that each document loses; they may overlap."""
    both = docs.select(*row_key(), let(lines_of(text_of()), lambda ls: F.concat(_scaled(chunks_of(ls), True), _scaled(windows_of(ls), False))).alias("c"))
    all_ = stored(both.select("_tsl_id", "_tsl_text", F.explode("c").alias("c")).select("_tsl_id", "_tsl_text", "c.*"), "line-chunks")
    coarse = _copies(docs, all_.where("coarse").drop("coarse"), "chunks")
    # Windows inside of chunks that go are left out: the end of the last such chunk begun in a document says so.
    ends = coarse.select("_tsl_id", "_tsl_text", "run.a", F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("h"), F.col("run.to").alias("to"))
    both = all_.where("NOT coarse").select("_tsl_id", "_tsl_text", "a", "n", "h", F.lit(None).cast("int").alias("to")).unionByName(ends)
    so_far = Window.partitionBy("_tsl_id", "_tsl_text").orderBy("a", F.col("to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    left = both.withColumn("to", F.max("to").over(so_far)).where("n IS NOT NULL AND (to IS NULL OR a + n - 1 > to)").drop("to")
    fine = _copies(docs, left, "windows")
    out = stored(coarse.unionByName(fine).groupBy("_tsl_id", "_tsl_text").agg(F.collect_set("run").alias("_tsl_gone")), "runs-to-drop")
    for x in (all_, coarse, fine):
        drop_stored(x)
    return out


def _scaled(chunks: Column, coarse: bool) -> Column:
    """The chunks with their scale; none for null."""
    kind = "array<struct<a:int,n:int,h:bigint,coarse:boolean>>"
    marked = F.transform(chunks, lambda c: F.struct(c["a"].alias("a"), c["n"].alias("n"), c["h"].alias("h"), F.lit(coarse).alias("coarse"))).cast(kind)
    return F.coalesce(marked, F.array().cast(kind))


def _left(text: str, gone: pa.Scalar) -> tuple[str, int, int]:
    """(what is left of a text, its lines, those that went), in time proportional to its lines and runs."""
    lines = text.split("\n")
    if not gone.is_valid:
        return text, len(lines), 0
    a, to = (gone.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    covered = np.zeros(len(lines) + 1, np.int64)
    np.add.at(covered, a, 1)
    np.add.at(covered, to + 1, -1)
    kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    return "\n".join([lines[i] for i in kept.tolist()]), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated runs of lines in text; all rows and columns stay.

    Null and empty texts stay as they are. A null doc_id counts as the least. Repeated rows (id and text) are one document:
    each keeps what it keeps. A text that loses all its lines is ''. An empty table gives no rows.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column("text"), batch.column("_tsl_gone")
            some = gone.is_valid()
            left = [_left(t, g)[0] for t, g in zip(text.filter(some).to_pylist(), gone.filter(some), strict=True)]
            text = pc.replace_with_mask(text, some, pa.array(left, text.type))
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names)

    keyed = docs.select("*", *row_key()).join(repeated_runs(docs).hint("merge"), ["_tsl_id", "_tsl_text"], "left")
    return keyed.select(*names, "_tsl_gone").mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row of docs (doc_id, text).

    A null text has no lines, an empty one has one. A null doc_id stays null and counts as the least. Repeated rows are one
    document and give one row each; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_left(t or "", g) for t, g in zip(batch.column("text").to_pylist(), batch.column("_tsl_gone"), strict=True)]
            n = [0 if not v.as_py() else x[1] for x, v in zip(left, batch.column("text").is_valid(), strict=True)]
            sha = [hashlib.sha256(x[0].encode()).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([x[2] for x in left], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = slim.select("*", *row_key()).join(repeated_runs(slim).hint("merge"), ["_tsl_id", "_tsl_text"], "left")
    return keyed.select("doc_id", "text", "_tsl_gone").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def oracle() -> str:
    """Texts of one id are in no order here, so ids must differ."""
    return """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text IS NULL AS none, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
f AS (SELECT r, i AS a, line AS x, lead(i) OVER (PARTITION BY r ORDER BY i) AS b, lead(line) OVER (PARTITION BY r ORDER BY i) AS y FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT *, first_value(r) OVER p AS r0, first_value(a) OVER p AS a0, first_value(b) OVER p AS b0 FROM f WHERE b IS NOT NULL WINDOW p AS (PARTITION BY x, y ORDER BY r, a)),
g AS (SELECT DISTINCT r, unnest(range(CASE WHEN r = r0 THEN greatest(a, b0 + 1) ELSE a END, b + 1)) AS i FROM w WHERE r <> r0 OR a <> a0),
k AS (SELECT l.r AS r, count(g.i) AS n, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN g ON l.r = g.r AND l.i = g.i GROUP BY l.r)
SELECT doc_id, CAST(CASE WHEN none THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN k ON d.r = k.r"""
