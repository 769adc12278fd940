"""LM scoring: Brown's class-based bigram model.

P(word | previous) = P(class | previous class) * P(word | class). Classes come from exchange clustering in two steps. The
SEEDS most frequent words are exchanged one at a time, each to the class that most raises the likelihood of the class
bigrams; what they leave goes along in groups of like shape (length, letters, last character). Then every other word of
the corpus is exchanged by itself: the classes that stand left and right of it are counted over the whole corpus, and it
goes to the class that raises the likelihood most, to first order in its counts. Only words that were never seen take the
class of their shape. Counts of words, of their neighbours and of class bigrams grow with the corpus and cover all of its
training documents.

Words are compared as words, never by a hash. The HEAD most frequent ones of WORD_BYTES bytes or less, 4 MB at most, go with
the code; all others are looked up by a join. Seeds are words of that length, too. The smoothed emission (c + 1) / (N_class + V_class + 1) has only log10(c + 1) to look up
besides the class, so one sum per document serves this model and the unigram base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stored, stored
from tessella.llm.textkernel import Words, chunks, lower_ascii

SEEDS, CLASSES, HEAD, SWEEPS, PRIOR, SHAPE_WEIGHT = 512, 48, 65536, 8, 10.0, 2.0
WORD_BYTES = 64
LENGTHS = (3, 5, 7, 9, 12)
SHAPES = (len(LENGTHS) + 1) * 4
HELD_OUT, FOLDS = 2, 7
FLUSH = 1_000_000
#: A class to the left (0 to CLASSES - 1) or to the right (CLASSES on) of a word, and how often.
BESIDE = np.dtype([("beside", "u1"), ("n", "<u4")])


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose crc32(id as text) mod 7 is 2 are not learned from. Null id: as the empty text, learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of large strings."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def shapes(words: pa.Array) -> np.ndarray:
    """Group of like words, 0 to SHAPES - 1; SHAPES for the end, which is the empty word."""
    at, data = _parts(words)
    if not len(words):
        return np.zeros(0, np.int64)
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    size = np.diff(at)
    last = data[np.maximum(at[1:] - 1, 0)] if len(data) else np.zeros(len(words), np.uint8)
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90))
    group = np.searchsorted(LENGTHS, size, "left") * 4 + (high[at[1:]] > high[at[:-1]]) * 2 + ~letter
    return np.where(size == 0, SHAPES, group).astype(np.int64)


@dataclass
class Tokens:
    """Tokens of a run of texts: code (place in words, which are distinct), doc; each text's words, then its end ('')."""

    words: pa.Array
    code: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offsets: np.ndarray) -> Tokens:
        w = Words(lower_ascii(buf), offsets)
        n = len(w.at) - 1
        at = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
        letters = w.buf[~((w.buf == 32) | ((w.buf - np.uint8(9)) < 5))]
        told = pa.LargeStringArray.from_buffers(len(w.starts), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
        place, ends = np.arange(len(w.starts)) + w.doc, w.at[1:] + np.arange(n)
        code, doc = np.empty(len(place) + n, np.int64), np.empty(len(place) + n, np.int64)
        code[place], code[ends] = told.indices.to_numpy(), len(told.dictionary)
        doc[place], doc[ends] = w.doc, np.arange(n)
        return cls(pa.concat_arrays([told.dictionary, pa.array([""], pa.large_string())]), code, doc)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for _, _, buf, offsets in chunks(batch.column("text")):
            yield Tokens.of(buf, offsets)


def _distinct(words: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """(distinct words of all arrays, place of each in them)."""
    told = pa.concat_arrays(words).dictionary_encode()
    return told.dictionary, told.indices.to_numpy().astype(np.int64)


def _place(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word among others, -1 for none."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held):
        words, at = _distinct([w for w, _ in held])
        return words, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(words)).astype(np.int64)

    def batch(held):
        words, n = out(held)
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])

    held: list = []
    for t in _texts(batches):
        held.append((t.words, np.bincount(t.code, minlength=len(t.words))))
        if sum(len(w) for w, _ in held) > FLUSH:
            held = [out(held)]
            if len(held[0][0]) > FLUSH:
                yield batch(held)
                held = []
    if held:
        yield batch(held)


def _units(words: pa.Array, seeds: pa.Array) -> np.ndarray:
    """What moves between classes at first: a seed, a shape's other words, the end."""
    i = _place(words, seeds)
    return np.where(i >= 0, i, len(seeds) + shapes(words))


def _count_pairs(seeds: pa.Array):
    m = len(seeds) + SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(m * m, np.int64)
        for t in _texts(batches):
            u = _units(t.words, seeds)[t.code]
            before = np.append(m - 1, u[:-1])  # an end stands before every text
            counts += np.bincount(before * m + u, minlength=m * m)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["pair", "n"])

    return run


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit, from counts of unit bigrams; the last unit (the end) has the last class to itself."""
    m = len(pairs)
    pairs = pairs.astype(float)
    free = max(1, min(classes, m) - 1)
    order = np.argsort(-pairs.sum(axis=1)[:-1], kind="stable")
    of = np.full(m, free)
    of[order] = np.arange(m - 1) % free
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    member = np.zeros((m, free + 1))
    member[np.arange(m), of] = 1
    n = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = of[w], pairs[w, w]
            member[w, a] = 0
            right, left = pairs[w] @ member, pairs[:, w] @ member
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= own
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            diag = np.diag(n)
            gain = (f(n + right) - f(n)).sum(axis=1) + (f(n.T + left) - f(n.T)).sum(axis=1)
            gain -= f(diag + right) - f(diag) + f(diag + left) - f(diag)
            gain += f(diag + right + left + own) - f(diag)
            gain -= f(rows + right.sum() + own) - f(rows) + f(cols + left.sum() + own) - f(cols)
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            member[w, b] = 1
            n[b] += right
            n[:, b] += left
            n[b, b] += own
        if not moved:
            break
    return of


def _count_beside(seeds: pa.Array, of: np.ndarray):
    """Rows (word, beside): how often which class stands beside each word, as packed BESIDE entries."""

    def summed(held) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words, keys: word * 2 * CLASSES + beside, counts), keys distinct and sorted."""
        words, at = _distinct([w for w, _, _ in held])
        first = np.cumsum([0, *(len(w) for w, _, _ in held)])
        keys = np.concatenate([at[a + k // (2 * CLASSES)] * (2 * CLASSES) + k % (2 * CLASSES) for a, (_, k, _) in zip(first[:-1], held, strict=True)])
        keys, back = np.unique(keys, return_inverse=True)
        return words, keys, np.bincount(back, weights=np.concatenate([n for _, _, n in held]), minlength=len(keys)).astype(np.int64)

    def batch(held) -> pa.RecordBatch:
        words, keys, n = summed(held)
        entries = np.empty(len(keys), BESIDE)
        entries["beside"], entries["n"] = keys % (2 * CLASSES), n
        at = np.searchsorted(keys // (2 * CLASSES), np.arange(len(words) + 1)).astype(np.int32) * BESIDE.itemsize
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(entries)])
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), packed], ["word", "beside"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for t in _texts(batches):
            c = of[_units(t.words, seeds)][t.code]
            left, right = np.append(of[-1], c[:-1]), np.append(c[1:], of[-1])
            keys = np.concatenate([t.code * (2 * CLASSES) + left, t.code * (2 * CLASSES) + CLASSES + right])
            keys, n = np.unique(keys, return_counts=True)
            held.append((t.words, keys, n))
            if sum(len(k) for _, k, _ in held) > 2 * FLUSH:
                held = [summed(held)]
                if len(held[0][1]) > FLUSH:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return run


def _exchange_words(seeds: pa.Array, of: np.ndarray, pairs: np.ndarray):
    """(word, n, cls) of every word, from its (word, beside) rows, sorted by word.

    Moving a word with few neighbours against those of a whole class b changes the likelihood by the sum of
    log(N(b, c) / N(b)) over the classes c to its right, and alike to its left. SHAPE_WEIGHT mean words of its shape speak
    along, which decides for rare words.
    """
    classes = int(of[-1]) + 1
    member = np.zeros((len(of), CLASSES))
    member[np.arange(len(of)), of] = 1
    n = member.T @ pairs @ member
    to = np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * classes))  # of c after b
    back = np.log((n + 0.5) / (n.sum(axis=0, keepdims=True) + 0.5 * classes))  # of c before b
    beside = np.concatenate([pairs.T @ member, pairs @ member], axis=1)[len(seeds) :]  # of the shapes and the end
    beside *= SHAPE_WEIGHT / np.maximum(pairs.sum(axis=0)[len(seeds) :], 1)[:, None]

    def classed(words: pa.Array, packed: pa.Array) -> pa.RecordBatch:
        told, row = _distinct([words])
        size = pc.binary_length(packed).to_numpy() // BESIDE.itemsize
        entries = np.frombuffer(b"".join(packed.to_pylist()), BESIDE)
        counts = np.bincount(np.repeat(row, size) * (2 * CLASSES) + entries["beside"], weights=entries["n"], minlength=len(told) * 2 * CLASSES).reshape(len(told), 2 * CLASSES)
        x = counts + beside[shapes(told)]
        gain = x[:, CLASSES:] @ to.T + x[:, :CLASSES] @ back
        unit = _units(told, seeds)
        fixed = (unit < len(seeds)) | (unit == len(of) - 1)
        cls = np.where(fixed, of[unit], np.argmax(gain[:, : max(1, classes - 1)], axis=1))
        return pa.RecordBatch.from_arrays([told.cast(pa.string()), pa.array(counts[:, :CLASSES].sum(axis=1).astype(np.int64)), pa.array(cls.astype(np.int32))], ["word", "n", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packed = pa.array([], pa.large_string()), pa.array([], pa.binary())
        for batch in batches:
            words = pa.concat_arrays([words, batch.column("word").cast(pa.large_string())])
            packed = pa.concat_arrays([packed, batch.column("beside").cast(pa.binary())])
            if len(words):  # the last word may go on in the next batch
                cut = pc.index(words, words[-1]).as_py()
                if cut:
                    yield classed(words[:cut], packed[:cut])
                words, packed = words[cut:], packed[cut:]
        if len(words):
            yield classed(words, packed)

    return run


def train(docs: DataFrame) -> tuple[pa.Array, np.ndarray, DataFrame]:
    """(seeds, class of each unit, table of word, n, cls of all words) from docs (text)."""
    texts = docs.select("text")
    counted = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")
    top = stored(counted.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(SEEDS), "frequent-words")
    seeds = pa.array(sorted(r.word for r in top.collect()), pa.large_string())
    drop_stored(top)
    m = len(seeds) + SHAPES + 1
    pairs = np.zeros(m * m)
    rows = texts.mapInArrow(_count_pairs(seeds), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy()
    pairs = pairs.reshape(m, m)
    of = exchange(pairs)
    beside = texts.mapInArrow(_count_beside(seeds, of), "word string, beside binary").repartition("word").sortWithinPartitions("word")
    vocabulary = stored(beside.mapInArrow(_exchange_words(seeds, of, pairs), "word string, n long, cls int"), "vocabulary")
    return seeds, of, vocabulary


SEQUENCE = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, seq binary, tail array<string>, unseen array<int>"


def _sequences(shared):
    """Each text's classes; those of words to look up are -1, -2, ... by their place in tail. unseen: their shapes' classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, classes, shape_of = shared.value
        head, logs = pa.array(words, pa.large_string()), np.log10(np.append(counts, 0) + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                t, n = Tokens.of(buf, offsets), b - a
                at = _place(t.words, head)
                unseen = shape_of[shapes(t.words)]
                known = (at >= 0)[t.code]
                seq = np.where(at >= 0, np.append(classes, 0)[at], 0)[t.code]
                # Words to look up, each once a document.
                rest = np.flatnonzero(~known)
                rest = rest[np.lexsort((t.code[rest], t.doc[rest]))]
                d, c = t.doc[rest], t.code[rest]
                new = np.append(True, (d[1:] != d[:-1]) | (c[1:] != c[:-1]))[: len(rest)]
                first = np.flatnonzero(new)
                cut = np.searchsorted(d[first], np.arange(n + 1))
                seq[rest] = cut[d] - np.cumsum(new)
                where = np.searchsorted(t.doc, np.arange(n + 1))
                small = np.diff(cut).max(initial=0) < 2**15
                parts = seq.astype(np.int16 if small else np.int32)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((where * parts.itemsize).astype(np.int64)), pa.py_buffer(parts)]).cast(pa.binary())
                tail = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), x)  # noqa: B023, E731
                per = lambda x: np.bincount(t.doc, weights=x, minlength=n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(np.diff(where)), pa.array(per(known).astype(np.int64)), pa.array(per(logs[at][t.code])), binary, tail(t.words.take(pa.array(c[first])).cast(pa.string())), tail(pa.array(unseen[c[first]].astype(np.int32)))],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "seq", "tail", "unseen"],
                )
                row += n

    return run


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences with the looked-up words' classes and counts put in; found: (place in tail, n, cls)."""
    for batch in batches:
        tokens, unseen, found = batch.column("n_tokens").to_pylist(), batch.column("unseen"), batch.column("found")
        known, logs, out = batch.column("n_known").to_numpy().copy(), batch.column("logs").to_numpy().copy(), []
        for i, raw in enumerate(batch.column("seq").to_pylist()):
            seq = np.frombuffer(raw, np.int16 if len(raw) == 2 * tokens[i] else np.int32)
            tail = seq < 0
            if tail.any():
                place = -1 - seq[tail].astype(np.int64)
                cls = unseen[i].values.to_numpy().copy()
                if found[i].is_valid and len(found[i].values):
                    at, n, its = (found[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    cls[at] = its
                    often = np.bincount(place, minlength=len(cls))[at]
                    known[i] += often.sum()
                    logs[i] += (often * np.log10(n + 1.0)).sum()
                seq = seq.copy()
                seq[tail] = cls[place]
            out.append(seq.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array(known), pa.array(logs), pa.array(out, pa.binary())], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "seq"])


def _count_classes(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for raw in batch.column("seq").to_pylist():
                c = np.frombuffer(raw, np.uint8).astype(np.int64)
                counts += np.bincount(np.append(end, c[:-1]) * CLASSES + c, minlength=CLASSES * CLASSES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["pair", "n"])

    return run


def transitions(seen: np.ndarray, n: np.ndarray, v: np.ndarray, classes: int) -> np.ndarray:
    """log10 of P(class | class before) / (N_class + V_class + 1), from class bigrams and each class's tokens and words."""
    share = (n + 1) / (n.sum() + classes)
    return np.log10((seen + PRIOR * share) / (seen.sum(axis=1, keepdims=True) + PRIOR)) - np.log10(n + v + 1)


def _steps(step: np.ndarray, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for raw in batch.column("seq").to_pylist():
                c = np.frombuffer(raw, np.uint8).astype(np.int64)
                total.append(float(step[np.append(end, c[:-1]), c].sum()))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(total, pa.float64())], [*names, "steps"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs (doc_id, text).

    Null and empty texts are their end alone. Null doc_id stays null (see held_out()). Repeated rows are counted and scored
    each. Other columns are not read. With nothing to learn from, every token is unknown; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    seeds, of, vocabulary = train(d.where("NOT held_out"))
    classes, end = int(of.max()) + 1, int(of[-1])
    n, v = np.zeros(classes), np.zeros(classes)
    for r in vocabulary.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[r.cls], v[r.cls] = r.n, r.v
    head = vocabulary.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD).toPandas()
    model = (head["word"].tolist(), head["n"].to_numpy(np.int64), head["cls"].to_numpy(np.int64), of[len(seeds) :])
    local = stored(d.mapInArrow(_sequences(spark.sparkContext.broadcast(model)), SEQUENCE), "sequences")
    tail = local.select("row", F.posexplode("tail").alias("place", "word"))
    found = tail.join(vocabulary, "word").groupBy("row").agg(F.collect_list(F.struct("place", "n", "cls")).alias("found"))
    both = local.drop("tail").join(found, "row", "left")
    whole = stored(both.mapInArrow(_resolved, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, seq binary"), "class-sequences")
    drop_stored(local)
    rows = whole.where("NOT held_out").mapInArrow(_count_classes(end), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(CLASSES * CLASSES)
    seen[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy()
    step = transitions(seen.reshape(CLASSES, CLASSES)[:classes, :classes], n, v, classes)
    scored = whole.mapInArrow(_steps(step, end), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, steps double")
    total, base = F.col("steps") + F.col("logs"), float(np.log10(n.sum() + v.sum() + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n.sum())).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * base).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
