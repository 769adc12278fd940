"""Periodic runs against a plain search of every period, and the digest's loops, edges and hashes."""

import hashlib
import random
import zlib

from tessella.llm import periodic_runs

DOCS = "doc_id long, text string"


def plain(x, least=12):
    """(start, length, period) of all maximal runs, by every period at every place."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def corpus():
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        n, a = rnd.choice([0, 1, 5, 12, 40, 90, 300]), rnd.choice([2, 3, 9, 60])
        x = [f"w{rnd.randrange(a)}é" for _ in range(n)]
        for _ in range(rnd.randrange(3) if n else 0):
            s, p = rnd.randrange(n), rnd.randrange(1, 1 + max(1, n // 4))
            for j in range(s + p, min(n, s + p * rnd.randrange(2, 6) + rnd.randrange(p))):
                x[j] = x[j - p]
        rows.append((i, rnd.choice(" \t\n").join(x)))
    block = [f"b{i}" for i in range(30)]
    rows += [(1000, " ".join(block * 40)), (1001, " ".join(["x"] * 5000)), (1002, " ".join(f"u{i}" for i in range(3000))), (1003, " ".join(block + ["q"] * 400 + block * 3))]
    return rows + [(2000, None), (2001, ""), (2002, " \n\t"), (None, "a b " * 20), (1003, rows[-1][1]), rows[5], (None, None)]


def digested(doc_id, text):
    x = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    x = [w for w in x if w]
    n, h = len(x), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain(x), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(x) if i not in gone)))


def test_digest(spark):
    rows = corpus()
    got = [tuple(r) for r in periodic_runs.digest(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted((digested(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60  # there is something to find
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 10  # and something is looped


def test_runs_and_collapse(spark):
    rows = [r for r in corpus() if r[0] is not None and r[1]]
    docs = spark.createDataFrame(rows, DOCS)
    split = lambda t: t.replace("\t", " ").replace("\n", " ").split()
    want = sorted((i, *r) for i, t in rows for r in plain(split(t)))
    assert sorted(map(tuple, periodic_runs.runs(docs).collect())) == want
    left = {r.doc_id: r.text for r in periodic_runs.collapse(docs.selectExpr("doc_id", "text", "1 AS start", "2 AS _row")).collect()}
    for i, t in rows:
        x, runs = split(t), plain(split(t))
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert left[i] == (" ".join(w for k, w in enumerate(x) if k not in gone) if runs else t)


def test_other_hashes_when_one_fails(spark, monkeypatch):
    """A hash that calls everything alike is found out by comparing words, and another takes over."""
    honest, failed = periodic_runs.Extensions._same, []

    def same(self, a, b, size):
        if not failed:
            failed.append(1)
            return a >= 0
        return honest(self, a, b, size)

    monkeypatch.setattr(periodic_runs.Extensions, "_same", same)
    import numpy as np

    from tessella.llm.textkernel import Words

    x = "a b c d e f a b c d e f a b c d e f z a b c d e f".split()
    text = " ".join(x).encode()
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [(s, e - s, q) for s, e, q in periodic_runs.runs_of(w, np.arange(len(x))).tolist()] == plain(x)


def test_empty_table_and_long_text(spark):
    assert periodic_runs.digest(spark.createDataFrame([], DOCS)).count() == 0
    rnd = random.Random(8)
    long = " ".join(f"v{rnd.randrange(400)}" for _ in range(120_000))
    rows = [(7, long + " " + "la li lu " * 2000)]
    got = periodic_runs.runs(spark.createDataFrame(rows, DOCS)).collect()
    assert (120_000, 6000, 3) in {(r.start, r.length, r.period) for r in got}
