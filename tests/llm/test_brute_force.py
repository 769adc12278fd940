"""Results against plain Python on small corpora with copies, near copies, shared passages and secrets."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, secret_scans, simhash, substring_dedup, url_filters
from tessella.llm.components import components

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = text(60)
    rows = []
    for i in range(120):
        t = text(rnd.randint(40, 200))
        if i % 4 == 0:
            k = rnd.randrange(len(t))
            t[k:k] = shared
        rows.append((i, t))
    for i in range(30):  # copies and near copies
        t = list(rows[i % 7][1])
        for _ in range(i % 3):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        rows.append((1000 + i, t))
    join = lambda t: "".join(w + ("\n" if rnd.random() < 0.1 else " ") for w in t)
    return [(i, join(t), "en", f"s{0 if i % 3 == 0 else i % 5}") for i, t in rows]


def test_xxh64():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(5000))
    start = np.array([rnd.randrange(4000) for _ in range(500)])
    length = np.array([rnd.randrange(150) for _ in range(500)])
    got = simhash.xxh64(np.frombuffer(data, np.uint8), start, length)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(start, length, strict=True)]


def test_secrets(spark):
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    texts = ["é token=token:abcdefgh PassWord = 'abc' API_key: \"zzzzzz\"", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "0123456789abcdef01234567 0123456789abcdef0123456", "token=" + "a" * 30 + " password:AKIA" + "C" * 20]
    texts += [f"see {key(48)} there" for _ in range(60)] + [f"word {'abcdefgh' * 6} there" for _ in range(60)]
    got = {r.doc_id: r for r in secret_scans.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(secret_scans.ASSIGN, t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        joined = ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert {s for s in joined.split(",") if s} <= set(got[i].spans.split(","))
    assert sum("random" in got[i].spans for i in range(4, 64)) >= 45  # keys found
    assert sum("random" in got[i].spans for i in range(64, 124)) == 0  # words left


def _battery(codes, size):
    """The three tests and their joint p-value in plain Python, from the textbook."""
    n = len(codes)
    tail = lambda z: 1 / (1 + math.exp(1.5976 * (z := max(-8.0, min(8.0, z))) + 0.07056 * z**3))
    chi, df = sum(v * v for v in collections.Counter(codes).values()) * size / n - n, size - 1
    p_chi = tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    side = [c >= size // 2 for c in codes]
    up = sum(side)
    if 0 < up < n:
        two = 2 * up * (n - up)
        spread = math.sqrt(max(two * (two - n) / (n * n * (n - 1)), 1e-9))
        p_runs = 2 * tail(abs(1 + sum(a != b for a, b in zip(side, side[1:])) - two / n - 1) / spread)  # noqa: B905
    else:
        p_runs = 0.0
    mean = sum(codes) / n
    var = sum((c - mean) ** 2 for c in codes)
    p_serial = 2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / var) * math.sqrt(n)) if var else 0.0  # noqa: B905
    x = -sum(math.log(max(min(p, 1.0), 1e-12)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-x) * (1 + x + x * x / 2)


def test_battery(spark):
    rnd = random.Random(8)
    for _, _, symbols in secret_scans.ENCODINGS:
        values = ["".join(rnd.choice(symbols[:k]) for _ in range(n)) for n in (2, 16, 25, 48, 130) for k in (1, 5, len(symbols))] + [symbols[0], "=" * 20]
        got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v string").select(secret_scans.battery(F.col("v"), symbols).alias("p")).collect()]
        codes = [[symbols.index(c) for c in v if c in symbols] for v in values]
        assert got == pytest.approx([_battery(c, len(symbols)) if len(c) > 1 else 0.0 for c in codes], rel=1e-6, abs=1e-12)


def test_calibrated_battery_is_even_on_random_strings(spark):
    rnd = random.Random(9)
    for k, n in ((0, 24), (1, 32), (2, 20), (2, 64)):
        symbols = secret_scans.ENCODINGS[k][2]
        rows = [(0, 3, n, "".join(rnd.choice(symbols) for _ in range(n))) for _ in range(1500)]
        spans = spark.createDataFrame([(rows,)], "x array<struct<s:int,kind:int,e:int,v:string>>").select(F.explode(secret_scans._tested(F.col("x"), secret_scans.calibration(spark))).alias("x"))
        bins = collections.Counter(r.b for r in spans.where(F.col("x.cls") >= 10 * k).select(F.col("x.bin").alias("b")).collect())
        total = sum(bins.values())
        assert total >= 1400
        assert abs(sum(bins[b] for b in range(10)) / total - 0.5) < 0.06 and abs(bins[0] / total - 0.05) < 0.03


def test_false_discoveries_of_secrets(spark):
    """200 corpora of 60 keys among 60 names of the kind found in code and links: the mean share of names reported."""
    rnd = random.Random(10)
    symbols = secret_scans.ENCODINGS[2][2]
    parts = ["get", "User", "Account", "from", "Index", "build", "Path", "v2", "error", "Handler", "2024", "Table", "of", "Contents", "_", "-", "/", "main", "Stream"]

    def name():
        out = ""
        while len(out) < 40:
            out += rnd.choice(parts)
        return out

    rows = [(seed, kind, "".join(rnd.choice(symbols) for _ in range(40)) if kind else name()) for seed in range(200) for kind in (0, 1) for _ in range(60)]
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(3).alias("kind"), F.lit(40).alias("e"), F.col("v").alias("v")))
    got = spark.createDataFrame(rows, "seed int, kind int, v string").repartition(4).select("seed", "kind", F.get(secret_scans._tested(spans, secret_scans.calibration(spark)), F.lit(0)).alias("x"))
    counts = collections.defaultdict(lambda: [[0] * secret_scans.BINS for _ in range(2)])
    for r in got.groupBy("seed", "kind", F.col("x.bin").alias("b")).count().collect():
        counts[r.seed][r.kind][r.b] = r["count"]
    false, found = [], 0
    for names, keys in counts.values():
        low = secret_scans.lowest([a + b for a, b in zip(names, keys, strict=True)])
        wrong, right = (sum(x[low:]) if low is not None else 0 for x in (names, keys))
        false.append(wrong / max(wrong + right, 1))
        found += right
    assert sum(false) / len(false) <= 0.05
    assert found >= 0.6 * 200 * 60


def test_few_candidates_and_copies_report_nothing(spark):
    rnd = random.Random(12)
    keys = ["".join(rnd.choice(secret_scans.ENCODINGS[2][2]) for _ in range(48)) for _ in range(3)]
    docs = spark.createDataFrame([(i, f"see {keys[i % 3]} there") for i in range(300)], "doc_id long, text string")
    assert secret_scans.scan(docs).where("spans <> ''").count() == 0


def test_candidates_that_touch_no_pattern(spark):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice(["token=abcdefgh", "x" * 24, "AKIA" + "B" * 18, "a" * 30, "Q" * 22 + "/token=abcdef", "é"]) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    t = F.col("text")
    base = F.concat(secret_scans.matches(t, secret_scans.ASSIGN, 0, group=2, least=6), secret_scans.matches(t, secret_scans.ACCESS, 1), secret_scans.matches(t, secret_scans.HEX, 2))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", base.alias("base"), secret_scans.matches(t, secret_scans.CANDIDATE, 3).alias("runs"))
    for r in df.select("i", "base", "runs", secret_scans._free(F.col("runs"), F.col("base")).alias("free")).collect():
        want = [m for m in r.runs if not any(b.s < m.e and m.s < b.e for b in r.base)]
        assert r.free == want


def test_decontamination(spark, corpus):
    bench = [(i, " ".join(corpus[i][1].split()[10:40])) for i in (2, 9, 40)] + [(50, "Zeta! eta"), (51, None), (52, "...")]
    docs = [*corpus, (5000, "x zeta, ETA y zeta eta", "en", "s1"), (5001, "zeta", "en", "s1")]
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = lambda t: token.findall((t or "").translate(lower))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (10**6, 0):  # broadcast and shuffled alike
        found = decontamination.hits(spark.createDataFrame(docs, DOCS), b, max_broadcast=limit)
        assert found.count() == sum(any(tuple(w[k : k + len(g)]) == g for g in windows for k in range(len(w) - len(g) + 1)) for w in (words(t) for _, t, *_ in docs))
    got = {r.doc_id: r for r in decontamination.scan(spark.createDataFrame(docs, DOCS), b).collect()}
    for i, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for g, its in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids |= its
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(spark.createDataFrame(docs, DOCS), b, "spans").collect()}
    assert words(cut[5000]) == ["x", "y"] and cut[5001] == "zeta" and cut[5000].startswith("x ")


def _targets(spark, sizes):
    rows = [(f"0{k:03}", w) for k, w in enumerate(sizes)]
    got = mixing.targets(mixing.weighted(spark.createDataFrame(rows, "key string, words long"))).collect()
    return [r.target for r in sorted(got)]


def test_mixing(spark, corpus):
    got = mixing.mix(spark.createDataFrame(corpus, DOCS)).toPandas().set_index("doc_id")
    size = {i: len(t.split()) for i, t, *_ in corpus}
    by = collections.defaultdict(int)
    for i, _, _, s in corpus:
        by[s] += size[i]
    names = sorted(by)
    want = dict(zip(names, _targets(spark, [by[n] for n in names]), strict=True))
    assert sum(want.values()) == pytest.approx(sum(by.values())) and all(want[n] <= 3 * by[n] + 1e-6 for n in names)
    taken = collections.defaultdict(int)
    for i, _, _, s in corpus:
        r = got.loc[i]
        assert r["size"] == size[i] and r.source_size == by[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * size[i] and r.taken % size[i] == 0
        taken[s] += r.taken
    for n in names:
        assert abs(taken[n] - want[n]) <= max(size.values())


def test_mixing_is_entropy_balanced(spark):
    rows = [(k, s, n) for k in ("0a", "0b") for s, n in ((10, 50), (100, 20), (900, 3))]
    words = {k: sum(s * n for kk, s, n in rows if kk == k) for k in ("0a", "0b")}
    goal = [("0a", words["0a"], 73, 0.4 * words["0a"]), ("0b", words["0b"], 73, 2.5 * words["0b"]), ("0c", 0, 0, 0.0), ("0d", 5, 1, 15.0)]
    rows.append(("0d", 5, 1))
    tilted = mixing.tilts(spark.createDataFrame(rows, "key string, size long, n long"), spark.createDataFrame(goal, "key string, words long, n long, target double"))
    tilt = {r.key: r.tilt for r in tilted.collect()}
    for k, all_, n, target in goal[:2]:
        got = sum(min(3, math.exp(tilt[k] * s / (all_ / n))) * s * c for kk, s, c in rows if kk == k)
        assert got == pytest.approx(target, rel=1e-6)
    assert tilt["0c"] == 0 and math.exp(tilt["0d"]) > 3


def test_targets_stop_at_three_times(spark):
    assert _targets(spark, [100, 100, 100]) == [50, 100, 150]
    got = _targets(spark, [1000, 10, 10])
    assert got[1:] == [30, 30] and got[0] == 960
    assert _targets(spark, [0, 0]) == [0, 0] and _targets(spark, []) == []
    assert _targets(spark, [70] * 9) == [35, 70, 105] * 3


def test_mixing_repeated_rows(spark):
    """Copies of one row are mixed like other rows: within one document of the target, and spread evenly."""
    rows = [(1, "a " * 100, "en", "s1")] * 50 + [(2, "b " * 300, "en", "s2")] * 50
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).toPandas()
    assert len(got) == 100
    for i, size, target in ((1, 100, 20000 / 3), (2, 300, 40000 / 3)):
        x = got[got.doc_id == i]
        assert len(x) == 50 and x.target.iloc[0] == pytest.approx(target) and abs(x.taken.sum() - target) <= size
        assert x.copies.max() - x.copies.min() <= 1
    counts = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert counts == {i: int(got[got.doc_id == i].copies.sum()) for i in (1, 2)}


def test_mixed_rows(spark, corpus, monkeypatch):
    """Rows as often as they have copies, in blocks of any size; repeated rows draw together."""
    docs = spark.createDataFrame([*corpus, *corpus[:5], corpus[3]], DOCS)
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    monkeypatch.setattr(mixing, "BLOCK", 2)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == +want
    again = collections.Counter()
    for r in mixing.mix(docs.repartition(7)).collect():
        again[r.doc_id] += r.copies
    assert again == want


def test_quality_rules(spark, corpus):
    rnd = random.Random(2)
    docs = [*corpus, (6000, "a b c a b c x a b c", "en", "s0"), (6001, "l one\n\nl one\n \nl one\n#$|", "en", "s0"), *((7000 + i, "bad " * rnd.randint(1, 60), "en", "poor") for i in range(40)), (7999, corpus[0][1], "en", "poor")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(docs, DOCS)).collect()}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert not got[7999].base_failed and not got[7999].kept  # its host is rejected
    assert all(got[i].kept for i, t, *_ in corpus if not got[i].base_failed)


def test_url_levels(spark):
    hosts = ["a.b.example.org", "example.org", "org", "", "a0.co.uk", "x.y.co.uk", "co.uk", "b.net:80", "shop.b.net:8080", "foco.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    plain, listed = (df.select(*(c.alias(n) for c, n in zip(url_filters.levels_of(F.col("host"), s), "sd", strict=True))).collect() for s in ((), ("co.uk", "uk")))
    assert [tuple(r) for r in plain] == [("org", "example.org"), ("org", "example.org"), ("org", "org"), ("", ""), ("uk", "co.uk"), ("uk", "co.uk"), ("uk", "co.uk"), ("net", "b.net"), ("net", "b.net"), ("uk", "foco.uk")]
    assert [tuple(r) for r in listed][4:] == [("co.uk", "a0.co.uk"), ("co.uk", "y.co.uk"), ("co.uk", "co.uk"), ("net", "b.net"), ("net", "b.net"), ("uk", "foco.uk")]


def test_line_dedup(spark):
    rnd = random.Random(4)
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(8))
    block = [line() for _ in range(40)]
    docs = []
    for i in range(30):
        own = [line() for _ in range(rnd.randint(3, 20))]
        k = rnd.randrange(len(own))
        docs.append((i, "\n".join(own[:k] + (block if i % 3 == 0 else []) + own[k:])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(table).collect()}
    first = min(i for i in range(30) if i % 3 == 0)
    assert kept[first] == dict(docs)[first]
    for i, t in docs:
        left = kept[i].split("\n")
        assert set(t.split("\n")) - set(left) <= set(block)  # own lines stay
        if i % 3:
            assert kept[i] == t
        elif i != first:  # all but the ends of the block go
            assert sum(x in left for x in block) <= 16
    for r in line_dedup.digest(table).collect():
        assert r.n_lines - r.n_removed == len(kept[r.doc_id].split("\n")) and r.kept_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_lm_scoring(spark, corpus):
    got = lm_scoring.score(spark.createDataFrame(corpus, DOCS)).toPandas().set_index("doc_id")
    tokens = {i: [*t.lower().split(), None] for i, t, *_ in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(w)))


def test_lm_tail_join_agrees(spark, corpus, monkeypatch):
    """Words looked up by the join score as those that go with the code."""
    docs = spark.createDataFrame(corpus, DOCS)
    whole = lm_scoring.score(docs).toPandas().set_index("doc_id")
    monkeypatch.setattr(lm_scoring, "HEAD", 40)
    few = lm_scoring.score(docs).toPandas().set_index("doc_id")
    assert (whole.n_known == few.n_known.loc[whole.index]).all()
    assert np.allclose(whole.score, few.score.loc[whole.index], rtol=1e-9) and np.allclose(whole.base_score, few.base_score.loc[whole.index], rtol=1e-9)


def _shape(w):
    b = w.encode()
    last = b[-1]
    letter = last >= 128 or chr(last).isalpha()
    return sum(len(b) > x for x in lm_scoring.LENGTHS) * 4 + any(x >= 128 for x in b) * 2 + (not letter)


def test_lm_score_by_hand(spark, corpus):
    """Class bigrams and emissions counted in Python, given each word's class; over every history they sum to one."""
    docs = [*corpus, (9000, "ünder x1 x2, Å", "en", "s"), (9001, "", "en", "s"), (9002, None, "en", "s")]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = {i: [*(t or "").translate(lower).split(), ""] for i, t, *_ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    learned = spark.createDataFrame([d for d in docs if not held[d[0]]], DOCS)
    seeds, of, vocabulary = lm_scoring.train(learned)
    words = {r.word: (r.n, r.cls) for r in vocabulary.collect()}
    assert {w: n for w, (n, _) in words.items()} == collections.Counter(x for i, w in tokens.items() if not held[i] for x in w)
    cls = lambda w: words[w][1] if w in words else int(of[len(seeds) + _shape(w)])
    k, end = int(of.max()) + 1, int(of[-1])
    seen, n, v = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for c, its in words.values():
        n[its] += c
        v[its] += 1
    for i, w in tokens.items():
        if not held[i]:
            for x, y in zip(["", *w], w, strict=False):
                seen[cls(x), cls(y)] += 1
    assert words[""][1] == end
    step = lm_scoring.transitions(seen, n, v, k)
    assert np.allclose((10**step * (n + v + 1)).sum(axis=1), 1)  # each class's words and its unknown one
    share = (n + 1) / (n.sum() + k)
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(docs, DOCS)).collect()}
    for i, w in tokens.items():
        want = 0.0
        for x, y in zip(["", *w], w, strict=False):
            a, b = cls(x), cls(y)
            want += math.log10((seen[a, b] + 10 * share[b]) / (seen[a].sum() + 10) * (words.get(y, (0,))[0] + 1) / (n[b] + v[b] + 1))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_rare_words_find_their_class(spark, monkeypatch):
    """Names, verbs and things take turns; those too rare to be seeds, all of one shape, join the classes of their kind."""
    monkeypatch.setattr(lm_scoring, "SEEDS", 30)
    rnd = random.Random(5)
    kinds = [[f"w{rnd.randrange(10**6, 10**7)}" for _ in range(100)] for _ in range(3)]
    pick = lambda k: rnd.choice(kinds[k][:10] if rnd.random() < 0.7 else kinds[k])
    docs = spark.createDataFrame([(" ".join(pick(k) for _ in range(20) for k in range(3)),) for _ in range(300)], "text string")
    _, _, vocabulary = lm_scoring.train(docs)
    cls = {r.word: r.cls for r in vocabulary.collect()}
    of = [collections.Counter(cls[w] for w in kind if w in cls) for kind in kinds]
    own = [set(c[:10]) for c in ([cls[w] for w in kind[:10]] for kind in kinds)]
    assert all(sum(c[x] for x in mine) >= 0.95 * c.total() for c, mine in zip(of, own, strict=True))
    assert not own[0] & own[1] and not own[1] & own[2] and not own[0] & own[2]


def test_exchange_raises_the_likelihood():
    rnd = np.random.default_rng(0)
    pairs = rnd.integers(0, 30, (40, 40)).astype(float)
    of = lm_scoring.exchange(pairs, classes=6)
    assert of[-1] == 5 and (of[:-1] < 5).all()
    member = np.eye(6)[of]
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    like = lambda m: f(m.T @ pairs @ m) - f((m.T @ pairs).sum(axis=1)) - f((pairs @ m).sum(axis=0))
    start = np.eye(6)[np.append(np.argsort(np.argsort(-pairs.sum(axis=1)[:-1], kind="stable")) % 5, 5)]
    assert like(member) >= like(start)


def _component_names(fps):
    ids, up = sorted(fps), {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash(spark, corpus):
    docs = [*corpus, (8000, "", "en", "s"), (8001, None, "en", "s"), (8002, "One two", "en", "s")]
    got = {r.doc_id: r for r in simhash.digest(spark.createDataFrame(docs, DOCS)).collect()}
    fps = {}
    for i, t, *_ in docs:
        w = (t or "").lower().encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {i: f"{v:016x}" for i, v in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    assert _component_names(fps) == {i: r.component_id for i, r in got.items()}


def test_links_in_dense_groups(spark):
    """Thousands of fingerprints around a few centres, in small and large groups, against all pairs."""
    rnd = random.Random(9)
    fps = set()
    for size in (1500, 300, 40):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    ids = dict(enumerate(sorted(fps)))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    back = {signed(v): i for i, v in ids.items()}
    links = simhash.links(spark.createDataFrame([(signed(v),) for v in ids.values()], "fp long"))
    for a, b in links.collect():
        assert (ids[back[a]] ^ ids[back[b]]).bit_count() <= 2
    want = _component_names(ids)
    got = {back[r.node]: back[r.root] for r in components(links).collect()}
    groups = lambda names: {frozenset(i for i, n in names.items() if n == m) for m in set(names.values())}
    assert groups({i: got.get(i, f"alone {i}") for i in ids}) == groups(want)


def test_large_groups_keep_their_links(monkeypatch):
    rnd = random.Random(2)
    f = np.array(sorted({sum(1 << rnd.randrange(64) for _ in range(3)) & (2**64 - 1) for _ in range(400)}), np.uint64)
    whole = lambda: {frozenset(map(int, p)) for a, b in simhash._links(f, 2) for p in zip(a, b, strict=True)}

    def names(edges):
        up = {int(x): int(x) for x in f}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for e in edges:
            a, b = sorted(map(root, e))
            up[b] = a
        return {x: root(x) for x in up}

    small = names(whole())
    monkeypatch.setattr(simhash, "LARGE", 10)
    assert names(whole()) == small


def test_components_of_chains(spark):
    rnd = random.Random(6)
    chain = rnd.sample(range(1000), 200)
    edges = [*zip(chain, chain[1:], strict=False), (5000, 5001), (5002, 5001), *((6000, 6001 + k) for k in range(50))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in chain} == {min(chain)} and got[5002] == 5000 and got[6050] == 6000 and len(got) == 200 + 3 + 51


def test_near_duplicates(spark, corpus):
    """Sets of five-word shingles 80 % alike or more are found, others stay."""
    rnd = random.Random(8)
    rows, alike = [], 0
    for i in range(300):
        t = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows.append((i, " ".join(t)))
        for j in range(i % 3):
            u = list(t)
            for k in rnd.sample(range(200), 3 + j):
                u[k] = "new"
            rows.append((1000 + 2 * i + j, " ".join(u)))
            sets = [{tuple(x[k : k + 5]) for k in range(196)} for x in (t, u)]
            alike += len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i < 1000} <= kept
    assert alike > 100 and len(rows) - len(kept) >= 0.9 * alike


def test_substring_dedup(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    words = {i: t.encode().split() for i, t, *_ in corpus}
    for window in (35, 8, 7):
        count = collections.Counter(b" ".join(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
        got = {r.doc_id: r for r in substring_dedup.digest(docs, window).collect()}
        cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs, window).collect()}
        removed = 0
        for i, w in words.items():
            gone = {k + j for k in range(len(w) - window + 1) if count[b" ".join(w[k : k + window])] > 1 for j in range(window)}
            left = [x for k, x in enumerate(w) if k not in gone]
            removed += len(gone)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())
            assert cut[i].encode().split() == left
        assert removed > 1000


def test_substring_dedup_inside_one_text(spark):
    t = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(t + ["mid"] + t)), (2, "a " * 100), (3, " ".join(t[:34])), (4, "b " * 35)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 80, 2: 100, 3: 0, 4: 0}


def thue_morse(n):
    """Two words of n letters that a polynomial modulo 2^64 cannot tell apart when n is 1,024 or more."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_are_compared_exactly(spark, n):
    """34 words alike and one that differs repeat nothing, and a word that was not learned is not known."""
    a, b = thue_morse(n)
    same = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{a} {same}"), (4, f"x {a} {same} y")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.digest(docs).collect()} == {1: 0, 2: 0, 3: 35, 4: 35}
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    learned = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 7 != 2)
    docs = spark.createDataFrame([(learned, f"x {a}"), (held, f"x {b}")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert got[held].n_known == 2 and got[learned].n_known == 3  # the end, x, and a
    assert got[held].base_score == pytest.approx(2 * math.log10(2 / 7) + math.log10(1 / 7))


def test_url_reputation(spark):
    rows = [(i, f"https://{'bad' if i % 2 else 'good'}.example.com/x/{i}") for i in range(80)] + [(900, "https://bad.example.com/de/1"), (901, "https://new.example.com/"), (902, "http://A.example.net/en/?q"), (903, "ftp://x.net"), (904, "http://ynet/")]
    labels = [(i, i % 2) for i in range(60)]
    got = {r.page_id: r for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(80))
    assert (got[900].rule, got[900].verdict) == ("example.com/de/", "block") and got[901].verdict == "allow"
    assert (got[902].rule, got[902].host, got[902].path) == ("example.net/en/", "a.example.net", "/en/")
    assert (got[903].host, got[903].path, got[903].rule) == ("x.net", "", None) and got[904].rule is None


def test_quality_classifier(spark):
    rnd = random.Random(12)
    word = lambda: rnd.choice(["la", "the", "of", "stone", "river", "green"]) + str(rnd.randrange(40))
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        t = [word() for _ in range(rnd.randint(20, 80))]
        if bad:
            t[rnd.randrange(len(t))] = rnd.choice(["vile", "vilest", "awful,"])
        rows.append((i, " ".join(t), "site" if i % 2 else "other", "p"))
        if i % 3:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, bad int")).toPandas()
    fresh = got[got.doc_id % 3 == 0]
    assert (fresh.kept != (fresh.doc_id % 5 == 0)).mean() > 0.95  # held-out accuracy
    assert got.host_rate.between(0.15, 0.3).all() and got.p_bad.between(0, 1).all()


def _strength(groups):
    """groups: (n, k, parent's rate)."""
    over = sum((k - n * p) ** 2 - n * p * (1 - p) for n, k, p in groups)
    room = sum(n * (n - 1) * p * (1 - p) for n, k, p in groups)
    return 1 / min(0.5, max(0.001, over / room if room else 0.01)) - 1


def test_quality_sites_by_hand(spark):
    """Posteriors of hosts and paths, and documents' odds with their own outcome left out, counted in Python."""
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choice(["vile" if i % 4 == 0 else "fine", "stone", "river", "la"]) for _ in range(30)), f"h{i % 5}", f"p{i % 3}" if i % 7 else None) for i in range(400)]
    labels = {i: int(i % 4 == 0) for i in range(0, 400, 3)} | {10_000: 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id long, bad int")).collect()}
    out = {i: labels.get(i, got[i].p_doc) for i in got}
    assert len({round(got[i].p_doc, 6) for i in got}) > 1
    site = {i: (h, p) for i, _, h, p in rows}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, y in out.items():
        hosts[site[i][0]].append(y)
        paths[site[i]].append(y)
    overall = (sum(out.values()) + 0.5) / (len(out) + 1)
    s_host = _strength([(len(y), sum(y), overall) for y in hosts.values()])
    host_rate = {h: (sum(y) + s_host * overall) / (len(y) + s_host) for h, y in hosts.items()}
    s = _strength([(len(y), sum(y), host_rate[h]) for (h, _), y in paths.items() if len(y) > 1])
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for i, r in got.items():
        h, y = site[i][0], paths[site[i]]
        assert r.host_rate == pytest.approx(host_rate[h], rel=1e-5) and r.path_rate == pytest.approx((sum(y) + s * host_rate[h]) / (len(y) + s), rel=1e-5)
        # The same from the other documents only: this one is in no sum.
        rest = [out[j] for j in got if j != i]
        there = [out[j] for j in got if j != i and site[j][0] == h]
        beside = [out[j] for j in got if j != i and site[j] == site[i]]
        over = (sum(rest) + 0.5) / (len(rest) + 1)
        host = (sum(there) + s_host * over) / (len(there) + s_host)
        others = (sum(beside) + s * host) / (len(beside) + s)
        assert r.p_bad == pytest.approx(1 / (1 + math.exp(-(logit(r.p_doc) + logit(others) - logit(over)))), rel=1e-4)


def test_own_label_does_not_count_twice(spark):
    """The only document of a host is judged by others alone, whatever its label says."""
    rates = []
    for label in (0, 1):
        rows = [(float(h % 2), f"h{h}", "p") for h in range(40) for _ in range(10)] + [(float(label), "lone", "p")]
        sites, all_ = quality_classifier.site_rates(spark.createDataFrame(rows, "bad double, host string, path string"))
        others, overall = quality_classifier.rate_of_others(all_)
        rates.append(sites.where("host = 'lone'").withColumn("bad", F.lit(float(label))).select(others.alias("o"), overall.alias("a")).first())
    assert rates[0].o == pytest.approx(rates[1].o, abs=1e-12) and rates[0].a == pytest.approx(rates[1].a, abs=1e-12)
    assert rates[0].o == pytest.approx(0.5, abs=0.01)


def test_labels_of_other_corpora(spark, monkeypatch):
    """Labels of documents that are elsewhere do not use up the sample, nor do repeated rows."""
    monkeypatch.setattr(quality_classifier, "SAMPLE", 200)
    rows = [(i, f"stone river {'vile' if i % 2 else 'fine'} {i}", "h", "p") for i in range(300)] + [(1, "stone river vile 1", "h", "p")] * 50
    labels = [(i, i % 2) for i in range(100_000)]
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, bad int")).toPandas()
    assert ((got.p_doc > 0.5) == (got.doc_id % 2 == 1)).mean() > 0.95


def _edited(words, rnd, at):
    out = list(words)
    for k in at:
        out[k] = f"x{rnd.randrange(10**9)}"
    return out


def _near_groups(rows, similarity=0.8):
    """Groups by exact Jaccard of five-word shingle sets, over all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = collections.defaultdict(set)
    for i in ids:
        for s in sets[i]:
            by[s].add(i)
    for i in ids:
        common = collections.Counter(j for s in sets[i] for j in by[s] if j > i)
        for j, n in common.items():
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in ids}


def _gone(spark, rows):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return {i for i, _ in rows} - {r.doc_id for r in simhash.keep_one(docs).collect()}


@pytest.fixture(scope="module")
def template_family():
    """400 documents 66 % alike that share a template; 100 of them have a copy 82 % like them."""
    rnd = random.Random(3)
    template = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = [(i, _edited(template, rnd, rnd.sample(range(5, 195, 10), 4))) for i in range(400)]
    return rows + [(1000 + i, _edited(rows[i][1], rnd, rnd.sample(range(10, 195, 10), 4))) for i in range(100)]


def test_near_duplicates_are_verified(spark, template_family):
    """In a family that is 66 % alike, only documents with a true link go."""
    want = _near_groups(template_family)
    assert _gone(spark, template_family) <= {i for i, r in want.items() if r != i}


def test_near_duplicates_in_a_family(spark, template_family):
    """True pairs are found among many candidates that are none, whichever document the others hang on."""
    want = {i for i, r in _near_groups(template_family).items() if r != i}
    assert len(want) > 100 and len(want - _gone(spark, template_family)) <= 0.05 * len(want)


def test_pairs_across_verified_links():
    """b and c are alike, x is near both by fingerprint only: b-c is asked though x links both, in groups of every size."""
    rnd = random.Random(1)
    for size in (3, 5, 16, 40):
        f = np.array(sorted({sum(1 << rnd.randrange(64) for _ in range(3)) for _ in range(size)}), np.uint64)
        names, roots = np.arange(len(f)) + 1, np.arange(len(f)) // 2
        batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(f), 7, np.int32)), pa.array(f.view(np.int64)), pa.array(names)], ["key", "fp", "name"])
        out = pa.Table.from_batches(list(simhash._candidates(9, 18)([batch]))).to_pandas()
        assert set(out[out.key.notna()].a) == set(names)
        batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots)], ["key", "fp", "name", "root"])
        got = {(r.a, r.b) for r in pa.Table.from_batches(list(simhash._across(18)([batch]))).to_pandas().itertuples()}
        assert got == {(a, b) for a in names for b in names if a < b and roots[a - 1] != roots[b - 1]}


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of exactly 0.8."""
    rnd = random.Random(7)
    rows = [(i, [f"w{rnd.randrange(5000)}" for _ in range(184)]) for i in range(300)]
    rows += [(1000 + i, _edited(t, rnd, rnd.sample(range(5, 179, 10), 4))) for i, t in rows]
    assert len(_gone(spark, rows)) >= 0.97 * 300


def _lines_left(docs):
    """Every window of two lines with words stays at its least place only; lines where it stays at once are its own."""
    first, left = {}, {}
    for i, t in sorted(docs):
        lines, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(lines) if x.strip()]
        for a, b in zip(full, full[1:], strict=False):
            at = first.setdefault((lines[a], lines[b]), (i, a, b))
            if at != (i, a, b):
                gone |= set(range(max(a, at[2] + 1) if at[0] == i else a, b + 1))
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return left


def test_line_dedup_finds_runs_of_any_length(spark):
    """Runs of 2 to 9 lines inside other documents go whole, and so they do beside a line that repeats itself."""
    rnd = random.Random(14)
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(6))
    runs = [[line() for _ in range(2 + k % 8)] for k in range(40)] + [["x y"] * 5]
    docs = []
    for i in range(120):
        own = [line() for _ in range(rnd.randint(1, 8))]
        k = rnd.randrange(len(own) + 1)
        docs.append((i, "\n".join(own[:k] + runs[i % 41] + own[k:])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _lines_left(docs)
    assert all(not set(runs[i % 41]) & set(got[i].split("\n")) for i in range(41, 120))


def test_line_chunks_move_with_their_lines(spark):
    """Lines put in or taken out change the chunks around them and no others; long runs of one line are cut."""
    rnd = random.Random(21)
    lines = [f"line {rnd.randrange(10**9)}" for _ in range(300)]
    texts = {1: lines, 2: ["new head", "", *lines], 3: lines[:150] + ["put in"] + lines[150:], 4: lines[40:], 5: ["same"] * 500, 6: ["a", "b"], 7: []}
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rows = docs.select("doc_id", F.explode(line_dedup.chunks_of(line_dedup.lines_of(F.col("text")))).alias("c")).collect()
    chunk = {i: [r.c for r in rows if r.doc_id == i] for i in texts}
    hashes = {i: [c.h for c in cs] for i, cs in chunk.items()}
    assert len(hashes[1]) > 30 and not hashes[6] and not hashes[7]
    for i, cut in ((2, 0), (3, 0), (4, 40)):
        assert sum(c.a >= cut and c.h not in hashes[i] for c in chunk[1]) <= 2
    assert {c.a - 2 for c in chunk[2]} >= {c.a for c in chunk[1]} - {0, *[c.a for c in chunk[1][:2]]}
    assert all(3 <= c.m <= line_dedup.LONGEST and c.n == c.m for c in chunk[5]) and sum(c.m for c in chunk[5]) > 400


def test_line_dedup_at_both_scales(spark):
    """Long and short repeats, whole documents among them, against the comparison of every two lines."""
    rnd = random.Random(22)
    line = lambda: f"l {rnd.randrange(10**9)}"
    long = [[line() for _ in range(rnd.randrange(20, 60))] for _ in range(6)]
    docs = []
    for i in range(160):
        t = [line() for _ in range(rnd.randrange(0, 6))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(long)
            a = rnd.randrange(len(p))
            t += p[a : a + rnd.randrange(1, 40)] + [line() for _ in range(rnd.randrange(0, 3))] + [""] * rnd.randrange(2)
        docs.append((i, "\n".join(t)))
    docs += [(200 + i, docs[i][1]) for i in range(30)] + [(300, "\n".join(long[0] * 5)), (301, "\n".join(["r"] * 90))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == _lines_left(docs)


def test_line_dedup_over_blank_lines(spark):
    """Paragraphs parted by blank lines are compared, and the blank lines inside a repeated run go along."""
    docs = [(1, "own a\n\nfirst part\n\nsecond part\n\nown b"), (2, "own c\n\nfirst part\n \nsecond part\n\nown d"), (3, "first part\nsecond part")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "own c\n\n\nown d", 3: ""} == _lines_left(docs)


def test_line_dedup_of_a_long_text(spark):
    """400,000 lines, a third of them in repeated runs: time grows with the lines, not with their square."""
    rnd = random.Random(15)
    runs = [[f"run {k} line {j}" for j in range(2 + k % 4)] for k in range(200)]
    lines = []
    while len(lines) < 400_000:
        lines += [f"own {len(lines)} {j}" for j in range(8)] + rnd.choice(runs)
    docs = [(1, "\n".join(lines)), (2, "\n".join(["head", *runs[0], "tail"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = _lines_left(docs)
    assert got == want and len(want[1]) < 0.8 * len(docs[0][1])


def test_decontamination_of_a_long_text(spark):
    """100,000 hits in one text, cut and counted in one pass, by either join."""
    rnd = random.Random(16)
    passages = [[f"p{k}x{j}" for j in range(12)] for k in range(50)]
    words, hit = [], 0
    while len(words) < 300_000:
        own = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 8))]
        words += own + (p := rnd.choice(passages))
        hit += len(p)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, text string")
    for limit in (decontamination.MAX_BROADCAST, 0):
        got = {r._tsl_id: r for r in decontamination.hits(docs, bench, max_broadcast=limit).withColumn("n", decontamination.covered(F.col("_tsl_spans"))).collect()}
        assert list(got) == [1] and got[1].n == hit and got[1]["items"] == sorted(str(k) for k in range(50))
    left = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, "spans").collect()}
    assert left[2] == "clean words" and left[1].split() == [w for w in words if not w.startswith("p")]
