"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

A candidate is a long run of letters, digits and +/_=- that touches no pattern span. Its encoding (hexadecimal, base 32,
base 64) is inferred from its characters; over that alphabet it gets a chi-squared test of uniformity, a runs test about
the middle of the alphabet and a lag-1 serial correlation. Fisher's rule joins the three p-values, and strings that Spark
draws at random, of the same encoding and about the same length, tell how the joint value is distributed for random
strings: the tests are neither independent nor exact on short strings. So calibrated, random strings spread evenly over
BINS bins, while words and identifiers fall into the lowest. Within each encoding and length class the number of random
strings is estimated from the upper half of the bins (Storey); the lowest threshold is taken whose estimated
false-discovery rate, with one false discovery more than was estimated, stays below FDR. Length classes keep short strings,
where the tests are weak, from borrowing the evidence of long ones; only classes too small for an estimate of their own
share one within their encoding. Values that the patterns found are tested alike and count in the estimates, and equal
strings count once, so that copies of a document are no evidence.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import LOWER, UPPER, let, stored, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
DIGITS = "0123456789"
#: Encodings as tried: name, pattern, symbols in order of value; / and _, + and - are one symbol each.
ENCODINGS = (("hex", "^[0-9a-fA-F]+$", DIGITS + "abcdef"), ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"), ("base64", "^.*$", UPPER + LOWER + DIGITS + "+/"))
LENGTHS = (28, 40, 64)
FDR, BINS = 0.05, 20
#: Shorter values are not tested; random strings are drawn at these lengths, DRAWN of each, and stand for lengths up to the next.
POINTS, DRAWN = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128), 2000
#: A class of fewer strings takes the threshold of its whole encoding.
LEAST_CLASS = 40


def _prefix(lengths: Column, block: int = 256) -> Column:
    """Sums of all that stands before each element; blocks keep long arrays from quadratic copies."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def join(blocks: Column) -> Column:
        inner = F.transform(blocks, sums)
        before = let(inner, lambda i: sums(F.transform(i, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(inner, before, lambda i, b: F.when(i.isNotNull(), F.transform(F.slice(i, F.lit(1), F.size(i) - 1), lambda x: x + b)).otherwise(F.array().cast("array<int>"))))

    cut = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(block)), lambda s: F.slice(lengths, s + 1, F.lit(block)))
    return let(cut, join)


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of struct(s, kind, e, v): leftmost non-overlapping matches in code points whose group has `least` characters."""
    none = F.array().cast("array<struct<s:int,kind:int,e:int,v:string>>")

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        starts = let(F.zip_with(_prefix(steps), gaps, lambda b, g: b + F.length(g)), lambda s: F.slice(s, F.lit(1), F.size(found)))
        rows = F.transform(F.arrays_zip(starts.alias("a"), found.alias("b"), value.alias("c")), lambda x: F.struct(
            x["a"].alias("s"), F.lit(kind).alias("kind"), (x["a"] + F.length(x["b"])).alias("e"), x["c"].alias("v")))
        return F.filter(rows, lambda r: F.length(r["v"]) >= least) if least else rows

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(place(found)))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the logistic form, to about 2e-4."""
    bounded = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return let(bounded, lambda z: 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z)))


def joint(codes: Column, size: int) -> Column:
    """Fisher's joint p-value of the three tests that codes are drawn evenly from 0 to size - 1; 0 for fewer than two codes."""
    return let(codes, lambda c: F.when(F.size(c) < 2, F.lit(0.0)).otherwise(_joint(c, size)))


def _joint(codes: Column, size: int) -> Column:
    n = F.size(codes).cast("double")
    # In order, the r-th of equal codes adds 2 r - 1 to the sum of squared counts.
    one = F.lit(1).cast("long")
    step = lambda acc, c: F.struct(c.alias("last"), F.when(c == acc["last"], acc["r"] + one).otherwise(one).alias("r"), (acc["sum"] + F.when(c == acc["last"], 2 * acc["r"] + one).otherwise(one)).alias("sum"))
    squares = F.aggregate(F.sort_array(codes), F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("sum")), step, lambda acc: acc["sum"].cast("double"))
    chi, df = squares * float(size) / n - n, float(size - 1)
    p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    high = F.size(F.filter(codes, lambda c: c >= size // 2)).cast("double")
    pairs = lambda f: F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), f)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    runs = 1 + total(pairs(lambda a, b: F.when((a >= size // 2) != (b >= size // 2), 1.0).otherwise(0.0)))

    def runs_test(twice: Column) -> Column:
        spread = F.sqrt(F.greatest(twice * (twice - n) / (n * n * (n - 1)), F.lit(1e-9)))
        return F.when(twice == 0, F.lit(0.0)).otherwise(2 * _upper_tail(F.abs(runs - twice / n - 1) / spread))

    p_runs = let(let(high, lambda h: 2 * h * (n - h)), runs_test)

    def correlation(mean: Column) -> Column:
        var = total(F.transform(codes, lambda c: (c - mean) * (c - mean)))
        serial = total(pairs(lambda a, b: (a - mean) * (b - mean)))
        return F.when(var > 0, serial / F.greatest(var, F.lit(1e-9)))

    # The mean is bound, or each element would compute it anew.
    r = let(total(F.transform(codes, lambda c: c.cast("double"))) / n, correlation)
    p_serial = F.coalesce(2 * _upper_tail(F.abs(r) * F.sqrt(n)), F.lit(0.0))
    x = -reduce(lambda a, b: a + b, (F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) for p in (p_chi, p_runs, p_serial)))
    return let(x, lambda x: F.exp(-x) * (1 + x + x * x / 2))


def battery(value: Column, symbols: str) -> Column:
    """joint() of value over these symbols; other characters are left out."""
    plain = F.translate(value, "-_", "+/") if len(symbols) == 64 else F.lower(value) if len(symbols) == 16 else value
    chars = F.filter(F.split(plain, ""), lambda c: F.instr(F.lit(symbols), c) > 0)
    return joint(F.transform(chars, lambda c: F.instr(F.lit(symbols), c) - 1), len(symbols))


@cache
def calibration(spark: SparkSession) -> tuple[tuple[float, ...], ...]:
    """Cuts of joint() into BINS equal shares of random strings, by encoding and then by point of length.

    The draws are hashes of their numbers, so reruns agree.
    """
    out = []
    points = F.array(*map(F.lit, POINTS))
    for _, _, symbols in ENCODINGS:
        size = len(symbols)
        drawn = spark.range(DRAWN * len(POINTS), numPartitions=8).select("id", F.get(points, (F.col("id") % len(POINTS)).cast("int")).alias("n"))
        codes = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.pmod(F.xxhash64(F.col("id"), k), F.lit(size)).cast("int"))
        p = drawn.select("n", joint(codes, size).alias("p"))
        rows = p.groupBy("n").agg(F.percentile("p", F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias("cuts")).collect()
        out += [tuple(r["cuts"]) for r in sorted(rows)]
    return tuple(out)


def _ranks(values: Column, marks: Column, also_equal: bool) -> Column:
    """For each of the ascending values, how many marks are less (or also equal): one sort and one sum instead of a loop in a loop."""
    first, last = (0, 1) if also_equal else (1, 0)
    tagged = F.concat(
        F.transform(marks, lambda x: F.struct(x.alias("at"), F.lit(first).alias("order"), F.lit(1).alias("one"))),
        F.transform(values, lambda x: F.struct(x.alias("at"), F.lit(last).alias("order"), F.lit(0).alias("one"))),
    )
    counted = let(F.sort_array(tagged), lambda t: F.zip_with(t, _prefix(F.transform(t, lambda x: x["one"])), lambda x, n: F.struct(x["one"].alias("one"), n.alias("n"))))
    return F.transform(F.filter(counted, lambda x: x["one"] == 0), lambda x: x["n"])


def _free(runs: Column, base: Column) -> Column:
    """Runs that touch no base span: as many spans begin before a run's end as end at its start or before."""

    def untouched(both: Column) -> Column:
        m, b = both["m"], both["b"]
        begun = _ranks(F.transform(m, lambda x: x["e"]), F.transform(b, lambda x: x["s"]), also_equal=False)
        ended = _ranks(F.transform(m, lambda x: x["s"]), F.transform(b, lambda x: x["e"]), also_equal=True)
        flagged = F.arrays_zip(m.alias("m"), begun.alias("begun"), ended.alias("ended"))
        return F.transform(F.filter(flagged, lambda x: x["begun"] == x["ended"]), lambda x: x["m"])

    return let(F.struct(runs.alias("m"), base.alias("b")), lambda both: F.when((F.size(both["m"]) == 0) | (F.size(both["b"]) == 0), both["m"]).otherwise(untouched(both)))


def _tested(spans: Column, cuts: tuple[tuple[float, ...], ...]) -> Column:
    """Array of struct(s, kind, e, cls, bin, v): cls is encoding and length class, bin the calibrated battery; -1 where not tested."""
    tables = F.array(*[F.array(*map(F.lit, c)) for c in cuts])

    def judged(m: Column) -> Column:
        value = F.when(m["kind"] == 1, F.substring(m["v"], 5, 2**30)).otherwise(m["v"])

        def result(v: Column) -> Column:
            enc = p = None
            for i, (_, pattern, symbols) in enumerate(ENCODINGS):
                fits = v.rlike(pattern)
                enc = F.when(fits, i) if enc is None else enc.when(fits, i)
                p = F.when(fits, battery(v, symbols)) if p is None else p.when(fits, battery(v, symbols))
            over = lambda marks: reduce(lambda a, b: a + b, ((F.length(v) >= x).cast("int") for x in marks))
            table = F.get(tables, enc * len(POINTS) + over(POINTS) - 1)
            bin_ = let(F.struct(p.alias("p"), table.alias("t")), lambda x: F.size(F.filter(x["t"], lambda q: q < x["p"])))
            long_enough = F.length(v) >= POINTS[0]
            return F.struct(
                m["s"].alias("s"), m["kind"].alias("kind"), m["e"].alias("e"), F.when(long_enough, enc * 10 + over(LENGTHS)).otherwise(-1).alias("cls"),
                F.when(long_enough, bin_).otherwise(-1).alias("bin"), F.xxhash64(v).alias("v"),
            )

        return let(value, result)

    return F.transform(spans, judged)


def lowest(bins: list[int], fdr: float = FDR) -> int | None:
    """The lowest bin to report, or None: counts by bin are of strings of which the random ones are spread evenly."""
    random = min(2 * sum(bins[BINS // 2 :]), sum(bins))
    for t in range(1, BINS // 2 + 1):
        n = sum(bins[t:])
        if n and (n - random * (1 - t / BINS) + 1) / n <= fdr:
            return t
    return None


def thresholds(spans: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The lowest bin to report by class. At most len(ENCODINGS) * (len(LENGTHS) + 1) * BINS counts reach the driver."""
    each = spans.select(F.explode("spans").alias("x")).select("x.cls", "x.bin", "x.v").where("cls >= 0").distinct()
    by: dict[int, list[int]] = {}
    for r in each.groupBy("cls", "bin").count().collect():
        by.setdefault(r["cls"], [0] * BINS)[r["bin"]] = r["count"]
    out = {}
    for cls, bins in by.items():
        if sum(bins) < LEAST_CLASS:
            bins = [sum(column) for column in zip(*(b for c, b in by.items() if c // 10 == cls // 10), strict=True)]
        low = lowest(bins, fdr)
        if low is not None:
            out[cls] = low
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base array, found array (struct(s, kind, e) each), n_tested, n_random of every row of docs (doc_id, text).

    base: pattern spans; found: what the battery adds; n_tested: base values long enough to be tested, n_random: those of
    them that the battery holds random. Null and empty texts: no spans. Null doc_id stays null, repeated rows are scanned
    each, other columns are not read, an empty table gives no rows. Spans are in code points, end exclusive. Texts are read
    once; only spans are kept between the two steps, and the thresholds are a few numbers.
    """
    text = text_of()
    base = F.concat(matches(text, ASSIGN, 0, group=2, least=MIN_VALUE), matches(text, ACCESS, 1), matches(text, HEX, 2))
    cuts = calibration(docs.sparkSession)
    seen = stored(docs.select("doc_id", let(base, lambda b: _tested(F.concat(b, _free(matches(text, CANDIDATE, 3), b)), cuts)).alias("spans")), "secret-spans")
    lows = thresholds(seen, fdr)
    passes = lambda x: reduce(lambda a, b: a | b, ((x["cls"] == k) & (x["bin"] >= t) for k, t in sorted(lows.items())), F.lit(False))
    bare = lambda keep: F.transform(F.filter("spans", keep), lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    return seen.select(
        "doc_id", bare(lambda x: x["kind"] < 3).alias("base"), bare(lambda x: (x["kind"] == 3) & passes(x)).alias("found"),
        count(lambda x: (x["kind"] < 3) & (x["cls"] >= 0)).alias("n_tested"), count(lambda x: (x["kind"] < 3) & passes(x)).alias("n_random"),
    )


def mask(docs: DataFrame, mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """docs with every span of find_secrets() in text replaced by a mark; all columns stay.

    Null and empty texts stay as they are. Repeated rows are masked each, an empty table gives no rows.
    """
    keyed = docs.withColumn("_tsl_row", F.struct(*docs.columns))
    found = find_secrets(keyed.select(F.col("_tsl_row").alias("doc_id"), "text"), fdr).withColumnRenamed("doc_id", "_tsl_row")
    # Overlapping spans (an access key inside an assignment) act as one: text between the furthest end so far and the next start is kept.
    step = lambda acc, x: F.struct(
        F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("_tsl_row.text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], x["e"]).alias("at"),
    )
    cut = F.aggregate(F.sort_array(F.concat("base", "found")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    whole = F.concat(cut["out"], F.substring(F.col("_tsl_row.text"), cut["at"] + 1, F.length("_tsl_row.text")))
    return found.select(*(whole.alias(c) if c == "text" else F.col(f"_tsl_row.{c}").alias(c) for c in docs.columns))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """The digest columns of find_secrets()."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return find_secrets(docs, fdr).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"), "n_tested", "n_random",
    )
