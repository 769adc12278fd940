"""Quality rules: counts of every document, rules over them, and verdicts on hosts (here: sources).

A host's rate of rule failures is shrunk by a beta prior fitted to all hosts; a host whose posterior lower bound passes
the threshold fails with all its documents. Everything runs as Spark SQL expressions inside one row, without exploding
a document into words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import WORD, beta_strength_sql, let, stored, strength_of, text_of, words

MIN_WORDS, MAX_REPEAT, THRESHOLD, Z = 50, 50, 0.5, 1.645
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that the same array holds twice or more.

    Windows are hashed to 64 bits and sorted with their places; equal neighbours give the repeated places, whose covered
    words are summed in order: n log n, whatever the text repeats. Two windows of one text share a hash with odds of
    n * n / 2^65.
    """

    def covered(at: Column) -> Column:
        """at: sorted places, some twice."""
        gaps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, b: a + b))

    def places(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))

    n = F.size(ws) - 2
    hashes = F.transform(F.slice(ws, F.lit(1), F.greatest(n, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
    return F.when(n < 2, F.lit(0)).otherwise(let(F.sort_array(hashes), lambda s: let(places(s), covered)))


def counts(text: Column) -> Column:
    """A struct of the COUNTS, all long."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), of)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, COUNTS and base_failed of every document."""
    c = F.col("c")
    return docs.select(*keep, counts(text_of()).alias("c")).select(*keep, *(c[x].alias(x) for x in COUNTS), base_failed(c["n_words"], c["n_repeat_words"]).alias("base_failed"))


def host_verdicts(measured: DataFrame, host: str = "source", threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """host_key, n, k, bound, rejected of every host; null hosts are one host. Partial sums make a hot host cheap."""
    sums = stored(measured.groupBy(F.col(host).alias("host_key")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")), "host-failures")
    strength, total = strength_of(sums), sums.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total.k + 0.5) / (total.n + 1.0) if total.n else 0.5
    a, b = F.col("k") + strength * mean, (F.col("n") - F.col("k")) + strength * (1 - mean)
    bound = a / (a + b) - z * F.sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))
    return sums.select("host_key", "n", "k", bound.alias("bound"), (bound > threshold).alias("rejected"))


def judge(docs: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept of every row of docs (doc_id, text, source).

    Null text: no words, so it fails. Null doc_id stays null. Null source: a host of its own. Repeated rows are judged
    each. An empty table gives no rows; other columns are not read.
    """
    m = stored(measure(docs, "doc_id", "source"), "measured")
    rejected = stored(host_verdicts(m, threshold=threshold, z=z).where("rejected").select("host_key", F.lit(True).alias("host_rejected")), "rejected-hosts")
    return m.join(rejected, F.col("source").eqNullSafe(F.col("host_key")), "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("host_rejected").isNull()).alias("kept")
    )


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps.

    Null and empty texts have no words and go. Null source: a host of its own. Repeated rows are judged each. Columns of any
    name go through. An empty table gives no rows. Texts are measured once, by the two counts that rules need; rows that
    pass are stored with the outcome of all, so that they need not be measured again when their hosts are known.
    """
    failed = let(words(text_of()), lambda w: base_failed(F.size(w), repeated_words(w)))
    m = docs.select(F.col("source").alias("source"), failed.alias("base_failed"), F.struct(*docs.columns).alias("row"))
    m = stored(m.withColumn("row", F.when(~F.col("base_failed"), F.col("row"))), "rows-that-pass")
    rejected = stored(host_verdicts(m, threshold=threshold, z=z).where("rejected").select("host_key"), "rejected-hosts")
    return m.where("NOT base_failed").join(rejected, F.col("source").eqNullSafe(F.col("host_key")), "left_anti").select("row.*")


def oracle() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
t AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t),
c AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT w.r AS r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON w.r = c.r),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY source),
s AS (SELECT {beta_strength_sql("h")} AS st, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM h) AS p0),
p AS (SELECT source, k + st * p0 AS a, n - k + st * (1 - p0) AS b FROM h, s),
v AS (SELECT source, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {THRESHOLD} AS bad FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT v.bad AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
