"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and CAP whose expected words meet every source's target, the ones nearest to 1 in
relative entropy are r = min(CAP, exp(lambda_s * z)), z being the document's size over its source's mean. Newton steps on
the convex dual find each source's lambda; a step is one aggregation over (source, size) counts, kept inside brackets.
Rates are rounded to whole copies: equal rows are one group of m rows at rate m * r; a group gets the whole part, and one
more in order of (fraction minus a hash of the row), as many groups as bring the source nearest its target. That order is
searched by histograms, never sorted in one place; a group's copies are spread evenly over its rows.

All that is known of sources stays in tables keyed by source, however many there are; only totals and flags reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import WORD, drop_stored, stored, text_of

WEIGHTS, CAP = (1, 2, 3), 3
STEPS, TOLERANCE, BINS, ROUNDS, DIGITS = 60, 1e-11, 1024, 5, 7
#: Rows of one group that a row of the intermediate table stands for, at most.
BLOCK = 65_536


def source_key(source: str = "source") -> Column:
    """Non-null and in order of code point, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def row_hash() -> Column:
    """Names a row by id, source and text; its first 52 bits order the rounding."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source_key(), text_of()))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key (source), size, h, m: equal rows of docs as one, counted map-side."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", source_key().alias("key"), size.alias("size"), row_hash().alias("h")).groupBy("doc_id", "key", "size", "h").agg(F.count("*").alias("m"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (key, ...) with weight: the weights, repeating, in order of key. Ranks are counted range by range."""
    placed = stored(sources.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    all_parts = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a range
    before = placed.groupBy("part").count().select("part", (F.sum("count").over(all_parts) - F.col("count")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return placed.join(before, "part").select(*sources.columns, F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int")).alias("weight"))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (words, weight) with target: shares of all words by weight, none above cap times its own."""
    all_ = sources.agg(F.sum("words").alias("t"), F.sum("weight").alias("w")).first()
    share, capped = (all_.t or 0) / (all_.w or 1), -1
    full = lambda: F.col("weight") * F.lit(float(share)) > cap * F.col("words")
    while True:
        over = sources.where(full()).agg(F.count("*").alias("n"), F.sum("words").alias("t"), F.sum("weight").alias("w")).first()
        if over.n == capped or over.w == all_.w:
            break
        share, capped = (all_.t - cap * (over.t or 0)) / (all_.w - (over.w or 0)), over.n
    return sources.withColumn("target", F.when(full(), (cap * F.col("words")).cast("double")).otherwise(F.col("weight") * F.lit(float(share))))


def tilts(sizes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (key, words, target, n documents with words) with mean and tilt (lambda); sizes: (key, size, n).

    Newton on the dual: its gradient is the words that the rates give less the target. Each step stays within the bracket
    that earlier signs have left. Rates at the cap stop moving, so a target of cap times the words is met in the limit.
    """
    names, some = sources.columns, F.col("words") > 0
    live = some & (F.col("target") > 0) & (F.col("target") < cap * F.col("words") * (1 - 1e-12))
    start = F.when(live, F.ln(F.col("target") / F.col("words"))).when(F.col("target") > 0, 700.0).otherwise(-700.0)
    state = stored(sources.where(some).select("*", (F.col("words") / F.greatest(F.col("n"), F.lit(1))).alias("mean"), start.alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), live.alias("live")), "tilts")
    z = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))) * F.col("size") * F.col("c")
    slope = F.when(F.col("tilt") * z < math.log(cap), rate * z).otherwise(0.0)
    for _ in range(STEPS):
        if not state.where("live").limit(1).count():
            break
        again = [F.first(c).alias(c) for c in state.columns if c != "key"]
        sums = sizes.withColumnRenamed("n", "c").join(state, "key").groupBy("key").agg(F.sum(rate).alias("g"), F.sum(slope).alias("s"), *again)
        miss = F.col("g") - F.col("target")
        low, high = F.when(miss > 0, F.col("low")).otherwise(F.col("tilt")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        done = (F.abs(miss) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") < 1e-12)
        step = F.col("tilt") - F.try_divide(miss, F.col("s"))
        middle = F.when((low < 64) & (high > -64), (F.greatest(low, F.lit(-64.0)) + F.least(high, F.lit(64.0))) / 2).otherwise((low + high) / 2)
        went = F.when(F.col("live") & ~done, F.when((step > low) & (step < high), step).otherwise(middle)).otherwise(F.col("tilt"))
        before = state
        state = stored(sums.select(*names, "mean", went.alias("tilt"), F.when(F.col("live"), low).otherwise(F.col("low")).alias("low"), F.when(F.col("live"), high).otherwise(F.col("high")).alias("high"), (F.col("live") & ~done).alias("live")), "tilts")
        drop_stored(before)
    none = sources.where(~some).select("*", F.lit(1.0).alias("mean"), F.lit(0.0).alias("tilt"))
    return state.select(*names, "mean", "tilt").union(none)


def _rounding(size: Column, m: Column, h: Column, tilt: Column, mean: Column, cap: int) -> tuple[Column, Column]:
    """(whole copies of a group of m equal rows, v: its order for one more, in (-1, 1); null: none)."""
    rate = F.when(size == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(float(cap)), F.exp(F.least(tilt * size / mean, F.lit(50.0)))), DIGITS))
    whole = F.floor(rate * m)
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(2**52)
    return whole, F.when((size > 0) & (whole < cap * m), rate * m - whole - u)


def cuts(x: DataFrame, want: DataFrame) -> DataFrame:
    """key, cut: the v from which groups get one copy more; x: (key, size, v), want: (key, want: words to add).

    Words are counted in ever finer bins from the highest v down; the bin that passes the wish is opened again until it
    holds one group, which is taken if that comes nearer.
    """
    span = stored(want.select("key", "want", F.lit(-1.0).alias("low"), F.lit(2.0).alias("width"), F.lit(2.0).alias("cut"), F.lit(True).alias("live")), "cuts")
    x = x.where("v IS NOT NULL")
    for _ in range(ROUNDS):
        here = x.join(span.where("live"), "key").withColumn("bin", F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS))
        bins = here.where(F.col("bin").between(0, BINS - 1)).groupBy("key", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("c"), F.first("want").alias("want"))
        sums = bins.withColumn("got", F.sum("w").over(Window.partitionBy("key").orderBy(F.desc("bin"))))  # BINS rows a source
        passing = F.max(F.when(F.col("got") > F.col("want"), F.struct("bin", "got", "w", "c"))).alias("at")
        found = sums.groupBy("key").agg(passing, F.min("bin").alias("least"))
        step, at, before = F.col("width") / BINS, F.col("at"), F.col("at.got") - F.col("at.w")
        edge = F.col("low") + at["bin"] * step
        nearer = F.when(at["got"] - F.col("want") < F.col("want") - before, edge).otherwise(edge + step)
        cut = F.when(~F.col("live") | F.col("least").isNull(), F.col("cut")).when(at.isNull(), F.col("low") + F.col("least") * step).otherwise(nearer)
        old = span
        span = stored(span.join(found, "key", "left").select(
            "key", F.when(at.isNull(), F.col("want")).otherwise(F.col("want") - before).alias("want"), F.when(at.isNull(), F.col("low")).otherwise(edge).alias("low"),
            F.when(at.isNull(), F.col("width")).otherwise(step).alias("width"), cut.alias("cut"), (F.col("live") & at.isNotNull() & (at["c"] > 1)).alias("live"),
        ), "cuts")
        drop_stored(old)
        if not span.where("live").limit(1).count():
            break
    return span.select("key", "cut")


def _plan(docs: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """(groups: doc_id, key, size, h, m; sources: key, words, target, mean, tilt, cut)."""
    groups = stored(grouped(docs), "row-groups")
    words = groups.groupBy("key").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("m"))), F.lit(0)).alias("n"))
    goal = targets(stored(weighted(words, weights), "weighted-sources"), cap)
    sizes = stored(groups.where("size > 0").groupBy("key", "size").agg(F.sum("m").alias("n")), "size-counts")
    tilted = stored(tilts(sizes, goal, cap), "tilted-sources")
    drop_stored(sizes)
    whole, v = _rounding(F.col("size"), F.col("m"), F.col("h"), F.col("tilt"), F.col("mean"), cap)
    x = stored(groups.where("size > 0").join(tilted, "key").select("key", "size", "target", whole.alias("whole"), v.alias("v")), "rates")
    want = x.groupBy("key").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("want"))
    sources = stored(tilted.join(cuts(x.select("key", "size", "v"), want), "key", "left").withColumn("cut", F.coalesce("cut", F.lit(2.0))), "mixed-sources")
    for t in (x, tilted):
        drop_stored(t)
    return groups, sources


def _total(m: Column, cap: int) -> Column:
    """Copies of a group of m equal rows."""
    whole, v = _rounding(F.col("size"), m, F.col("h"), F.col("tilt"), F.col("mean"), cap)
    return (whole + F.when(v >= F.col("cut"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of docs (doc_id, text, source).

    Null text: no words. Null source: one source, the last. Null doc_id: mixed like any other. Repeated rows (id, source and
    text) share their copies as evenly as whole copies go, which of them get one more being of no account. A document
    without words is taken once and adds nothing. An empty table gives no rows. Other columns are not read. The same rows
    give the same copies in any order and partitioning.
    """
    groups, sources = _plan(docs, weights, cap)
    x = groups.join(sources, "key").withColumn("total", _total(F.col("m"), cap))
    names = ["doc_id", "size", "words", "target", "total", "m"]
    few = x.where(F.col("m") <= BLOCK).select(*names, F.lit(0).cast("long").alias("from"))
    # Large groups are cut into blocks, which go to other tasks before they become rows.
    many = x.where(F.col("m") > BLOCK).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(BLOCK).cast("long"))).alias("from")).repartition(F.expr("xxhash64(doc_id, `from`)"))
    rows = few.unionByName(many).select(*names, F.explode(F.sequence("from", F.least(F.col("m"), F.col("from") + BLOCK) - 1)).alias("i"))
    copies = (F.floor(F.col("total") / F.col("m")) + F.when(F.col("i") < F.col("total") % F.col("m"), 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "size", F.col("words").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs, all columns, as the mix takes them: every row as often as it has copies, so those without are gone.

    Rows equal in id, source and text come from the one of them whose other columns have the least hash. Their texts alone
    are brought together; all others stay where they are read. See mix() for nulls, empty texts and tables.
    """
    groups, sources = _plan(docs, weights, cap)
    repeated = stored(groups.where("m > 1").select("h", "m"), "repeated-rows")
    row = F.struct(*docs.columns)
    keyed = docs.select(row_hash().alias("h"), source_key().alias("key"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), row.alias("row"))
    once = keyed.join(repeated, "h", "left_anti").withColumn("m", F.lit(1).cast("long"))
    least = F.min_by("row", F.xxhash64("row")).alias("row")
    again = keyed.join(repeated.select("h"), "h", "left_semi").groupBy("h", "key", "size").agg(least).join(repeated, "h")
    x = once.unionByName(again).join(sources.drop("target", "words", "weight", "n"), "key").select("row", _total(F.col("m"), cap).alias("total")).where("total > 0")
    blocks = x.select("row", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(BLOCK).cast("long"))).alias("from"))
    rows = blocks.select("row", F.explode(F.sequence("from", F.least(F.col("total"), F.col("from") + BLOCK) - 1)).alias("i"))
    return rows.select("row.*")


def oracle() -> str:
    """The same by bisection of every source's lambda and one sort of every source's groups."""
    w = r"[^\x20\x09-\x0D]+"
    rate = "round(least(3, exp(least({t} * size / mean, 50))), 7)"
    u = "list_sum(list_transform(range(1, 14), lambda k: (instr('0123456789abcdef', substr(h, k, 1)) - 1) * pow(16, 13 - k))) / pow(2, 52)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, key, CAST(len(regexp_extract_all(t, '{w}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || key || chr(31) || t) AS h, count(*) AS m FROM d GROUP BY ALL),
s0 AS (SELECT key, CAST(sum(size * m) AS BIGINT) AS words, CAST(sum(CASE WHEN size > 0 THEN m ELSE 0 END) AS BIGINT) AS n FROM g GROUP BY key),
s1 AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, (sum(words) OVER () - 3 * coalesce(sum(words) OVER before, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS share
  FROM s1 WINDOW before AS (ORDER BY words / CAST(weight AS DOUBLE), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT key, words, n, words / CAST(greatest(n, 1) AS DOUBLE) AS mean, least(CAST(3 * words AS DOUBLE), weight * (SELECT arg_min(share, words / CAST(weight AS DOUBLE)) FROM s2 WHERE weight * share <= 3 * words)) AS target FROM s1),
sz AS (SELECT key, list({{'s': size, 'c': c}}) AS l FROM (SELECT key, size, CAST(sum(m) AS DOUBLE) AS c FROM g WHERE size > 0 GROUP BY key, size) GROUP BY key),
b AS (SELECT key, CAST(-700 AS DOUBLE) AS low, CAST(700 AS DOUBLE) AS high, 0 AS i FROM s3 WHERE target > 0 AND target < 3 * words * (1 - 1e-12)
  UNION ALL SELECT key, CASE WHEN f > target THEN low ELSE t END, CASE WHEN f > target THEN t ELSE high END, i + 1 FROM (
    SELECT b.key AS key, low, high, i, target, (low + high) / 2 AS t, list_sum(list_transform(l, lambda x: least(3, exp(least((low + high) / 2 * x.s / mean, 50))) * x.s * x.c)) AS f
    FROM b JOIN s3 ON b.key = s3.key JOIN sz ON b.key = sz.key WHERE i < 90)),
t AS (SELECT s3.*, CASE WHEN words = 0 THEN 0 WHEN target = 0 THEN -700 ELSE coalesce((low + high) / 2, 700) END AS tilt FROM s3 LEFT JOIN b ON b.key = s3.key AND i = 90),
r AS (SELECT g.*, words, target, CASE WHEN size = 0 THEN 1 ELSE {rate.format(t="tilt")} END AS rate, {u} AS u FROM g JOIN t ON g.key = t.key),
x AS (SELECT *, floor(rate * m) AS whole, CASE WHEN size > 0 AND floor(rate * m) < 3 * m THEN rate * m - floor(rate * m) - u END AS v FROM r),
want AS (SELECT key, any_value(target) - sum(whole * size) AS want FROM x WHERE size > 0 GROUP BY key),
o AS (SELECT x.key AS key, h, sum(size) OVER (PARTITION BY x.key ORDER BY v DESC, h) AS got, size, want FROM x JOIN want ON x.key = want.key WHERE v IS NOT NULL),
more AS (SELECT key, h FROM o WHERE got <= want OR (got - size <= want AND got - want < want - (got - size))),
y AS (SELECT x.*, CAST(whole + CASE WHEN more.h IS NULL THEN 0 ELSE 1 END AS BIGINT) AS total FROM x LEFT JOIN more ON x.key = more.key AND x.h = more.h),
z AS (SELECT doc_id, size, words, target, total // m + CASE WHEN i < total % m THEN 1 ELSE 0 END AS copies FROM (SELECT *, unnest(range(m)) AS i FROM y))
SELECT doc_id, size, words AS source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM z"""
