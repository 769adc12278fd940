"""Benchmark decontamination: windows of benchmark words, looked up in every window of every document.

The benchmark's windows (10 words; a shorter item is one window) form a hash table. Documents are read once: each window
is hashed, probed, and a hit is verified word by word before it counts. The table is broadcast only when its counted
size is below MAX_BROADCAST bytes; beyond, hashes alone are shuffled to the table, and the texts of documents that meet it are
read again to compare words. Which items hold a window is looked up after the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import ascii_lower, let, pieces, row_key, stored, text_of

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, so these part them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, MAX_BROADCAST = 10, 64 << 20


def tokens(text: Column) -> Column:
    return pieces(ascii_lower(text), BETWEEN)


def _window(ws: Column, at: Column, length: int) -> list[Column]:
    """The words at one place. (slice() would copy the whole array each time.)"""
    return [F.get(ws, at + k) for k in range(length)]


def _hashes(ws: Column, length: int) -> Column:
    """Hash of every window of so many words."""
    n = F.size(ws) - length
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*_window(ws, i, length)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """b_hash, b_words (array), b_len, b_name, item: the windows of each item, once an item; b_name is equal for equal words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens(text_of()).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("len", F.least(F.size("ws"), F.lit(window)))
    cut = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("len")), lambda i: _by_length(F.col("len"), range(1, window + 1), lambda n: F.array(*_window(F.col("ws"), i, n))))).alias("b_words"))
    hashed = _by_length(F.col("len"), range(1, window + 1), lambda n: F.get(_hashes(F.col("b_words"), n), F.lit(0)))
    return cut.select(hashed.alias("b_hash"), "b_words", F.col("len").alias("b_len"), F.md5(F.array_join("b_words", " ")).alias("b_name"), "item").distinct()


def _by_length(length: Column, lengths, value) -> Column:
    out = None
    for n in lengths:
        out = F.when(length == n, value(n)) if out is None else out.when(length == n, value(n))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """_tsl_id, _tsl_text, _tsl_spans (sorted array of struct(a, b) over word places from 0, b exclusive; they may overlap), items (sorted array).

    One row for each document (see row_key()) that holds a window of the benchmark.
    """
    all_ = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    table = all_.select("b_hash", "b_words", "b_len", "b_name").distinct()
    sizes = {r["b_len"]: r["bytes"] for r in table.groupBy("b_len").agg(F.sum(F.octet_length(F.array_join("b_words", "")) + 24 * F.size("b_words") + 80).alias("bytes")).collect()}
    lengths = sorted(sizes) or [window]
    texts = docs.select(*row_key(), tokens(text_of()).alias("ws")).withColumn("len", F.explode(F.array(*map(F.lit, lengths))) if len(lengths) > 1 else F.lit(lengths[0]))
    # Hashed below the explode, which is then compiled and does not copy ws into each of its rows.
    texts = texts.withColumn("hashes", _by_length(F.col("len"), lengths, lambda n: _hashes(F.col("ws"), n)))
    here = lambda ws, at, length: _by_length(length, lengths, lambda n: F.array(*_window(ws, at, n)))
    met = (F.col("hash") == F.col("b_hash")) & (F.col("len") == F.col("b_len"))
    # Two orders instead of one equality: the words are then no join key, and are compared only where hashes meet.
    same = lambda words: met & (words <= F.col("b_words")) & (words >= F.col("b_words"))
    if sum(sizes.values()) <= max_broadcast:
        probes = texts.select("_tsl_id", "_tsl_text", "ws", "len", F.posexplode_outer("hashes").alias("at", "hash"))
        found = probes.join(F.broadcast(table), same(here(F.col("ws"), F.col("at"), F.col("len"))))
    else:
        # Outer, or a filter on the hashes would be pushed below the words, and split the text once for each of them.
        probes = texts.select("_tsl_id", "_tsl_text", "len", F.posexplode_outer("hashes").alias("at", "hash"))
        near = probes.join(table.select("b_hash", "b_len").distinct(), met, "left_semi")
        near = stored(near.groupBy("_tsl_id", "_tsl_text").agg(F.collect_set(F.struct("at", "len", "hash")).alias("near")), "benchmark-candidates")
        again = docs.select(*row_key(), text_of().alias("t")).join(near, ["_tsl_id", "_tsl_text"]).groupBy("_tsl_id", "_tsl_text").agg(F.first("t").alias("t"), F.first("near").alias("near"))
        cut = let(tokens(F.col("t")), lambda ws: F.transform("near", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["hash"].alias("hash"), here(ws, x["at"], x["len"]).alias("words"))))
        found = again.select("_tsl_id", "_tsl_text", F.explode(cut).alias("x")).select("_tsl_id", "_tsl_text", "x.*").join(table, same(F.col("words")))
    span = F.struct(F.col("at").alias("a"), (F.col("at") + F.col("len")).alias("b"))
    by = found.groupBy("_tsl_id", "_tsl_text").agg(F.array_sort(F.collect_set(span)).alias("_tsl_spans"), F.collect_set("b_name").alias("names"))
    by = stored(by, "benchmark-spans")
    items = by.select("_tsl_id", "_tsl_text", F.explode("names").alias("b_name")).join(all_.select("b_name", "item"), "b_name").groupBy("_tsl_id", "_tsl_text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return by.drop("names").join(items, ["_tsl_id", "_tsl_text"])


def covered(spans: Column) -> Column:
    """Places inside sorted spans, in one pass."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["b"]).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text).

    Null text: no words. Null doc_id stays null. Repeated rows get the same result each; rows with one id but other texts
    their own. Items without words are no windows; a null item_id reads as ''. An empty benchmark hits nothing; an empty
    table gives no rows. Other columns are not read.
    """
    found = stored(hits(docs, benchmark, window), "benchmark-hits").withColumnsRenamed({"_tsl_id": "_tsl_hit_id", "_tsl_text": "_tsl_hit_text"})
    all_ = docs.select("doc_id", *row_key(), F.size(tokens(text_of())).cast("long").alias("n_words"))
    n_hit = F.coalesce(covered(F.col("_tsl_spans")), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return all_.join(found, (F.col("_tsl_id") == F.col("_tsl_hit_id")) & (F.col("_tsl_text") == F.col("_tsl_hit_text")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows, or (remove="spans") with hit words and what follows them cut from text; all columns.

    Null and empty texts hold nothing and stay. Repeated rows share their fate. An empty benchmark removes nothing; an empty
    table gives no rows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    found = stored(hits(docs, benchmark, window).select(F.col("_tsl_id").alias("_tsl_hit_id"), F.col("_tsl_text").alias("_tsl_hit_text"), "_tsl_spans"), "benchmark-hits")
    keyed = docs.select("*", *row_key("doc_id", "text"))
    same = (F.col("_tsl_id") == F.col("_tsl_hit_id")) & (F.col("_tsl_text") == F.col("_tsl_hit_text"))
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(docs.columns)
    # Words of hit texts and hit places meet by a join: slices of an array would each copy all of it.
    key = ["_tsl_hit_id", "_tsl_hit_text"]
    texts = keyed.select(F.col("_tsl_id").alias(key[0]), F.col("_tsl_text").alias(key[1]), "text").join(found.select(key), key, "left_semi").groupBy(key).agg(F.first("text").alias("text"))
    gaps = F.split(F.col("text"), TOKEN_ANY_CASE, -1)
    pieces = let(gaps, lambda g: F.zip_with(F.regexp_extract_all("text", F.lit(TOKEN_ANY_CASE), F.lit(0)), F.slice(g, F.lit(2), F.size(g) - 1), lambda w, x: F.concat(w, x)))
    places = found.select(*key, F.explode(F.flatten(F.transform("_tsl_spans", lambda x: F.sequence(x["a"], x["b"] - 1)))).alias("at")).distinct()
    left = texts.select(*key, F.posexplode(pieces).alias("at", "piece")).join(places, [*key, "at"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("left"))
    joined = F.concat(F.get(F.split(F.col("text"), TOKEN_ANY_CASE, 2), F.lit(0)), F.coalesce(F.array_join(F.transform("left", lambda x: x["piece"]), ""), F.lit("")))
    cut = F.when(F.col("hit"), joined).otherwise(F.col("text"))
    which = stored(found.select(*key, F.lit(True).alias("hit")).join(left, key, "left"), "texts-left")
    return keyed.join(which, same, "left").select(*(cut.alias(c) if c == "text" else F.col(c) for c in docs.columns))


def oracle() -> str:
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{token}') AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS l FROM (SELECT item_id, regexp_extract_all({lower}, '{token}') AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM b)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, ls WHERE len(ws) >= l)),
h AS (SELECT r, i, dw.l AS l, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
p AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS w FROM (SELECT DISTINCT r, i, l FROM h)) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN q ON d.r = q.r"""
