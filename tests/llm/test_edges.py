"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, secret_scans, simhash, substring_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120)
    rows = [(i, text(rnd.randint(1, 150)) + "\n" + text(5), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s1", 1), (102, base + " tail", "en", "s1", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \t\n\x0b ", "en", "s0", 5), (203, "one", "en", "s2", 3)]
    rows += [(204, "ñandú Ünder x   \U0001f600 word", "es", "s2", 1), (None, text(60), "en", "s0", 1), (None, None, None, None, None)]
    rows += [(205, text(30_000), "en", "s0", 1), (206, "x " * 20_000, "en", "s1", 1), (207, "w" * 200_000, "en", "s1", 1)]
    return rows + [rows[0], rows[0], rows[33]]


LABELS = [(0, 1), (1, 0), (2, 1), (3, 0), (100, 0), (100, 1), (None, 1), (999, None)]


def label_table(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, bad int")


def items(spark, rows=((1, "a b c"), (2, None), (None, "d e f g h a b c d e f g"), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPS = {
    "classify": lambda s, d: quality_classifier.classify(d.withColumnsRenamed({"source": "host", "lang": "path"}), label_table(s)),
    "secrets": lambda s, d: secret_scans.scan(d),
    "decontaminate": lambda s, d: decontamination.scan(d, items(s)),
    "mix": lambda s, d: mixing.mix(d),
    "rules": lambda s, d: quality_rules.judge(d),
    "lines": lambda s, d: line_dedup.digest(d),
    "score": lambda s, d: lm_scoring.score(d),
    "simhash": lambda s, d: simhash.digest(d),
    "substrings": lambda s, d: substring_dedup.digest(d),
    "urls": lambda s, d: url_filters.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.example.net/"), "text").alias("url")), label_table(s).withColumnRenamed("doc_id", "page_id")),
}
ROWS = {
    "keep_good": lambda s, d: quality_rules.keep_good(d),
    "dedup_lines": lambda s, d: line_dedup.dedup_lines(d),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "drop_contaminated": lambda s, d: decontamination.decontaminate(d, items(s)),
    "cut_contaminated": lambda s, d: decontamination.decontaminate(d, items(s), "spans"),
    "remove_repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "mask": lambda s, d: secret_scans.mask(d),
}


def table(df):
    return sorted(df.toPandas().astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", OPS)
def test_digest(spark, name):
    rows = docs_rows()
    docs = spark.createDataFrame(rows, DOCS)
    out = OPS[name](spark, docs)
    got = table(out)
    assert len(got) == len(rows)
    extra = {c: F.lit("z") for c in out.columns if c not in docs.columns and c not in ("host", "path")} | {c: F.lit(7) for c in ("key", "h", "size", "hits", "spans", "c", "a", "b", "fp", "keys", "wide", "row", "bad", "k", "n")}
    again = OPS[name](spark, spark.createDataFrame(rows[::-1], DOCS).repartition(3).withColumns(extra))
    if name == "classify":  # floating sums may come in another order
        cut = lambda r: [(x[0], x[-1]) for x in r]
        assert sorted(cut(table(again))) == sorted(cut(got))
    elif name == "score":
        sums = lambda df: df.withColumns({c: F.round(c, 6) for c in ("base_score", "score", "perplexity")})
        assert table(sums(again)) == table(sums(out))
    else:
        assert table(again) == got
    empty = OPS[name](spark, spark.createDataFrame([], DOCS))
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("name", ROWS)
def test_rows(spark, name):
    rows = docs_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("hits", "h", "n", "spans", "key", "count")})
    out = ROWS[name](spark, docs)
    assert out.columns == docs.columns
    assert 0 < out.count() <= len(rows)
    assert ROWS[name](spark, spark.createDataFrame([], DOCS)).count() == 0


def test_no_labels_no_benchmark(spark):
    docs = spark.createDataFrame(docs_rows(), DOCS)
    none = quality_classifier.classify(docs.withColumnsRenamed({"source": "host", "lang": "path"}), label_table(spark, []))
    assert none.count() == len(docs_rows())
    assert decontamination.scan(docs, items(spark, [])).where("contaminated").count() == 0
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://b.org/fr/x"), (None, "http://H.net:80/")], "page_id long, url string")
    got = {r.page_id: r for r in url_filters.filter_urls(pages, label_table(spark, []).withColumnRenamed("doc_id", "page_id")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[3].rule, got[3].verdict) == ("org/fr/", "allow") and got[None].host == "h.net:80" and got[None].rule is None
