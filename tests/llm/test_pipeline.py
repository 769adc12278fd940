"""The corpus pipeline: stages in order, their columns, their decisions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing
from tessella.llm.entry import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    text = lambda n: "\n".join(" ".join(f"w{rnd.randrange(4000)}" for _ in range(10)) for _ in range(n))
    rows = [(i, text(12), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1", 1), (101, "short", "en", "s1", 1), (102, rows[5][1] + " w1", "en", "s1", 1), (103, None, None, None, None)]
    passage = " ".join(rows[7][1].split()[20:40])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "mixing"]
    columns, left = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    ids = set(range(60))
    assert left["quality rules"] == ids | {100, 102} and left["line dedup"] == ids | {100, 102}
    assert ids <= left["near-dedup"] and left["decontamination"] == left["near-dedup"] - {7}
    # The mix takes effect: rows stand as often as they have copies, and sources come near their targets.
    before, after = spark.read.parquet(f"{tmp_path}/3"), docs
    assert after.columns == columns and left["mixing"] <= left["decontamination"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in after.collect()) == copies
    words = collections.Counter()
    for r in after.collect():
        words[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in before.collect())
    for r in mixing.mix(before).join(before.select("doc_id", "source"), "doc_id").collect():
        assert abs(words[r.source] - r.target) <= longest
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in got.collect()) == copies
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edges(spark, tmp_path, k):
    """Nulls, empty and long texts, ties and repeated rows, columns that clash; and an empty table."""
    rnd = random.Random(2)
    text = lambda n: "\n".join(" ".join(f"w{rnd.randrange(4000)}" for _ in range(10)) for _ in range(n))
    rows = [(i, text(9), "en", f"s{i % 3}", 1) for i in range(20)] + [(50, text(3000), "en", "s0", 1)]
    rows += [(30, None, None, None, None), (None, text(9), None, None, None), (None, None, None, None, None), (31, "", "en", "s1", 0), (32, " \n\t ", "en", "s1", 4)]
    rows += [rows[0], rows[0], (1, text(9), "en", "s1", 1)]
    spark.createDataFrame([(1, "none of it"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in ("h", "key", "size", "m", "n", "c", "row", "a", "b", "name", "root", "base_failed", "total", "items")})
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in got.collect())
    whole = collections.Counter(r[0] for r in rows)
    if name == "quality rules":
        assert set(ids) == {*range(20), None, 50} and ids[0] == 3 and ids[None] == 1
    elif name in ("line dedup", "decontamination"):
        assert ids == whole
    elif name == "near-dedup":
        assert ids[0] == 1 and ids[1] == 2 and ids[50] == 1 and set(ids) == {*range(20), 50, None}  # texts without words are one group
    else:
        assert set(ids) <= set(whole) and all(ids[i] == whole[i] for i in (30, 31, 32))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == docs.columns and empty.count() == 0
