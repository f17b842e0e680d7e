"""What a task holds or makes does not grow with the input."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as fts
from recollect.functions.embed import trigram_embedder, trigram_vector
from recollect.model import thoughts
from recollect.operators import ann, search, textindex


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark, data):
    return thoughts(spark, data).where(F.col("id").cast("long") < 120)


def test_a_filter_makes_tokens_once(rows):
    df = rows.select("id", fts.tokens(F.col("content")).alias("w")).where(fts.matches(F.col("w"), fts.parse('"of the" -and or token'))).select("id")
    assert plan(df).count("regexp_extract_all") == 1


def test_a_filter_makes_vectors_once(spark):
    df = spark.createDataFrame([(1, "gold")], "n int, t string").withColumn("v", trigram_embedder(8)(F.col("t"))).where(F.col("v").isNotNull())
    assert plan(df).count("embed(") == 1


@pytest.mark.parametrize("text", ["", "?!", "a", "Gold, GOLD and İstanbul 42", None, "ß" * 9 + " zz 9"])
def test_vectors_as_counted_one_by_one(text):
    flat, v = " " + re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip() + " ", np.zeros(64)
    for i in range(len(flat) - 2):
        v[int.from_bytes(hashlib.sha256(flat[i : i + 3].encode()).digest()[:4], "big") % 64] += 1
    assert trigram_vector(text, 64) == (v / (np.sqrt((v * v).sum()) or 1.0)).tolist()


def test_stems_keep_what_words_are_picked_by(rows):
    words = {r[0] for r in rows.select(F.explode(fts.tokens(F.col("content")))).distinct().collect()} | set(fts._WHOLE) | set(fts._FIXED)
    ends = ["", *fts._STEP2, *fts._STEP3, *fts._STEP4, "s", "ied", "ies", "sses", "ing", "edly", "eedly", "y", "ion", "ogi", "li"]
    words |= {a + b + e for a in "aeybst" for b in ("", "a", "b", "y", "bb", "at") for e in ends}
    assert all(w in fts._WHOLE or w.startswith(fts.stem(w)[:2]) for w in words if w)


@pytest.mark.parametrize("query", ['"MIT license" or password -token', "dying or skies", "-license", "the", "licenses licensed"])
def test_python_gets_words_that_may_be_asked_for(rows, query):
    found = search.textual(rows, query)
    whole = search.textual(fts.with_lexemes(rows), query)
    assert found.collect() == whole.collect()
    assert "english_lexemes(" not in plan(found) and ("asked(array_distinct(filter(" in plan(found)) == (query != "the")


def test_kinds_counted(spark):
    df = spark.createDataFrame([("See https://x.org/a b-c 1.2 b-c ../q/r me@x.org v 10.0.1",), (None,), ("b 1.2",)], "t string")
    each = df.select(F.explode(fts.typed_tokens(F.col("t"))).alias("x")).select("x.*").where("kind <> 'part'")
    want = each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("different"), F.min("token").alias("least"))
    got = fts.kinds_counted(df)
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
    assert plan(got).count("Aggregate [token") == 1 and "Expand" not in plan(got)


def test_sample_and_files_of_the_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"{i}", rng.normal(size=8).tolist(), "x" * 1000) for i in range(600)], "id string, embedding array<double>, content string").repartition(12).cache()
    assert ann._least(df.select("id", "embedding"), 40, 600) == df.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(40).collect()
    assert len(ann._least(df.select("id", "embedding"), 40, 10**9)) == 40
    index = ann.AnnIndex.build(df, f"file://{tmp_path}/a", ann.Params(cells=2, codes=4, parts=2, file_bytes=100_000))
    parts = index.rows().select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct().count()
    assert index.rows().count() == 600 and parts >= 5


def test_postings_are_sorted_in_shares(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "STRETCH_BYTES", 200)
    index = textindex.TextIndex.build(rows, f"file://{tmp_path}/t", english=False)
    parts = index.spark.read.parquet(f"{tmp_path}/t/postings").select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct().count()
    assert parts > 8
    assert index.search("the of", 20, english=False).collect() == search.textual(rows, "the of", 20, english=False).collect()
