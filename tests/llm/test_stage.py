"""The pipeline's near-duplicate stage links by five words at 0.8; no stage sends a table through the driver."""

import random

from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline


def test_stage_links_five_words_at_80_percent(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(100_000)]
    rows = []
    for n in range(10):
        text = [r.choice(words) for _ in range(400)]
        scattered = [r.choice(words) if i % 40 == 20 else w for i, w in enumerate(text)]
        rows += [(10 * n, text), (10 * n + 1, [*text, *(r.choice(words) for _ in range(80))]), (10 * n + 2, scattered)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    # an added passage leaves 0.83 of the five-word shingles; ten scattered words leave 0.78 of them and 0.86 of the three-word ones
    assert kept == {10 * n + k for n in range(10) for k in (0, 2)}


def test_no_stage_sends_a_table_through_the_driver(spark, data, monkeypatch):
    """Under a wide limit on broadcasts, as Spark takes an exploded table for one as small as its source."""
    plans, write = [], DataFrameWriter.parquet

    def noting(self, path, *args, **options):
        plans.append((path.rsplit("/", 1)[1].rsplit("-", 1)[0], self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noting)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        packed = corpus_pipeline.run(spark, data)
        plans.append(("packing", packed._jdf.queryExecution().executedPlan().toString()))
        assert packed.select("doc_id").distinct().count() > 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {"quality-rules", "members", "starred", "near", "hooks", "apart", "chosen", "near-duplicates", "personal-data", "packing"} <= {n for n, _ in plans}
    assert [n for n, plan in plans if "BroadcastExchange" in plan] == []
