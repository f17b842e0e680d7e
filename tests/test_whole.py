"""Queries work on whole tables: each gives the rows of its SQL on a larger one as well."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect.operators import consolidate, proposals
from recollect.plans import registry
from test_parity import rows_of

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    if not os.path.isdir(LARGER):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{LARGER}/{table}.parquet'")
    return con


def test_screening_of_all_rows(spark, larger):
    got = registry.queries()["merge_screening"](spark, LARGER).toPandas()
    assert rows_of(got) == rows_of(larger.sql(registry.oracle_sql()["merge_screening"]).df())


def test_screening_stops_at_the_first_decision(spark):
    """One cluster of 40 is decided by its first member, one of 5 by none: 39 + 10 pairs are judged, not 780 + 10."""
    rows = [("one", f"{i:02}", i, "a" * (i + 1)) for i in range(40)] + [("two", f"{i:02}", i, "b") for i in range(5)]
    members = spark.createDataFrame(rows, "cluster string, id string, created_at int, content string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def judge(pairs):
        pairs = pairs.mapInArrow(counted, pairs.schema)
        stated = F.when(F.col("cluster") == "one", "contradicts").otherwise("independent")
        return pairs.withColumns({"verdict": stated, "reason": F.lit("stated"), "obsolete_id": F.col("b")})

    got = {r.cluster: (r.outcome, r.a, r.b) for r in consolidate.screened(members, judge).collect()}
    assert got == {"one": ("contradiction", "00", "01"), "two": ("mergeable", None, None)}
    assert seen.value == 39 + 10


@pytest.mark.parametrize("name", ["proposal_keys", "proposal_overlaps", "proposal_review", "proposal_apply", "run_history", "proposal_status", "hold_back_watermark"])
def test_proposals_and_runs_of_all_rows(spark, larger, monkeypatch, name):
    monkeypatch.setattr(proposals, "STRETCH", 64)  # so that numbers are counted on
    assert rows_of(registry.queries()[name](spark, LARGER).toPandas()) == rows_of(larger.sql(registry.oracle_sql()[name]).df())


def test_consistency_of_all_rows(spark, larger):
    """Every document has an item, and each run is folded in order on its own."""
    want, run, needed, doomed = set(), None, set(), set()
    for (n,) in larger.sql("SELECT doc_id FROM documents ORDER BY doc_id").fetchall():
        if n // 500 != run:
            run, needed, doomed = n // 500, set(), set()
        goes = n + n % 2
        if n % 3 == 0:
            kills, needs = set(), {n, n + 2}
        else:
            kills, needs = {goes}, {n, n + 1} - {goes}
        kept = not kills & (needed | doomed)
        if kept:
            needed, doomed = needed | needs, doomed | kills
        want.add((n, "synthesis" if n % 3 == 0 else "contradiction", kept))
    assert len(want) == 1000 and run == 1
    assert set(map(tuple, registry.queries()["proposal_consistency"](spark, LARGER).collect())) == want
