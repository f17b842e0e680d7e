import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions.embed import trigram_embedder
from recollect.sources.store import Store, consumed, merged, patched, purged, upserted
from recollect.streaming import ingest

T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"content {i}") for i in ids], "id string, content string")


def test_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", keep=2)
    assert s.read().count() == 0
    s.insert(rows(spark, "a", "b", "c"), T1)
    s.set_supersedes("b", "a", T2)
    s.archive(["c"], T2)
    s.delete("a", T2)
    got = {r.id: r for r in s.read().collect()}
    assert set(got) == {"b", "c"} and got["b"].supersedes is None and got["c"].archived and got["b"].updated_at == T2
    assert len(s.versions()) == 2
    with pytest.raises(KeyError):
        s.update("zz", {"content": F.lit("x")}, T2)
    s.update("b", {"content": F.lit("new")}, T2)
    assert s.read().where("id = 'b'").first().content == "new"


def test_patch_and_merge(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    s.insert(rows(spark, "a", "b"), T1)
    out = patched(s.read(), spark.createDataFrame([("a", True, None)], "id string, archive boolean, supersedes string"), T2)
    assert {r.id: (r.archived, r.updated_at) for r in out.collect()} == {"a": (True, T2), "b": (False, T1)}
    canon = spark.createDataFrame([("a", "both", ["a", "b"])], "cluster string, content string, merged_from array<string>")
    out = {r.id: r.archived for r in merged(s.read(), canon, T2).collect()}
    assert out == {"a": True, "b": True, "merge-a": False}


def test_upsert_and_single_use(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in upserted(old, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    codes = spark.createDataFrame([("x", None, T2), ("y", None, T1)], "code string, consumed_at timestamp, expires_at timestamp")
    hit, left = consumed(codes, "x", T1)
    assert hit.count() == 1 and consumed(left, "x", T1)[0].count() == 0
    assert consumed(codes, "y", T1)[0].count() == 0
    assert purged(codes, T1).count() == 1


def test_stream_of_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    items = [{"content": "gold broke out", "type": "idea"}, {"content": "   "}, {"content": "silver fell", "type": "task"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, items)))
    store = Store(spark, f"file://{tmp_path}/t")
    start = lambda: ingest.capture(ingest.items(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), trigram_embedder(32), rejects=str(tmp_path / "no")).trigger(availableNow=True).start().awaitTermination()
    start()
    assert {r.content for r in store.read().collect()} == {"gold broke out", "silver fell"}
    (tmp_path / "in" / "2.json").write_text(json.dumps({"content": "Gold broke out!", "type": "idea"}))
    start()
    assert store.read().count() == 2
    assert {r.status for r in spark.read.parquet(str(tmp_path / "no")).collect()} == {"rejected", "duplicate"}


def bytes_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_write_costs_what_it_changes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    s.insert(spark.range(20_000).select(F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256).alias("content")), T1)
    whole = bytes_of(tmp_path)
    for write in (lambda: s.insert(rows(spark, "new"), T2), lambda: s.archive(["5"], T2), lambda: s.delete("6", T2), lambda: s.update("7", {"content": F.lit("x")}, T2)):
        before = bytes_of(tmp_path)
        write()
        assert bytes_of(tmp_path) - before < whole / 20
    got = {r.id: r for r in s.read().where("id IN ('5', '6', '7', 'new')").collect()}
    assert s.read().count() == 20_000 and set(got) == {"5", "7", "new"} and got["5"].archived and got["7"].content == "x"
    s.compact()
    assert s.read().count() == 20_000 and len(s.parts(s.versions()[-1])) == 1
    assert s.read(s.versions()[0]).where("id = '6'").count() == 0


def test_parts_are_compacted(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    s.most_parts = 4
    for n in range(6):
        s.insert(rows(spark, f"{n}"), T1)
        s.archive([f"{n}"], T2)
    assert len(s.parts(s.versions()[-1])) < 4 and s.read().where("archived").count() == 6
