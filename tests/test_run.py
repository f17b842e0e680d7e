import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect import config
from recollect.functions import metadata
from recollect.operators import consolidate, vocabulary
from recollect.operators.run import Consolidator
from recollect.sources.store import Store

T0, NOW = datetime(2026, 8, 1), datetime(2026, 8, 20)


def judge(pairs):
    """Texts that hold "not" contradict; the other one of the pair goes."""
    against = F.col("content_a").contains("not") != F.col("content_b").contains("not")
    loser = F.when(F.col("content_a").contains("not"), F.col("b")).otherwise(F.col("a"))
    return pairs.withColumns({"verdict": F.when(against, "contradicts").otherwise("independent"), "reason": F.lit("r"), "obsolete_id": F.when(against, loser)})


def writer(groups):
    return groups.withColumn("content", F.array_join("contents", " / "))


@pytest.fixture
def brain(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    v = lambda a: [1.0, a]
    rows = [
        ("1", "gold rose", v(0.0), ["market"], ["Varkas"], "p"), ("2", "gold rose again", v(0.01), ["markets"], ["Varkas"], "p"),  # merge
        ("3", "silver fell", [0.0, 1.0], ["market"], ["Bert Varkas"], "p"), ("4", "silver did not fall", [0.01, 1.0], ["market"], None, "p"),  # contradict inside a merge
        ("5", "copper", [-1.0, 0.0], None, [], "p"), ("6", "copper two", [-1.0, 0.5], None, None, "p"), ("7", "copper three", [-1.0, -0.5], None, None, "p"),  # synthesis
        ("8", "lead", [0.0, -1.0], None, None, "q"), ("9", "no vector", None, None, None, None),
    ]
    ddl = "id string, content string, embedding array<float>, topics array<string>, people array<string>, project string"
    store.insert(spark.createDataFrame(rows, ddl).withColumn("source", F.lit("s")), T0)
    return Consolidator(spark, store, f"file://{tmp_path}/state", judge, writer)


def test_dry_run_writes_nothing_but_its_record(brain):
    before = brain.store.versions()
    out = brain.run("p", NOW, dry_run=True)
    assert out.applied["merge"] == 1 and out.proposed == {"contradiction": 1, "synthesis": 1} and out.proposal_id is None
    assert brain.store.versions() == before and brain.proposals.versions() == [] and brain.state.versions() == []
    assert brain.history("p").first().dry_run


def test_run_review_apply(brain):
    out = brain.run("p", NOW)
    assert out.candidates == 7 and out.applied["merge"] == 1
    rows = {r.id: r for r in brain.store.read().collect()}
    assert rows["1"].archived and rows["2"].archived and rows["merge-1"].content == "gold rose again"
    block = json.loads(brain.store.read().where("id = 'merge-1'").select(F.to_json("metadata")).first()[0])
    assert block == {"dream": {"op": "merge", "run_at": NOW.isoformat(), "merged_from": ["1", "2"]}}
    assert rows["2"].topics == ["market"] and rows["3"].people == ["Varkas"]
    # rows under review hold the cursor back
    assert out.watermark < T0
    assert brain.pending("p", NOW).count() == 1
    kinds = {r.kind for r in brain.items(out.proposal_id).collect()}
    assert kinds == {"contradiction", "synthesis"}
    assert {r.obsolete_id for r in brain.review(out.proposal_id).collect()} == {"3"}
    with pytest.raises(ValueError):
        brain.apply(out.proposal_id, ["contradiction:7"], NOW)
    applied, rejected = brain.apply(out.proposal_id, ["contradiction:1", "synthesis:1"], NOW)
    assert applied == ["contradiction:1", "synthesis:1"] and rejected == []
    rows = {r.id: r for r in brain.store.read().collect()}
    assert rows["3"].archived and rows["4"].supersedes == "3"
    assert [r.content for r in rows.values() if r.created_by == "dream"] == ["copper / copper two / copper three"]
    with pytest.raises(ValueError):
        brain.apply(out.proposal_id, [], NOW)


def test_later_run_supersedes_and_expiry(brain):
    first = brain.run("p", NOW, ops=("contradiction", "synthesis"))
    second = brain.run("p", NOW + timedelta(hours=1), ops=("contradiction", "synthesis"), since=T0 - timedelta(days=1))
    status = {r.id: r.status for r in brain.proposals.read().collect()}
    assert status == {first.proposal_id: "superseded", second.proposal_id: "open"}
    with pytest.raises(ValueError):
        brain.apply(second.proposal_id, [], NOW + timedelta(days=9))
    assert brain.proposals.read().where(F.col("id") == second.proposal_id).first().status == "expired"


def test_ops_gate_and_all_projects(brain):
    done, failed = brain.run_all(NOW, ops=("merge",))
    assert [o.project for o in done] == ["", "p", "q"] and failed == []
    assert done[1].skipped == {"merge_contradicts": 1} and done[1].proposed == {}
    assert brain.history().count() == 3


def test_resolution_by_join_equals_maps(spark):
    rows = spark.createDataFrame([("1", ["Markets", "golds", " ", "Markets", "new one"], ["varkas ", "Ann"]), ("2", None, []), ("3", ["market"], ["Ann"])], "id string, topics array<string>, people array<string>")
    table = lambda m: spark.createDataFrame(list(m.items()), "variant string, canonical string")
    topics, people = {"markets": "market"}, {"varkas": "Bert Varkas"}
    known = spark.createDataFrame([("gold",), ("market",)], "value string")
    a = vocabulary.planned_changes(rows, table(topics), table(people), known).orderBy("id").collect()
    b = vocabulary.vocabulary_changes(rows, topics, people, ["gold", "market"]).orderBy("id").collect()
    assert a == b and a[0].new_topics == ["market", "gold", "new-one"]
    notes = {r.original: r.action for r in vocabulary.resolve_entries(rows, "topics", table(topics), known).collect()}
    assert notes == {"Markets": "canonicalised", "golds": "canonicalised", "new one": "new_topic", "market": None}


def test_metadata_filters(spark):
    texts = ['{"type": "task", "topics": ["a", "b"], "n": {"x": 1, "y": [1, {"k": 2}]}, "z": null, "t": true, "a.b": 7, "d": 1.5}', '{"topics": "a"}', None, "broken", "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "m string").select(metadata.parsed(F.col("m")).alias("m"))
    ask = lambda w: "".join("x" if r[0] else "." for r in df.select(metadata.contains(F.col("m"), w)).collect())
    for wanted in ({"type": "task", "topics": ["b"]}, {"n": {"y": [{"k": 2}]}}, {"z": None}, {"t": True}, {"n": {"x": 1.0}}, {"a.b": 7}, {"d": 1.5}, {"topics": []}):
        assert ask(wanted) == "x....", wanted
    for wanted in ({"t": 1}, {"n": {"x": "1"}}, {"topics": ["c"]}, {"missing": None}, {"n": [1]}, {"d": 1}):
        assert ask(wanted) == ".....", wanted
    assert ask({}) == "xx..." and ask({"topics": "a"}) == ".x..."
    assert [r[0] for r in df.select(metadata.has_entry(F.col("m"), "topics", "a")).collect()] == [True, True, False, False, False]
    assert "Python" not in df.select(metadata.contains(F.col("m"), {"n": {"y": [1]}}))._jdf.queryExecution().toString()


def test_metadata_merge_is_shallow(spark):
    df = spark.createDataFrame([('{"a": {"x": 1}, "b": 2}', '{"a": {"y": 3}, "c": null}'), ('{"a": 1}', None), (None, '{"a": 1}'), (None, None)], "m string, p string")
    got = [r[0] and json.loads(r[0]) for r in df.select(F.to_json(metadata.merged(F.try_parse_json("m"), F.try_parse_json("p")))).collect()]
    assert got == [{"a": {"y": 3}, "b": 2, "c": None}, {"a": 1}, {"a": 1}, None]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"personAliases": {"Varkas": "Bert Varkas"}, "selfNames": ["me"], "requireProject": True, "dedupeThreshold": 0.8}))
    c = config.discipline(str(p), {"RECOLLECT_REQUIRE_PROJECT": "false", "RECOLLECT_DEDUPE_THRESHOLD": "zero"})
    assert c.person_aliases == {"varkas": "Bert Varkas"} and c.self_names == ("me",) and not c.require_project
    assert config.search_threshold({"RECOLLECT_SEARCH_THRESHOLD": "7"}) == 0.5 and config.search_threshold({"RECOLLECT_SEARCH_THRESHOLD": "0.2"}) == 0.2
    assert config.thresholds({"RECOLLECT_MERGE": "0.97"}).merge == 0.97
    assert config.timestamp("2026-08-01T12:00:00+02:00") == datetime(2026, 8, 1, 10) and config.timestamp(None) is None
    for text in ("", "soon", "1754042400", "2026-13-01"):
        with pytest.raises(ValueError):
            config.timestamp(text)
    with pytest.raises(ValueError):
        config.thresholds({"RECOLLECT_MERGE": "0.5"})


def test_merged_rows_are_found_again(spark, brain):
    from recollect.functions.embed import trigram_embedder, trigram_vector
    from recollect.operators.search import semantic

    brain.embedder = trigram_embedder(32)
    brain.run("p", NOW, ops=("merge",))
    rows = brain.store.read().where("id LIKE 'merge-%'")
    assert rows.where("embedding IS NULL").count() == 0
    content = rows.first().content
    wide = brain.store.read().where(F.size("embedding") == 32)
    assert semantic(wide, trigram_vector(content, 32), 1).first().id == "merge-1"


def test_rows_of_one_time_are_read_in_bounded_runs(spark):
    """A bulk insert gives all rows one time: the cursor goes on among them, by id, and loses none."""
    rows = spark.range(1203).select(
        F.format_string("%05d", F.col("id")).alias("id"), F.lit(False).alias("archived"), F.array(F.lit(1.0)).alias("embedding"), F.lit("p").alias("project"),
        F.when(F.col("id") < 3, F.lit(T0)).otherwise(F.lit(NOW)).alias("updated_at"),
    ).cache()
    cursor, seen = consolidate.Cursor(T0 - timedelta(days=1)), []
    while some := consolidate.candidates(rows, "p", cursor, 500).collect():
        assert len(some) <= 500
        seen += [r.id for r in some]
        cursor = consolidate.next_cursor(spark.createDataFrame(some), cursor, NOW + timedelta(hours=1), timedelta(seconds=60))
    assert seen == [f"{i:05}" for i in range(1203)]
    assert consolidate.candidates(rows.limit(0), "p", T0, 3).count() == 0


def test_cursor_bounds(spark):
    rows = spark.createDataFrame([("1", T0), ("2", NOW)], "id string, updated_at timestamp")
    start, slack, now = consolidate.Cursor(T0 - timedelta(days=1)), timedelta(seconds=60), NOW
    ahead = lambda *a, **k: consolidate.next_cursor(*a, **k)
    assert ahead(rows, start, now, slack) == consolidate.Cursor(NOW - slack)  # not past the start less the slack
    assert ahead(rows, start, now + timedelta(days=1), slack) == consolidate.Cursor(NOW, "2")
    assert ahead(rows, start, now + timedelta(days=1), slack, rows.where("id = '1'")) == consolidate.Cursor(T0 - timedelta(milliseconds=1))
    late = consolidate.Cursor(NOW + timedelta(days=3))
    assert ahead(rows, late, now, slack) == late and ahead(rows.limit(0), start, now, slack) == start


def test_runs_go_on_behind_the_last_candidate(brain):
    seen = [brain.run("p", NOW, ops=("merge",), limit=3).candidates for _ in range(4)]
    assert sum(seen) >= 7 and max(seen) == 3 and seen[-1] in (0, 1)
    row = brain.state.read().where("project = 'p'").first()
    assert row.watermark >= T0


def test_lineage_goes_to_the_end(spark):
    from recollect.operators import browse

    n = F.col("id")
    rows = spark.range(170).select(n.cast("string").alias("id"), F.when(n > 0, (n - 1).cast("string")).alias("supersedes"))
    assert {(r.id, r.depth) for r in browse.lineage(rows, "160").collect()} == {(str(i), 160 - i) for i in range(161)}
    odd = rows.limit(3).unionByName(spark.createDataFrame([("a'b\\", "2"), ("r", "s"), ("s", "r")], "id string, supersedes string"))
    assert browse.lineage(odd, "a'b\\").count() == 4 and browse.lineage(odd, "none").count() == 0
    with pytest.raises(ValueError, match="ring"):
        browse.lineage(odd, "r")
