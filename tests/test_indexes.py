"""Indexes against scans, table functions against the DataFrame API, and JSON bodies."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as fts
from recollect.functions.vector import probe
from recollect.model import contents, thoughts
from recollect.operators import ann, intake, neighbours, search, table_functions, textindex
from recollect.plans import registry


@pytest.fixture(scope="module")
def bridge(spark, data):
    return thoughts(spark, data, embedding=True)


def plan(df):
    return df._jdf.queryExecution().toString()


# vectors -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding", (F.col("label") % 2 == 0).alias("archived"))
    return rows.withColumn("project", F.lit(None).cast("string"))


def test_recall_on_vectors_without_structure(spark, vectors, tmp_path):
    """The ten nearest of a fifth of all rows: nine tenths at least are found."""
    index = ann.AnnIndex.build(vectors.unionByName(spark.createDataFrame([("zero", [0.0] * 64, False, None), ("none", None, False, None)], vectors.schema)), f"file://{tmp_path}/a")
    assert index.rows().count() == vectors.count()
    asked = vectors.where("cast(id AS INT) % 5 = 0")
    found = {(r.a, r.b) for r in index.neighbours(asked, 10).collect()}
    exact = {(r.a, r.b) for r in neighbours.nearest(asked, vectors, 10, -1.0).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert index.neighbours(asked.limit(0)).count() == 0


def test_search_reads_few_cells_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    rows = [(f"{i:04}", (centres[i % 40] + 0.1 * rng.normal(size=24)).tolist(), i % 7 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, archived boolean").withColumn("project", F.lit(None).cast("string"))
    index = ann.AnnIndex.build(df, f"file://{tmp_path}/b", ann.Params(cells=40))
    assert index.probe <= 8  # of forty
    hits = total = 0
    for i in range(0, 2000, 181):
        got = [r.id for r in index.search(rows[i][1], 10, 0.1).collect()]
        want = [r.id for r in search.semantic(df.withColumns({"content": F.lit(""), "created_at": F.lit(None)}), rows[i][1], 10, 0.1).collect()]
        hits, total = hits + len(set(got) & set(want)), total + len(want)
        assert len(got) == len(want)
    assert hits >= 0.9 * total
    found = index.search(rows[3][1], 3)
    assert "PartitionFilters: [isnotnull(cell" in plan(found).replace("#", "") or "PartitionFilters: [cell" in plan(found)
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    with pytest.raises(ValueError, match="width 24"):
        index.search([1.0], 3)


def test_index_of_nothing(spark, vectors, tmp_path):
    index = ann.AnnIndex.build(vectors.limit(0), f"file://{tmp_path}/c")
    assert index.neighbours(vectors, 5).count() == 0 and index.search([1.0] * 64).count() == 0


# text --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def postings(bridge, tmp_path_factory):
    return textindex.TextIndex.build(bridge, f"file://{tmp_path_factory.mktemp('text')}/t")


@pytest.mark.parametrize("query", ["the of", '"of the" -and or token', "password", "", 'contact "the'])
@pytest.mark.parametrize("english", [False, True])
def test_text_index_equals_the_scan(bridge, postings, query, english):
    rounded = lambda rows: [(r.id, round(r.text_rank, 9)) for r in rows]
    for scope in (None, search.Scope(project="proj1", metadata={"lang": "en"})):
        got = postings.search(query, 20, scope, english)
        assert rounded(got.collect()) == rounded(search.textual(bridge, query, 20, scope, english).collect())
        if english and scope is None and query == "password":
            legs = postings._legs(fts.parse(query), True)
            read = plan(postings._ranked(legs, postings._chunks(legs)).join(postings.documents(), "doc"))
            assert "content" not in read.split("== Physical Plan ==")[1] and "Python" not in read and "PartitionFilters: [isnotnull(bucket" in read


def test_text_index_stops_early(spark, tmp_path, monkeypatch):
    """Rows of one chunk outdo all others; the second pass has no chunk left."""
    monkeypatch.setattr(textindex, "CHUNK", 8)
    monkeypatch.setattr(textindex, "FIRST", 2)
    rows = [(f"{i:03}", "gold " * (9 if 40 <= i < 48 else 1) + "silver") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, content string").coalesce(1).withColumns({"archived": F.lit(False), "created_at": F.current_timestamp()})
    index = textindex.TextIndex.build(df, f"file://{tmp_path}/e", english=False)
    legs = index._legs(fts.parse("gold"), False)
    assert index._chunks(legs).where("bound >= 0.9").count() == 1 and index._chunks(legs).count() == 25
    assert [r.id for r in index.search("gold", 5, english=False).collect()] == ["040", "041", "042", "043", "044"]
    assert [r.id for r in index.search("gold", 20, english=False).collect()] == [r.id for r in search.textual(df, "gold", 20, english=False).collect()]
    with pytest.raises(ValueError):
        index.search("-gold")


def test_typed_tokens(spark):
    said = "Mail Ann.Lee+x@ex-ample.org or see https://ex.org/a?b=1 and db1.ex.org, call 03-5340199; 1.2.3 fell -4.5e-3 in /usr/lib/x.so well-known either/or 1st 42"
    got = spark.createDataFrame([(said,), (None,), ("a-" * 5000 + "z" + "/q" * 5000 + "x" * 100_000,)], "t string").select(fts.typed_tokens(F.col("t")).alias("x")).collect()
    kinds = {}
    for e in got[0].x:
        kinds.setdefault(e.kind, []).append(e.token)
    assert kinds["email"] == ["ann.lee+x@ex-ample.org"] and kinds["url"] == ["https://ex.org/a?b=1"] and kinds["host"] == ["db1.ex.org"]
    assert kinds["version"] == ["1.2.3"]
    assert kinds["compound"] == ["03-5340199", "well-known"] and kinds["number"] == ["-4.5e-3", "42"] and kinds["path"] == ["/usr/lib/x.so", "either/or"]
    assert "1st" in kinds["word"] and "5340199" in kinds["part"]
    whole = next(e.pos for e in got[0].x if e.token == "well-known")
    assert {e.token for e in got[0].x if e.pos == whole} == {"well-known", "well", "known"}
    assert got[1].x == [] and len(got[2].x) > 5000


@pytest.mark.parametrize("seed", range(3))
def test_typed_tokens_against_brute_force(spark, seed):
    """The same alternatives by another engine, one match after the other."""
    import regex

    r = random.Random(seed)
    texts = ["".join(r.choice(["a", "bc", "7", "42", ".", "-", "/", "@", "_", " ", ":", "//", "http", "é", "+", "1.5", "e3", "%", "~", ", ", "org"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", fts.typed_tokens(F.col("t")).alias("x"))
    got = {row.n: [(e.pos, e.kind, e.token) for e in row.x] for row in df.collect()}
    for n, t in enumerate(texts):
        want = []
        for i, m in enumerate(regex.finditer(fts.ANY_TOKEN, t.lower())):
            kind = next(k for k, p in fts.TOKEN_KINDS.items() if regex.fullmatch(p, m[0]) or k == "word")
            want.append((i, kind, m[0]))
            if kind not in ("number", "version", "word"):
                want += [(i, "part", w) for w in regex.findall(r"[\p{L}\p{N}]+", m[0])]
        assert got[n] == want, t


def test_typed_tokens_query_counts_every_row_with_its_parts(spark, tmp_path):
    """The registered query against another engine: parts too, rows with several labels as often as the bridge view has them."""
    import regex

    texts = ["See https://x.org/a-b and me@x.org, well-known 03-5340199 v1.2.3 b -4.5e-3", "see well-known ../q/r well", None, "", "see B"]
    spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in enumerate(texts)] + [(None, "lone-id", "s", "en", 7)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 1), (1, 1), (4, 0), (9, 0), (9, 1), (None, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    said = {}
    for t in [*texts, texts[1], texts[1], "lone-id"]:
        for m in regex.finditer(fts.ANY_TOKEN, (t or "").lower()):
            kind = next(k for k, p in fts.TOKEN_KINDS.items() if regex.fullmatch(p, m[0]) or k == "word")
            said.setdefault(kind, []).append(m[0])
            if kind not in ("number", "version", "word"):
                said.setdefault("part", []).extend(regex.findall(r"[\p{L}\p{N}]+", m[0]))
    want = sorted((kind, len(all_), len(set(all_)), min(all_)) for kind, all_ in said.items())
    assert {"part", "url", "path", "compound"} <= set(said)
    got = registry.queries()["typed_tokens"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("labels", [[(1, 0), (1, 1), (3, 0), (7, 1), (7, 1), (7, 0), (None, 0), (None, 1)], [(1, 0), (5, 1)], []])
def test_contents_are_those_of_the_bridge_view(spark, tmp_path, labels):
    """As often as the view has them, with no exchange of texts whose ids have one label at most."""
    documents = spark.createDataFrame([(i, f"t{i}", "s", "en", 2) for i in (*range(10), 4, None)] + [(2, None, "s", "en", 0)], "doc_id long, text string, source string, lang string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = contents(spark, str(tmp_path))
        said = lambda df: sorted(r.content or "" for r in df.select("content").collect())
        assert said(got) == said(thoughts(spark, str(tmp_path)))
        first, second = (got._jdf.queryExecution().optimizedPlan().children().apply(i).toString() for i in (0, 1))
        assert "Join" not in first and "scalar-subquery" in second
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# SQL -------------------------------------------------------------------------------------------


def test_table_functions_equal_the_api(spark, bridge):
    bridge.createOrReplaceTempView("memories")
    table_functions.register(spark, "memories")
    q = "array(" + ",".join(f"{x!r}D" for x in probe(3.0, 64)) + ")"
    cut = lambda rows: [(r.id, r.matched_by, round(r.score, 9), r.text_rank and round(r.text_rank, 9)) for r in rows]
    for words in ("the of", '"of the" -and or token', "", 'a "b c', "or or -"):
        got = spark.sql(f"SELECT * FROM hybrid_match_thoughts({q}, '{words}', k => 30, threshold => 0.1D)")
        assert cut(got.collect()) == cut(search.hybrid(bridge, probe(3.0, 64), words, 30, 0.1, english=False).collect())
    once = spark.sql(f"SELECT * FROM match_thoughts({q}, 0.1D, project => 'proj1')")
    assert "TakeOrderedAndProject" in plan(once) and "PushedFilters" in plan(once)
    lateral = spark.sql(f"SELECT v.p, l.id FROM (VALUES ('proj0'), ('proj1')) v(p), LATERAL match_thoughts({q}, -1D, 3, project => v.p) l")
    assert {(r.p, r.id) for r in lateral.collect()} == {(p, r.id) for p in ("proj0", "proj1") for r in search.semantic(bridge, probe(3.0, 64), 3, -1.0, search.Scope(project=p)).collect()}


# bodies ------------------------------------------------------------------------------------------


def checked(spark, *bodies, **options):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "n int, body string").withColumn("body", F.parse_json("body"))
    out = intake.checked(df, **options).withColumn("metadata", F.to_json("metadata")).drop("body")
    return [r.asDict(True) | {"metadata": r.metadata and json.loads(r.metadata)} for r in out.orderBy("n").collect()]


def test_bodies(spark):
    rows = checked(
        spark, {"content": "tin rose", "topics": ["tin"], "metadata": {"mood": "dull", "topics": ["own"]}, "zeta": 1}, {"content": " \t"}, {"content": "x", "source": ""},
        {"content": "x", "project": None}, {"content": "x", "supersedes": "7"}, {"content": "x", "metadata": [1]}, [1], {"content": "é" * 3001}, {"content": "x", "type": "idea", "tags": None},
    )
    assert [bool(r["error"]) for r in rows] == [False, True, True, True, True, False, True, False, False]
    assert rows[0]["metadata"] == {"mood": "dull", "topics": ["own"]}
    assert [(w["field"], w["reason"]) for w in rows[0]["warnings"]] == [("topics", "deprecated_top_level"), ("zeta", "unknown_field")]
    assert [(w["field"], w["reason"]) for w in rows[5]["warnings"]] == [("metadata", "wrong_type")] and rows[5]["metadata"] == {}
    assert rows[7]["metadata"] == {"embedding_truncated": True, "embedding_indexed_bytes": 6000, "content_bytes": 6002}
    assert rows[8]["metadata"] == {"type": "idea", "tags": None} and rows[8]["source"] == "api"
    strict = checked(spark, {"content": "x", "zeta": 1}, {"content": "x" * 7000}, {"content": "x", "metadata": "m"}, strict=True)
    assert [bool(r["error"]) for r in strict] == [True, False, True]


def test_batches(spark):
    bodies = [
        {"thoughts": [{"content": "a"}, {"content": "b", "project": "own", "metadata": {"k": 1}, "source": "s"}], "project": "p", "metadata": {"m": 1}, "extra": 1},
        {"thoughts": [{"content": "a"}, {"content": ""}, 5]}, {"thoughts": []}, {"thoughts": [{"content": "a"}], "created_by": 7}, "text",
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "batch int, body string").withColumn("body", F.parse_json("body"))
    out = intake.batches(df).withColumn("metadata", F.to_json("metadata")).orderBy("batch", "item").collect()
    by = {}
    for r in out:
        by.setdefault(r.batch, []).append(r)
    assert [(r.item, r.project, r.source, json.loads(r.metadata)) for r in by[0]] == [(0, "p", "api", {"m": 1}), (1, "own", "s", {"k": 1})]
    assert all(r.batch_error is None and [w.field for w in r.envelope_warnings] == ["extra"] for r in by[0])
    assert {r.batch_error for r in by[1]} == {"item 1: content must be a text that is not blank"} and len(by[1]) == 3
    assert [len(by[i]) for i in (2, 3, 4)] == [1, 1, 1] and all(by[i][0].batch_error and by[i][0].item is None for i in (2, 3, 4))
    assert intake.batches(df, strict=True).where("batch = 0 AND batch_error IS NULL").count() == 0


def test_random_metadata_against_python(spark):
    """Containment by paths equals containment by walking the values."""
    from recollect.functions import metadata

    r = random.Random(2)

    def value(depth):
        kind = r.randint(0, 5 if depth else 3)
        return [1, "a", True, None][kind] if kind < 4 else [value(depth - 1) for _ in range(r.randint(0, 2))] if kind == 4 else {k: value(depth - 1) for k in r.sample("xyz", r.randint(0, 2))}

    def holds(v, w):
        if isinstance(w, dict):
            return isinstance(v, dict) and all(k in v and holds(v[k], x) for k, x in w.items())
        if isinstance(w, list):
            return isinstance(v, list) and all(any(holds(y, x) for y in v) for x in w)
        return type(v) is type(w) and v == w

    rows = [{k: value(2) for k in r.sample("xyz", r.randint(0, 3))} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)], "n int, m string").withColumn("m", F.parse_json("m")).coalesce(1)
    asked = [{k: value(1) for k in r.sample("xyz", r.randint(0, 2))} for _ in range(12)]
    got = df.select("n", *[metadata.contains(F.col("m"), w).alias(f"w{i}") for i, w in enumerate(asked)]).orderBy("n").collect()
    assert [[g[f"w{i}"] for i in range(len(asked))] for g in got] == [[holds(x, w) for w in asked] for x in rows]
