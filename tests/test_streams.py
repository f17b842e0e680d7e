"""Streams: the vocabulary as state, and captures that are replayed."""

import json
import time
from datetime import timedelta

import pytest

from recollect.streaming import topics


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", topics.PROVIDER)
    (tmp_path / "in").mkdir()

    def feed(name, *rows):
        part = tmp_path / f"{name}.json"
        part.write_text("".join(json.dumps(dict(zip(("id", "project", "topics"), r))) + "\n" for r in rows))
        part.rename(tmp_path / "in" / part.name)

    def answers(n, **options):
        """What the stream says of the next ``n`` items. A state that expires keeps a query busy, so it is stopped, not awaited."""
        rows = spark.readStream.schema("id string, project string, topics array<string>").json(f"file://{tmp_path}/in")
        got = []
        sink = lambda batch, n: got.extend(batch.collect())
        query = topics.resolved(rows, **options).writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/state").start()
        until = time.monotonic() + 60
        while query.isActive and len(got) < n and time.monotonic() < until:
            time.sleep(0.2)
        if query.isActive:
            time.sleep(1)  # the batch is committed after its sink
        query.stop()
        return {r.id: (r.topics, r.new_topics) for r in got}

    yield feed, answers
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_vocabulary_over_two_batches(stream):
    feed, answers = stream
    feed("a", ("1", "p", ["Tin Mine", "tin-mines", ""]), ("2", "q", ["ores"]), ("3", None, None))
    first = answers(3, seeds={"q": ["ore"]})
    assert first == {"1": (["tin-mine"], ["tin-mine"]), "2": (["ore"], []), "3": ([], [])}
    feed("b", ("4", "p", ["tin_mines", "ore"]), ("5", "q", ["tin-mine", "ore"]), ("6", None, ["ore"]))
    # what one project says another does not know; a seed is not sown twice
    assert answers(3, seeds={"q": ["ore"]}) == {"4": (["tin-mine", "ore"], ["ore"]), "5": (["tin-mine", "ore"], ["tin-mine"]), "6": (["ore"], ["ore"])}


def test_vocabulary_expires(stream):
    feed, answers = stream
    feed("a", ("1", "p", ["tin"]))
    assert answers(1, ttl=timedelta(seconds=2)) == {"1": (["tin"], ["tin"])}
    time.sleep(3)
    feed("b", ("2", "p", ["tin"]))
    assert answers(1, ttl=timedelta(seconds=2)) == {"2": (["tin"], ["tin"])}


def test_a_failed_batch_leaves_the_state(spark, stream, tmp_path):
    feed, answers = stream
    feed("a", ("1", "p", ["tin"]))
    answers(1)
    feed("b", ("2", "p", ["lead"]))
    rows = spark.readStream.schema("id string, project string, topics array<string>").json(f"file://{tmp_path}/in")

    def broken(batch, n):
        batch.collect()
        raise RuntimeError("no sink")

    query = topics.resolved(rows).writeStream.foreachBatch(broken).option("checkpointLocation", f"file://{tmp_path}/state").start()
    with pytest.raises(Exception, match="no sink"):
        query.awaitTermination(60)
    assert answers(1) == {"2": (["lead"], ["lead"])}
