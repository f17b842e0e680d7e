"""A consolidation run: read behind the cursor, unify spellings, merge, propose, and move the cursor.

What a run touches is bounded by its candidates (500, also among rows of one time: the cursor is a time and an id) and their
neighbours (6 each); those small tables are written between the steps because several later steps read them. Stored
tables get the rows that a run changes, so its cost does not follow their history. One writer at a time is assumed.
"""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import timestamp
from ..functions.labels import project_key
from ..plans.storage import materialise
from ..sources.store import Store, VersionedTable
from . import consolidate, neighbours, proposals, stats, vocabulary
from .consolidate import Cursor, Judge, Thresholds, Writer

ITEM = "struct<pos:int,kind:string,a:string,b:string,verdict:string,reason:string,obsolete_id:string,content:string,sources:array<string>>"
PROPOSALS = f"id string, project string, created_at timestamp, expires_at timestamp, applied_at timestamp, status string, items array<{ITEM}>"
STATE = "project string, watermark timestamp, watermark_id string, last_run_at timestamp, last_run_stats map<string,bigint>"
RUNS = (
    "run_id string, project string, status string, dry_run boolean, trigger string, applied map<string,bigint>, proposed map<string,bigint>, "
    "skipped map<string,bigint>, candidates bigint, clusters bigint, proposal_id string, error string, started_at timestamp, finished_at timestamp"
)
OPS = ("vocabulary", "merge", "contradiction", "synthesis")
EPOCH = datetime(1970, 1, 1)


@dataclass
class Outcome:
    """What a run did or, in a dry run, would have done. The DataFrames are bounded by the run's candidates."""

    project: str
    applied: dict[str, int] = field(default_factory=dict)
    proposed: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    candidates: int = 0
    clusters: int = 0
    proposal_id: str | None = None
    watermark: datetime | None = None
    changes: DataFrame | None = None
    merges: DataFrame | None = None
    items: DataFrame | None = None

    def bump(self, table: dict[str, int], key: str, n: int) -> None:
        if n:
            table[key] = table.get(key, 0) + n


def settled_ids(items: DataFrame) -> DataFrame:
    """Every row id that items name."""
    ids = F.when(F.col("kind") == "contradiction", F.array("a", "b")).otherwise(F.col("sources"))
    return items.select(F.explode(ids).alias("id")).distinct()


class Consolidator:
    def __init__(
        self, spark: SparkSession, store: Store, root: str, judge: Judge, writer: Writer, thresholds: Thresholds | None = None,
        topic_aliases: dict[str, str] | None = None, person_aliases: dict[str, str] | None = None, embedder: Callable[[Column], Column] | None = None,
    ):
        """``embedder`` makes the vectors of merged and synthesised rows; without one they have none, and no vector search finds them."""
        self.embedder = embedder
        self.spark, self.store, self.judge, self.writer = spark, store, judge, writer
        self.t = thresholds or Thresholds()
        self.proposals = VersionedTable(spark, f"{root}/proposals", PROPOSALS)
        self.state = VersionedTable(spark, f"{root}/state", STATE, key="project")
        self.runs = VersionedTable(spark, f"{root}/runs", RUNS)
        table = lambda m: spark.createDataFrame(sorted((m or {}).items()), "variant string, canonical string")
        self.configured = {"topics": table(topic_aliases), "people": table(person_aliases)}

    # steps ---------------------------------------------------------------------------

    def _vocabulary(self, rows: DataFrame, candidates: DataFrame, project: str) -> DataFrame:
        counts = materialise(stats.vocabulary(rows, project), "vocabulary")
        of = lambda f: counts.where(F.col("field") == f).select("value", "n")
        topics = vocabulary.merge_aliases(vocabulary.keyed_topics(vocabulary.topic_aliases(of("topics"))), self.configured["topics"])
        people = vocabulary.merge_aliases(vocabulary.keyed_people(vocabulary.person_aliases(of("people"))), self.configured["people"])
        topics, people = materialise(topics, "topic-aliases"), materialise(people, "person-aliases")
        live = rows.where(F.col("archived") == F.lit(False)).where(project_key(F.col("project")) == project)
        swept = []
        for name, table, key in (("topics", topics, vocabulary.normalise_topic(F.col("value"))), ("people", people, F.lower(F.trim("value")))):
            stale = vocabulary.stale_spellings(of(name), table, key).select("value")
            tagged = live.select("id", F.explode(name).alias("value")).join(stale, "value", "left_semi").select("id")
            swept.append(tagged)
        ids = candidates.select("id").unionByName(swept[0]).unionByName(swept[1]).distinct()
        due = rows.join(ids, "id", "left_semi").select("id", "topics", "people")
        return vocabulary.planned_changes(due, topics, people, of("topics"))

    def run(
        self, project: str, as_of: datetime, ops: tuple[str, ...] = OPS, dry_run: bool = False, since: datetime | str | None = None, trigger: str = "manual",
        limit: int = 500,
    ) -> Outcome:
        """One project ('' for rows without). ``since`` (a text in ISO form, or a time) widens what is read; the stored cursor never goes back."""
        since = timestamp(since) if isinstance(since, str) else since
        out = Outcome(project)
        run_id, error = uuid.uuid4().hex, None
        try:
            self._steps(out, project, as_of, ops, dry_run, since, limit)
        except Exception:
            error = traceback.format_exc(limit=1)
            raise
        finally:
            if not dry_run or error is None:
                self._record(out, run_id, as_of, dry_run, trigger, error)
        return out

    def _steps(self, out: Outcome, project: str, as_of: datetime, ops: tuple[str, ...], dry_run: bool, since: datetime | None, limit: int) -> None:
        t, rows = self.t, self.store.read()
        stored = self.state.read().where(F.col("project") == project).select("watermark", "watermark_id").first()
        cursor = Cursor(*stored) if stored else Cursor(EPOCH)
        candidates = materialise(consolidate.candidates(rows, project, since or cursor, limit), "candidates")
        out.candidates = candidates.count()
        edges = materialise(neighbours.edges(candidates, rows, t.neighbour), "edges")
        ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        known = materialise(rows.join(ends, "id", "left_semi"), "known")

        if "vocabulary" in ops:
            out.changes = materialise(self._vocabulary(rows, candidates, project), "changes")
            out.bump(out.applied, "vocabulary", out.changes.count())
            if not dry_run and out.applied.get("vocabulary"):
                self.store.patch(out.changes.select("id", F.col("new_topics").alias("topics"), F.col("new_people").alias("people")), as_of)

        items = []
        settled = self.spark.createDataFrame([], "id string")
        if "merge" in ops:
            members = consolidate.clusters(edges, t.merge).join(known, "id")
            fit = materialise(consolidate.can_merge(members).where("size > 1"), "fit")
            out.clusters = fit.count()
            out.bump(out.skipped, "merge_incompatible_sources", fit.where(~F.col("mergeable")).count())
            members = materialise(members.join(fit.where("mergeable").select("cluster"), "cluster", "left_semi"), "members")
            screen = materialise(consolidate.screened(members, self.judge), "screen")
            kinds = {r.outcome: r["count"] for r in screen.groupBy("outcome").count().collect()}  # seven outcomes
            found = screen.where("outcome = 'contradiction'")
            n = kinds.pop("contradiction", 0)
            if "contradiction" in ops:
                items.append(found.select(F.lit(0).alias("step"), F.lit("contradiction").alias("kind"), "a", "b", "verdict", "reason", "obsolete_id"))
                out.bump(out.proposed, "contradiction", n)
            else:
                out.bump(out.skipped, "merge_contradicts", n)
            out.bump(out.applied, "merge", kinds.pop("mergeable", 0))
            out.bump(out.skipped, "merge_unscreened", sum(kinds.values()))
            merging = members.join(screen.where("outcome = 'mergeable'").select("cluster"), "cluster", "left_semi")
            merges = consolidate.canonical(merging, as_of)
            out.merges = materialise(merges.withColumn("embedding", self.embedder(F.col("content"))) if self.embedder else merges, "merges")
            settled = materialise(merging.select("id").unionByName(found.select(F.explode(F.array("a", "b")).alias("id"))), "settled")
            if not dry_run and out.applied.get("merge"):
                self.store.merge(out.merges, as_of)

        contents = known.select("id", "content")
        if "contradiction" in ops:
            pairs = consolidate.contradiction_pairs(edges, settled, t)
            for end in ("a", "b"):
                pairs = pairs.join(contents.select(F.col("id").alias(end), F.col("content").alias(f"content_{end}")), end)
            found = materialise(consolidate.contradiction_items(pairs, self.judge), "contradictions")
            out.bump(out.proposed, "contradiction", found.count())
            items.append(found.select(F.lit(1).alias("step"), F.lit("contradiction").alias("kind"), "a", "b", "verdict", "reason", "obsolete_id"))
        if "synthesis" in ops:
            groups = consolidate.synthesis_clusters(edges, settled, t)
            texts = groups.select("cluster", F.explode("sources").alias("id")).join(contents, "id").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]).alias("contents"))
            found = materialise(consolidate.synthesis_items(groups.join(texts, "cluster"), self.writer), "syntheses")
            out.bump(out.proposed, "synthesis", found.count())
            items.append(found.select(F.lit(2).alias("step"), F.lit("synthesis").alias("kind"), "content", "sources"))
        self._propose(out, items, project, as_of, dry_run)
        self._advance(out, candidates, project, cursor, as_of, dry_run)

    def _propose(self, out: Outcome, parts: list[DataFrame], project: str, as_of: datetime, dry_run: bool) -> None:
        every = self.spark.createDataFrame([], T.StructType.fromDDL("step int, kind string, a string, b string, verdict string, reason string, obsolete_id string, content string, sources array<string>"))
        for p in parts:
            every = every.unionByName(p, allowMissingColumns=True)
        # at most a few items per candidate: one array orders and numbers them
        listed = every.agg(F.array_sort(F.collect_list(F.struct("step", "a", "b", "kind", "verdict", "reason", "obsolete_id", "content", "sources"))).alias("x"))
        numbered = listed.select(F.posexplode("x").alias("pos", "x")).select("pos", "x.*").drop("step")
        judged = materialise(proposals.consistent(numbered), "items")
        out.bump(out.skipped, "proposal_conflict", judged.where(~F.col("kept")).count())
        order = ["pos", "kind", "a", "b", "verdict", "reason", "obsolete_id", "content", "sources"]
        out.items = judged.where("kept").select(*order)
        if dry_run or out.items.isEmpty():
            return
        out.proposal_id = uuid.uuid4().hex
        new = out.items.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("items")).select(
            F.lit(out.proposal_id).alias("id"), F.lit(project).alias("project"), F.lit(as_of).alias("created_at"), F.lit(as_of + proposals.TTL).alias("expires_at"),
            F.lit(None).cast("timestamp").alias("applied_at"), F.lit("open").alias("status"), "items",
        )
        before = self.proposals.read().where((F.col("project") == project) & (F.col("status") == "open"))
        self.proposals.change(before.withColumn("status", F.lit("superseded")).unionByName(new))

    def _advance(self, out: Outcome, candidates: DataFrame, project: str, cursor: Cursor, as_of: datetime, dry_run: bool) -> None:
        held = candidates.join(settled_ids(out.items), "id", "left_semi")
        ahead = consolidate.next_cursor(candidates, cursor, as_of, self.t.slack, held)
        out.watermark = ahead.time
        if not dry_run:
            stats_map = F.create_map(*[F.lit(x) for pair in (out.applied | {"candidates": out.candidates}).items() for x in pair]).cast("map<string,bigint>")
            row = self.spark.range(1).select(F.lit(project).alias("project"), F.lit(ahead.time).alias("watermark"), F.lit(ahead.id).cast("string").alias("watermark_id"), F.lit(as_of).alias("last_run_at"), stats_map.alias("last_run_stats"))
            self.state.change(row)

    def _record(self, out: Outcome, run_id: str, as_of: datetime, dry_run: bool, trigger: str, error: str | None) -> None:
        row = (run_id, out.project, "failed" if error else "ok", dry_run, trigger, out.applied, out.proposed, out.skipped, out.candidates, out.clusters, out.proposal_id, error, as_of, as_of)
        self.runs.append(self.spark.createDataFrame([row], RUNS))

    # whole table, review and application ------------------------------------------------

    def run_all(self, as_of: datetime, **options) -> tuple[list[Outcome], list[str]]:
        """Every project with live rows; a failure is recorded and the others go on. Returns outcomes and failed projects."""
        done, failed = [], []
        for r in stats.projects(self.store.read()).orderBy("project").toLocalIterator():
            try:
                done.append(self.run(r.project, as_of, trigger="scheduled", **options))
            except Exception:
                failed.append(r.project)
        return done, failed

    def history(self, project: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.runs.read() if project is None else self.runs.read().where(F.col("project") == project)
        return rows.orderBy(F.col("started_at").desc(), "run_id").limit(max(1, min(200, limit)))

    def merge_audit(self, merges: DataFrame) -> DataFrame:
        """What went into the merges of a run (``Outcome.merges``), or would have."""
        return consolidate.merge_audit(merges, self.store.read())

    def pending(self, project: str, as_of: datetime) -> DataFrame:
        rows = proposals.described(self.proposals.read().where(F.col("project") == project), as_of)
        return rows.where("actionable")

    def items(self, proposal_id: str) -> DataFrame:
        return self.proposals.read().where(F.col("id") == proposal_id).select(F.inline("items"))

    def review(self, proposal_id: str) -> DataFrame:
        return proposals.reviewed(self.items(proposal_id), self.store.read())

    def review_syntheses(self, proposal_id: str) -> DataFrame:
        return proposals.reviewed_syntheses(self.items(proposal_id), self.store.read())

    def apply(self, proposal_id: str, accept: list[str], as_of: datetime, embedder=None) -> tuple[list[str], list[str]]:
        """Apply the accepted items of an open, unexpired proposal; returns applied and rejected keys."""
        stored = self.proposals.read().where(F.col("id") == proposal_id).select("status", "expires_at").first()
        if stored is None:
            raise KeyError(proposal_id)
        if stored.status != "open":
            raise ValueError(f"proposal {proposal_id} is {stored.status}, not open")
        if stored.expires_at <= as_of:
            self._set_status(proposal_id, "expired", None)
            raise ValueError(f"proposal {proposal_id} has expired")
        accepted, rejected = proposals.partition_by_accepted(materialise(self.items(proposal_id), "to-apply"), accept)
        patch, new = proposals.changes(accepted)
        if not patch.isEmpty():
            self.store.patch(patch, as_of)
        if not new.isEmpty():
            rows = new.select(F.sha2(F.concat_ws(":", F.lit(proposal_id), "key"), 256).alias("id"), "content", "created_by", "project", F.lit("dream").alias("source"),
                              F.lit("observation").alias("type"), consolidate.lineage_block("synthesis", as_of, sources=F.col("sources")).alias("metadata"))
            embedder = embedder or self.embedder
            self.store.insert(rows.withColumn("embedding", embedder(F.col("content"))) if embedder else rows, as_of)
        self._set_status(proposal_id, "applied", as_of)
        keys = lambda df: [r.key for r in df.select("key").orderBy("pos").collect()]
        return keys(accepted), keys(rejected)

    def _set_status(self, proposal_id: str, status: str, applied_at: datetime | None) -> None:
        row = self.proposals.read().where(F.col("id") == proposal_id)
        self.proposals.change(row.withColumns({"status": F.lit(status), "applied_at": F.lit(applied_at).cast("timestamp")}))


__all__ = ["Consolidator", "Outcome", "settled_ids"]
