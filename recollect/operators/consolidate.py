"""Consolidation: candidates, clusters, merges, contradictions, syntheses and the cursor.

Judging and writing syntheses are model calls; they are injected as functions over DataFrames, so a caller decides how
they are batched. A judge takes pairs (a, b, content_a, content_b) and adds verdict, reason and obsolete_id (a null
verdict is a failed call); a writer takes clusters (cluster, sources, contents) and adds content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import contents_joined, origin_of, project_key
from ..functions.metadata import at, overlay
from ..plans.storage import materialise, scratch
from .components import components

Judge = Callable[[DataFrame], DataFrame]
Writer = Callable[[DataFrame], DataFrame]

#: What a judge may answer.
VERDICTS = ("independent", "contradicts", "supersedes")


@dataclass(frozen=True)
class Thresholds:
    neighbour: float = 0.8
    merge: float = 0.94
    contradiction_floor: float = 0.8
    min_synthesis: int = 3
    slack: timedelta = timedelta(seconds=60)
    dedupe: float = 0.9

    def __post_init__(self):
        if self.merge < self.dedupe:
            raise ValueError("the merge threshold must not lie under the duplicate threshold")


@dataclass(frozen=True)
class Cursor:
    """How far a project has been read: all rows up to ``time``, or, with an id, those of that time up to the id as well."""

    time: datetime
    id: str | None = None

    def reached(self) -> tuple:
        """Sorts cursors by what they have read; one without an id has read all of its time."""
        return self.time, self.id is None, self.id or ""


def candidates(thoughts: DataFrame, project: str, watermark: datetime | Cursor, limit: int = 500) -> DataFrame:
    """Live rows of a project ('' for none) with a vector, changed after the watermark, the oldest first, by id at ties.

    ``limit`` holds at ties too: a cursor with an id goes on among rows of one time.
    """
    cursor = watermark if isinstance(watermark, Cursor) else Cursor(watermark)
    live = thoughts.where(F.col("archived") == F.lit(False)).where(F.col("embedding").isNotNull())
    later = F.col("updated_at") > F.lit(cursor.time)
    if cursor.id is not None:
        later = later | ((F.col("updated_at") == F.lit(cursor.time)) & (F.col("id") > cursor.id))
    return live.where(project_key(F.col("project")) == project).where(later).orderBy("updated_at", "id").limit(limit)


def next_cursor(rows: DataFrame, current: Cursor, started: datetime, slack: timedelta, held: DataFrame | None = None) -> Cursor:
    """Behind the last of the candidates, but never past the run's start less the slack, behind the oldest of the rows that
    await review (by a millisecond), and never back."""
    last = rows.agg(F.max(F.struct("updated_at", "id")).alias("x")).first().x
    if last is None:
        return current
    horizon = started - slack
    ahead = Cursor(last.updated_at, last.id) if last.updated_at <= horizon else Cursor(horizon)
    oldest = held.agg(F.min("updated_at")).first()[0] if held is not None else None
    if oldest is not None:
        ahead = min(ahead, Cursor(oldest - timedelta(milliseconds=1)), key=Cursor.reached)
    return max(current, ahead, key=Cursor.reached)


def clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """cluster (its smallest id) and id, for components over the edges at or over the threshold."""
    strong = edges.where(F.col("similarity") >= threshold).select("a", "b")
    roots = components(strong)
    own = roots.select(F.col("root").alias("cluster"), F.col("root").alias("id")).distinct()
    return roots.select(F.col("root").alias("cluster"), F.col("node").alias("id")).unionByName(own)


def can_merge(members: DataFrame) -> DataFrame:
    """cluster, size, mergeable: no disagreement on project, author or origin, a missing one counting as ''."""
    one = lambda c: F.count_distinct(c) <= 1
    author = F.coalesce("created_by", F.lit(""))
    return members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        (one(project_key(F.col("project"))) & one(author) & one(origin_of(F.col("origin"), F.col("source")))).alias("mergeable"),
    )


def member_pairs(left: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, position, a, b: every pair of a row of ``left`` with a later member of its cluster; age, then id, is the order."""
    age = F.struct("created_at", "id")
    first = left.select("cluster", F.col("id").alias("a"), age.alias("i"), F.col("content").alias("content_a"))
    later = members.select("cluster", F.col("id").alias("b"), age.alias("j"), F.col("content").alias("content_b"))
    return first.join(later, "cluster").where("i < j").withColumn("position", F.struct("i", "j")).drop("i", "j")


def _decision(a: Column, b: Column) -> Column:
    verdict, obsolete = F.col("verdict"), F.col("obsolete_id")
    return (
        F.when(verdict.isNull(), "judgment_failed")
        .when(~verdict.isin(*VERDICTS), "unknown_verdict")
        .when(verdict == "independent", F.lit(None))
        .when(obsolete.isNull(), "missing_obsolete_id")
        .when((obsolete != a) & (obsolete != b), "unknown_obsolete_id")
        .otherwise("contradiction")
    )


def screened(members: DataFrame, judge: Judge) -> DataFrame:
    """Per cluster the first decision in pair order: outcome is mergeable, contradiction, or why it is blocked.

    Members are walked in rounds, the oldest first: 1, then 2, 4 and so on of every cluster still undecided meet all
    later members. A decided cluster is left alone, so only one whose pairs are all independent has all of them judged.
    """
    with scratch(members.sparkSession) as keep:
        return keep(_decided(members, judge), "screened")


def _decided(members: DataFrame, judge: Judge) -> DataFrame:
    rows = materialise(members.select("cluster", "id", "created_at", "content"), "screening")
    oldest, width, found = Window.partitionBy("cluster").orderBy("created_at", "id"), 1, []
    rest = rows
    while True:
        taken = rest.withColumn("n", F.row_number().over(oldest)).where(F.col("n") <= width).drop("n")
        taken = materialise(taken, "screening-left")
        if taken.isEmpty():
            break
        judged = judge(member_pairs(taken, rest)).withColumn("outcome", _decision(F.col("a"), F.col("b")))
        first = judged.where("outcome IS NOT NULL").groupBy("cluster").agg(F.min_by(F.struct("outcome", "a", "b", "verdict", "reason", "obsolete_id"), "position").alias("x"))
        found.append(materialise(first, "screening-found"))
        walked = taken.groupBy("cluster").agg(F.max(F.struct("created_at", "id")).alias("walked")).join(found[-1].select("cluster"), "cluster", "left_anti")
        rest = rows.join(materialise(walked, "screening-walked"), "cluster").where(F.struct("created_at", "id") > F.col("walked")).drop("walked")
        width *= 2
    every = rows.select("cluster").distinct()
    decided = reduce(DataFrame.unionByName, found) if found else every.select("cluster", F.lit(None).cast("struct<outcome:string,a:string,b:string,verdict:string,reason:string,obsolete_id:string>").alias("x")).limit(0)
    return every.join(decided, "cluster", "left").select("cluster", F.coalesce("x.outcome", F.lit("mergeable")).alias("outcome"), "x.a", "x.b", "x.verdict", "x.reason", "x.obsolete_id")


def _first_present(value: Column) -> Column:
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct("created_at", "id")))


def _texts(metadata: Column, key: str) -> Column:
    """The texts of a list in metadata, null for none."""
    entries = F.try_variant_get(at(metadata, key), "$", "array<variant>")
    return F.transform(F.filter(entries, lambda e: F.schema_of_variant(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string"))


def lineage_block(op: str, as_of: datetime | None, **lists: Column) -> Column:
    """An object under the key dream: what made a row, when, and of which rows."""
    fields = [F.lit(op).alias("op"), F.lit(as_of.isoformat() if as_of else None).cast("string").alias("run_at"), *[c.alias(n) for n, c in lists.items()]]
    return F.to_variant_object(F.struct(F.struct(*fields).alias("dream")))


def canonical(members: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The merged row of every cluster.

    Contents longest first, contained ones left out; lists united in order of age, those of action items and dates in metadata as well;
    the most frequent type, at ties the earliest member's; source and origin of the earliest member that has one; the rest from the
    earliest member. Metadata names the members under dream.
    """
    age = F.struct("created_at", "id")
    counted = members.withColumn("uses", F.when(F.col("type").isNotNull(), F.count("type").over(Window.partitionBy("cluster", "type"))))
    unite = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))
    listed = ("action_items", "dates")
    metadata = F.col("metadata") if "metadata" in members.columns else F.lit(None).cast("variant")
    counted = counted.withColumns({f"_{k}": _texts(metadata, k) for k in listed})
    merged_rows = counted.groupBy("cluster").agg(
        contents_joined(F.collect_list(F.struct(F.col("id").alias("position"), F.col("content").alias("content")))).alias("content"),
        unite("topics").alias("topics"),
        unite("people").alias("people"),
        F.min_by("type", F.when(F.col("type").isNotNull(), F.struct((-F.col("uses")).alias("u"), "created_at", "id"))).alias("type"),
        _first_present(F.col("source")).alias("source"),
        _first_present(F.col("origin")).alias("origin"),
        F.min_by("project", age).alias("project"),
        F.min_by("created_by", age).alias("created_by"),
        F.min_by("id", age).alias("supersedes"),
        F.transform(F.array_sort(F.collect_list(age)), lambda x: x["id"]).alias("merged_from"),
        *[unite(f"_{k}").alias(f"_{k}") for k in listed],
    )
    parts = [F.when(F.size(f"_{k}") > 0, F.to_variant_object(F.struct(F.col(f"_{k}").alias(k)))) for k in listed]
    whole = overlay(F.parse_json(F.lit("{}")), *parts, lineage_block("merge", as_of, merged_from=F.col("merged_from")))
    return merged_rows.withColumn("metadata", whole).drop(*[f"_{k}" for k in listed])


def merge_audit(merges: DataFrame, thoughts: DataFrame) -> DataFrame:
    """merged (the new row's id), position, source and content of every row that went into a merge, the oldest first; a content is null where the row is gone."""
    each = merges.select(F.concat(F.lit("merge-"), "cluster").alias("merged"), F.posexplode("merged_from").alias("position", "source"))
    texts = thoughts.select(F.col("id").alias("source"), "content").join(each.select("source").distinct(), "source", "left_semi")
    return each.join(texts, "source", "left").select("merged", "position", "source", "content")


def contradiction_pairs(edges: DataFrame, settled: DataFrame, t: Thresholds) -> DataFrame:
    """Edges at or over the floor and under the merge threshold, neither end settled by a merge. Both directions stay."""
    out = edges.where((F.col("similarity") >= t.contradiction_floor) & (F.col("similarity") < t.merge))
    for end in ("a", "b"):
        out = out.join(settled.select(F.col("id").alias(end)).distinct(), end, "left_anti")
    return out.select("a", "b", "similarity")


def contradiction_items(pairs: DataFrame, judge: Judge) -> DataFrame:
    """Usable judgments only: failed, unknown, independent and ill-addressed ones go."""
    return judge(pairs).where(_decision(F.col("a"), F.col("b")) == "contradiction").select("a", "b", "verdict", "reason", "obsolete_id")


def synthesis_clusters(edges: DataFrame, settled: DataFrame, t: Thresholds) -> DataFrame:
    """cluster and sources, for components at the floor without a settled member, of the least size or more."""
    parts = clusters(edges, t.contradiction_floor)
    touched = parts.join(settled.select("id").distinct(), "id").select("cluster").distinct()
    return parts.join(touched, "cluster", "left_anti").groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("sources")).where(F.size("sources") >= t.min_synthesis)


def synthesis_items(groups: DataFrame, writer: Writer) -> DataFrame:
    return writer(groups).where(F.trim(F.coalesce("content", F.lit(""))) != "").select("cluster", "sources", "content")


def next_watermark(rows: DataFrame, current: datetime, started: datetime, slack: timedelta) -> DataFrame:
    """One row: never back, never past the run's start less the slack; unchanged without rows."""
    now, horizon = F.lit(current), F.lit(started - slack)
    newest = F.greatest(F.max("updated_at"), now)
    return rows.agg(F.greatest(now, F.least(newest, horizon)).alias("capped"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") == 0, now).otherwise(F.col("capped")).alias("watermark")
    )


def hold_back(advanced: Column, held: DataFrame, current: datetime) -> DataFrame:
    """One row: behind the oldest row that awaits review by a millisecond, but never before ``current``."""
    return held.agg(F.min("updated_at").alias("oldest")).select(
        F.greatest(F.lit(current), F.least(advanced, F.coalesce(F.col("oldest") - F.expr("INTERVAL 1 MILLISECOND"), advanced))).alias("watermark")
    )
