"""Proposals: keys, consistency, review and application.

Items are a table: pos (from 0), kind (contradiction or synthesis), a, b, verdict, reason, obsolete_id, content,
sources. A table of several runs names the column that tells them apart.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise, scratch

LONG_CHARS, LONG_RATIO = 2000, 2
#: Positions numbered in one task.
STRETCH = 4096
TTL = timedelta(hours=72)


def keyed(items: DataFrame) -> DataFrame:
    """Items with ``key``: kind and number within the kind, from 1. Stretches of positions are numbered apart, then counted on."""
    rows = items.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    held = rows.groupBy("kind", "stretch").agg(F.count(F.lit(1)).alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("kind").orderBy("stretch")) - F.col("held")
    starts = held.select(F.col("kind").alias("k"), F.col("stretch").alias("s"), earlier.alias("earlier"))
    n = F.row_number().over(Window.partitionBy("kind", "stretch").orderBy("pos")) + F.col("earlier")
    own = rows["kind"].eqNullSafe(starts["k"]) & rows["stretch"].eqNullSafe(starts["s"])
    return rows.join(starts, own).withColumn("key", F.concat_ws(":", "kind", n.cast("string"))).drop("stretch", "k", "s", "earlier")


def _ids() -> Column:
    return F.when(F.col("kind") == "contradiction", F.array("a", "b")).otherwise(F.col("sources"))


def consistent(items: DataFrame, run: str | None = None) -> DataFrame:
    """Items with ``kept``: in order, one that would archive a row which a kept one before it names goes.

    With ``run``, a column, the items of each run are told apart. No item is folded after another: in every round an
    item whose row no earlier undecided item names is settled (it goes if a kept one names the row, else it stays), and
    what it stays or goes for is settled in the next. Per row only the first kept and the first undecided item matter, so a row that
    many items name costs no more than a minimum. Rounds are as many as the longest chain of items that hang on each other.
    """
    with scratch(items.sparkSession) as keep:
        kept = keep(_settled(items, run), "consistent")
    own = ["pos"] if run is None else [run, "pos"]
    return items.join(kept.withColumnRenamed("at", "pos").withColumnRenamed("by", run or "by"), own).drop("by")


def _settled(items: DataFrame, run: str | None) -> DataFrame:
    """by (the run), at (the position) and kept of every item."""
    by = F.col(run) if run else F.lit(0)
    pair = F.col("kind") == "contradiction"
    named = F.when(pair, F.array("a", "b", "obsolete_id")).otherwise(F.col("sources"))
    rows = items.select(by.alias("by"), F.col("pos").alias("at"), F.when(pair, F.col("obsolete_id")).alias("kill"), F.array_distinct(named).alias("names"))
    rows = materialise(rows, "items")
    mentions = rows.select("by", "at", F.explode("names").alias("id")).where(F.col("id").isNotNull())
    state = rows.select("by", "at", "kill", F.when(F.col("kill").isNull(), True).alias("kept"))
    while True:
        state = materialise(state, "settled")
        if state.where("kept IS NULL").isEmpty():
            return state.select("by", "at", "kept")
        # rows that no undecided item would archive need not be looked at any more
        asked = state.where("kept IS NULL").select("by", F.col("kill").alias("id")).distinct()
        live = mentions.join(asked, ["by", "id"], "left_semi").join(state.select("by", "at", "kept"), ["by", "at"])
        first = live.groupBy("by", "id").agg(F.min(F.when(F.col("kept"), F.col("at"))).alias("taken"), F.min(F.when(F.col("kept").isNull(), F.col("at"))).alias("open"))
        judged = state.join(first.withColumnRenamed("id", "kill"), ["by", "kill"], "left")
        verdict = F.when(F.col("taken") < F.col("at"), False).when(F.col("open") >= F.col("at"), True)
        state = judged.select("by", "at", "kill", F.coalesce("kept", verdict).alias("kept"))


def overlaps(items: DataFrame) -> DataFrame:
    """Rows named by more than one item: id, the items' keys, and those that would archive it."""
    each = keyed(items).select("pos", "key", "obsolete_id", F.explode(_ids()).alias("id"))
    entry = F.struct("pos", "key", F.coalesce(F.col("obsolete_id") == F.col("id"), F.lit(False)).alias("dies"))
    grouped = each.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("x")).where(F.size("x") > 1)
    return grouped.select("id", F.transform("x", lambda e: e["key"]).alias("keys"), F.transform(F.filter("x", lambda e: e["dies"]), lambda e: e["key"]).alias("obsolete_in"))


def caution(obsolete: Column, survivor: Column) -> Column:
    """From the lengths of both contents."""
    long = obsolete >= LONG_CHARS
    far = (F.coalesce(survivor, F.lit(0)) == 0) | (obsolete >= LONG_RATIO * survivor)
    return F.when(long & far, F.concat(F.lit("accepting retires "), obsolete.cast("string"), F.lit(" characters, far more than what supersedes them hold")))


def reviewed(items: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Contradictions, the survivor and a caution; only the lengths of both contents (null where a row is gone) are moved."""
    rows = keyed(items).where("kind = 'contradiction'")
    ids = rows.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    lengths = thoughts.select("id", F.length("content").alias("n")).join(ids, "id", "left_semi")
    for end in ("a", "b"):
        rows = rows.join(lengths.select(F.col("id").alias(end), F.col("n").alias(f"length_{end}")), end, "left")
    goes_a = F.col("obsolete_id") == F.col("a")
    return rows.select(
        "key", "a", "b", "obsolete_id", F.when(goes_a, F.col("b")).otherwise(F.col("a")).alias("survivor"),
        caution(F.when(goes_a, F.col("length_a")).otherwise(F.col("length_b")), F.when(goes_a, F.col("length_b")).otherwise(F.col("length_a"))).alias("caution"),
    )


def reviewed_syntheses(items: DataFrame, thoughts: DataFrame) -> DataFrame:
    """key, content, and sources (id and content, null where a row is gone) in the item's order."""
    rows = keyed(items).where("kind = 'synthesis'").select("key", "content", F.posexplode("sources").alias("at", "id"))
    texts = thoughts.select("id", F.col("content").alias("source")).join(rows.select("id").distinct(), "id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("at", "id", F.col("source").alias("content"))))
    sources = F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content")))
    return rows.join(texts, "id", "left").groupBy("key", "content").agg(sources.alias("sources"))


def status(stored: Column, expires_at: Column, as_of: datetime) -> Column:
    return F.when((stored == "open") & (expires_at <= F.lit(as_of)), "expired").otherwise(stored)


def described(proposals: DataFrame, as_of: datetime) -> DataFrame:
    now = status(F.col("status"), F.col("expires_at"), as_of)
    return proposals.select("id", "project", now.alias("status"), "expires_at", (now == "open").alias("actionable"), F.size("items").alias("n_items"))


def partition_by_accepted(items: DataFrame, accept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected items; an unknown key raises before anything is done."""
    rows = keyed(items)
    known = {r.key for r in rows.select("key").where(F.col("key").isin(accept)).collect()}  # the stated keys at most
    if missing := [k for k in accept if k not in known]:
        raise ValueError(f"unknown proposal item {missing[0]}")
    return rows.where(F.col("key").isin(accept)), rows.where(~F.col("key").isin(accept))


def changes(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What accepted items do: (id, archive, supersedes) for existing rows, and new synthesis rows."""
    c = accepted.where("kind = 'contradiction'")
    loses = c.select(F.col("obsolete_id").alias("id"), F.lit(True).alias("archive"), F.lit(None).cast("string").alias("supersedes"))
    winner = F.when(F.col("obsolete_id") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    wins = c.select(winner.alias("id"), F.lit(None).cast("boolean").alias("archive"), F.col("obsolete_id").alias("supersedes"))
    patch = loses.unionByName(wins).groupBy("id").agg(F.max("archive").alias("archive"), F.max("supersedes").alias("supersedes"))
    new = accepted.where("kind = 'synthesis'").select("key", "content", "sources", F.lit("dream").alias("created_by"), F.lit(None).cast("string").alias("project"))
    return patch, new
