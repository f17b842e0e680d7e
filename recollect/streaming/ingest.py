"""Continuous capture: files of JSON items become batches, each validated, checked and written once.

The stream's checkpoint replaces a stored ingestion cursor. Within a batch, items meet stored rows only.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.capture import Discipline, outcomes
from ..plans.storage import materialise, scratch
from ..sources.store import Store

ITEM = (
    "content string, type string, topics array<string>, people array<string>, source string, project string, created_by string, "
    "supersedes string, extracted_type string, extracted_topics array<string>, extracted_people array<string>, force boolean"
)


#: Rows of a batch whose ids are broadcast.
SMALL = 100_000


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ITEM).json(path)


def capture(stream: DataFrame, store: Store, checkpoint: str, embedder, known_topics: list[str] | None = None, rules: Discipline | None = None, rejects: str | None = None):
    """Start the query; ``rejects``, if given, is a folder for what was not written."""
    rules = rules or Discipline()

    def each(batch: DataFrame, number: int) -> None:
        # ids follow from the content and the batch, so a batch that is replayed gives the same ids
        named = batch.withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(str(number)), F.coalesce("content", F.lit("")), F.coalesce("source", F.lit(""))), 256))
        with scratch(batch.sparkSession):
            named = materialise(named.dropDuplicates(["id"]), "batch")
            # the batch's ids meet the stored ones, not the other way round: what comes back is what a replay would write again
            done = store.read().select("id").join(F.broadcast(named.select("id")), "id", "left_semi") if named.count() <= SMALL else store.read().select("id").join(named.select("id"), "id", "left_semi")
            result = materialise(outcomes(named.join(done, "id", "left_anti"), store.read(), known_topics or [], rules, embedder), "outcomes")
            if rejects:  # a folder a batch: a replay writes it anew
                result.where("status <> 'written'").select("id", "content", "status", "error", "duplicate_of").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            store.insert(result.where("status = 'written'").select("id", "content", "embedding", "type", "topics", "people", "source", "project", "created_by", "supersedes"), datetime.now(timezone.utc).replace(tzinfo=None))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
