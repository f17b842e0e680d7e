"""The vocabulary of a stream as state: topics by project, with counts, that expire when nobody uses them.

Items come with a project and topics. Each is answered with its topics in stored spelling (with or without a final s, as the project
has it) and with those its project did not have yet; new ones are known from that item on, to later items of the same batch as well.
A topic that is not used for ``ttl`` is forgotten. The state lies in the stream's checkpoint, so a failed batch leaves what was known
before, and a replayed one gives the same answers. State is per project and topic: a project's topics never pass through one value.

Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.labels import normalise_topic, project_key

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "project string, id string, topics array<string>, new_topics array<string>"


class _Vocabulary(StatefulProcessor):
    def __init__(self, ttl: timedelta | None, seeds: dict[str, list[str]]):
        self.ttl = int(ttl.total_seconds() * 1000) if ttl else None
        self.seeds = seeds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.uses = handle.getMapState("uses", "topic string", "n long", self.ttl)
        self.seeded = handle.getValueState("seeded", "done boolean")

    def _known(self, topic: str) -> str | None:
        """The project's spelling of a topic."""
        forms = [topic, topic[:-1]] if topic.endswith("s") else [topic]
        return next((t for t in [*forms, f"{topic}s"] if t and self.uses.containsKey((t,))), None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (project,) = key
        if not self.seeded.exists():
            self.seeded.update((True,))
            for topic in self.seeds.get(project, ()):
                self.uses.updateValue((topic,), (0,))
        for frame in rows:
            ids, topics, new = [], [], []
            for id_, said in zip(frame["id"], frame["topics"]):
                own, fresh = [], []
                for topic in said if said is not None else ():
                    stored = self._known(topic)
                    if stored is None:
                        stored = topic
                        fresh.append(topic)
                    n = self.uses.getValue((stored,))[0] if stored not in fresh and self.uses.containsKey((stored,)) else 0
                    self.uses.updateValue((stored,), (n + 1,))
                    if stored not in own:
                        own.append(stored)
                ids.append(id_)
                topics.append(own)
                new.append(fresh)
            yield pd.DataFrame({"project": project, "id": ids, "topics": topics, "new_topics": new})

    def close(self) -> None:
        pass


def resolved(items: DataFrame, ttl: timedelta | None = None, seeds: dict[str, list[str]] | None = None) -> DataFrame:
    """ANSWER rows for a stream (or a table) of items: id, project, topics.

    ``seeds`` are a project's topics before the first item, a stated list. Topics are normalised before they meet the vocabulary.
    """
    known = {p: sorted(set(t)) for p, t in (seeds or {}).items()}
    spelt = F.filter(F.transform("topics", normalise_topic), lambda t: t != "")
    rows = items.select(project_key(F.col("project")).alias("project"), F.col("id").cast("string").alias("id"), spelt.alias("topics"))
    return rows.groupBy("project").transformWithStateInPandas(_Vocabulary(ttl, known), outputStructType=ANSWER, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")
