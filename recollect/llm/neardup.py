"""Near-duplicates by tensored banding over minhashes, links confirmed on full shingle sets.

Documents with equal sets form a class; only one row per class goes on. A class has two small collections of
SIDE sub-keys, each made of DEPTH minhashes. Table keys are all pairs of a sub-key of the first with one of
the second: SIDE * SIDE tables from 2 * SIDE * DEPTH minhashes. A pair at similarity s shares no table with
probability at most 2 * (1 - s ** DEPTH) ** SIDE, about 2e-5 at 0.85 and under 1e-6 from 0.9 on.

Within a table key no list of all pairs is made. First every member is compared with one hub, the member
that meets most others over all its tables; the links found join into components, which settles groups of
near copies in one comparison per member. A hub's members are dealt to tasks of bounded size, each of which gets the
hub's set once. Only members of one key that are still apart are then compared
with each other, in cells of bounded size, first on their minhashes and then on their sets; a cell yields only
the links that join components. Every comparison is of full sets of 64-bit shingle hashes. The minhash test keeps a pair
with at least AGREE of all minhashes equal; a pair at 0.85 fails it with probability under 1e-6.

Texts are read twice: for the signatures, and for the sets of the classes that meet another in some table, which are
written once and used by both rounds of comparison.

Texts are read whole, lower-cased in A-Z and split at white space. Null or empty texts, and texts of white
space, have no shingles and link with nothing. With fewer words than a shingle has, all words make one.
Repeated rows and repeated ids are rows of one class or of several, as their texts say. An empty table gives
an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, arrow_schema, kept_struct, materialise, named, scratch, unkept
from ..operators.components import components, merged

MEMO_LIMIT = 250_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    percent: int = 85  # link when 100 * intersection >= percent * union
    side: int = 9
    depth: int = 2
    cell: int = 2048  # members of a block; two blocks are compared in one task
    cell_shingles: int = 4_000_000  # shingles of a block
    spokes: int = 4096  # members that one task compares with a hub
    spoke_shingles: int = 4_000_000  # their shingles

    @property
    def hashes(self) -> int:
        return 2 * self.side * self.depth

    @property
    def agree(self) -> int:
        """The least number of equal minhashes: six standard deviations under the mean at the threshold."""
        p = self.percent / 100
        return max(1, int(self.hashes * p - 6 * (self.hashes * p * (1 - p)) ** 0.5))


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


_IDS = _WordIds()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[3]
    x = (x ^ (x >> np.uint64(27))) * _MIX[4]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_IDS.__getitem__, words), np.uint64, n)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = _mixed(h * _MIX[0] + ids[k : n - width + 1 + k] * _MIX[1] + _MIX[2])
    return np.unique(h)


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    words = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX[0])
    return words[:n, None], words[n:, None] | np.uint64(1)


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    add, times = _functions(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        x = (shingles[None, at : at + 8192] ^ add) * times
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=1))
    return low


def _sub_keys(low: np.ndarray, depth: int) -> np.ndarray:
    rows = low.reshape(-1, depth)
    h = np.arange(len(rows), dtype=np.uint64)
    for k in range(depth):
        h = _mixed(h * _MIX[0] + rows[:, k] * _MIX[1])
    return h.view(np.int64)


def class_id(shingles: np.ndarray) -> int:
    """A set's identity: the first 8 bytes of a cryptographic digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_digest(text: str | None) -> bytes:
    """The same in Spark: unhex(md5(text)), of a null text that of an empty one."""
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, class (null without shingles), sub-keys of both sides, 16 bits of every minhash, digest of the text."""
    ddl = "doc_id long, n_shingles long, class long, sub array<long>, low binary, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, p.shingle)
                if len(s):
                    low = minhashes(s, p.hashes)
                    rows.append((doc_id, len(s), class_id(s), _sub_keys(low, p.depth), low.astype("<u2").tobytes(), text_digest(text)))
                else:
                    rows.append((doc_id, 0, None, None, None, text_digest(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(out), out)], schema=out)

    out = arrow_schema(docs.sparkSession, ddl)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def _sets(docs: DataFrame, needed: DataFrame, p: Params) -> DataFrame:
    """class and full set, packed, for the classes in ``needed`` (class, and rep and digest of one of its rows) only."""
    ddl = "class long, packed binary"
    out = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, p.shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], schema=out)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("hash"), text.alias("text"))
    asked = merged(rows, needed.select("class", "rep", "digest"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("digest")))
    return asked.select("class", "text").dropDuplicates(["class"]).mapInArrow(run, ddl)


def _reach(common: np.ndarray, n: np.ndarray, m: int, p: Params) -> np.ndarray:
    return 100 * common >= p.percent * (n + m - common)


def _spokes(t: pa.Table, p: Params) -> pa.Table:
    """The members of a group that link with their hub, the row whose ``class`` is the hub."""
    ids, hub = t["class"].to_numpy(), t["hub"][0].as_py()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["packed"]]
    own = sets[int(np.flatnonzero(ids == hub)[0])]
    rest = [k for k in range(len(ids)) if ids[k] != hub]
    linked = []
    for k in rest:
        at = np.searchsorted(own, sets[k])
        common = np.count_nonzero(own[np.minimum(at, len(own) - 1)] == sets[k])
        if _reach(common, len(sets[k]), len(own), p):
            linked.append(ids[k])
    b = np.array(linked, np.int64)
    return pa.table({"a": np.minimum(b, hub), "b": np.maximum(b, hub)})


def _star_links(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (class, hub) whose sets reach the threshold; pairs whose sizes rule it out move no set."""
    both = merged(merged(pairs, sizes, "class"), sizes.withColumnsRenamed({"class": "hub", "n_shingles": "hub_shingles"}), "hub")
    near = materialise(both.where(100 * F.least("n_shingles", "hub_shingles") >= p.percent * F.greatest("n_shingles", "hub_shingles")), "near")
    load = near.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("members") / F.lit(p.spokes)), F.ceil(F.col("shingles") / F.lit(p.spoke_shingles))).cast("int")
    dealt = load.select("hub", parts.alias("parts"))
    members = merged(near, dealt, "hub").select("hub", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), "class")
    hubs = dealt.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("class"))
    rows = merged(members.unionByName(hubs), sets, "class")
    return rows.groupBy("hub", "part").applyInArrow(lambda t: _spokes(t, p), "a long, b long")


def _joined(t: pa.Table, p: Params) -> pa.Table:
    """Links between the components of one cell: a spanning forest of its pairs at or over the threshold."""
    ids, root, n, part = (t[c].to_numpy().copy() for c in ("class", "root", "n_shingles", "part"))
    low = np.frombuffer(b"".join(t["low"].to_pylist()), "<u2").reshape(len(t), p.hashes)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["packed"]]
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    marked = np.zeros(int(token.max()) + 1, bool)
    found_a, found_b = [], []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        fit = (root[rest] != root[i]) & (100 * np.minimum(n[rest], n[i]) >= p.percent * np.maximum(n[rest], n[i]))
        fit &= (part[rest] == 0) & (part[i] == 0) | (part[rest] + part[i] == 3)
        at = np.flatnonzero(fit) + i + 1
        if not len(at):
            continue
        agree = (low[at] == low[i]).sum(axis=1)
        at = at[agree >= p.agree][np.argsort(-agree[agree >= p.agree], kind="stable")]
        own = token[ends[i] - len(sets[i]) : ends[i]]
        marked[own] = True
        while len(at):
            some, at = at[:64], at[64:]
            pieces = [token[ends[j] - len(sets[j]) : ends[j]] for j in some]
            starts = np.cumsum([0, *(len(x) for x in pieces[:-1])])
            common = np.add.reduceat(marked[np.concatenate(pieces)].astype(np.int64), starts)
            for j in some[_reach(common, n[some], n[i], p)].tolist():
                if root[j] != root[i]:
                    found_a.append(ids[i])
                    found_b.append(ids[j])
                    root[root == root[j]] = root[i]
            at = at[root[at] != root[i]]
        marked[own] = False
    a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _apart(rooted: DataFrame, classes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links that join components which still meet in a table key.

    ``rooted``: key, class, root. Whoever meets another component in any key is compared, on full sets, within
    the cells of the first side's sub-keys (a pair that shares a table shares one of them). A cell yields a
    spanning forest, never its pairs. A cell of too many members or shingles is split into blocks, and every
    pair of blocks makes a cell, so a task never holds more than two blocks.
    """
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    open_classes = materialise(merged(rooted, mixed, "key").groupBy("class").agg(F.min("root").alias("root")), "open")
    about = merged(classes, open_classes, "class")
    cells = about.select(
        "class", "root", "n_shingles", F.explode(F.transform(F.sequence(F.lit(0), F.lit(p.side - 1)), lambda i: F.xxhash64(F.get("sub", i), i))).alias("key")
    )
    sizes = cells.groupBy("key").agg(
        F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")
    ).where("r1 <> r2")
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(p.cell)), F.ceil(F.col("shingles") / F.lit(p.cell_shingles))).cast("int")
    rows = merged(cells, sizes.select("key", blocks.alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when((F.col("blocks") == 1) | (F.col("block") == F.col("other")), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), part.cast("long").alias("part"), "class", "root", "n_shingles")
    whole = merged(rows, merged(about.select("class", "low"), sets, "class"), "class")
    return whole.groupBy("cell").applyInArrow(lambda t: _joined(t, p), "a long, b long").distinct()


def _labelled(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, class, digest, and root: the component's smallest class (null without shingles)."""
    signed = materialise(signatures(docs, p), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))  # the row whose text stands for the class
    classes = signed.where("class IS NOT NULL").groupBy("class").agg(
        one["doc_id"].alias("rep"), one["digest"].alias("digest"), F.min("n_shingles").alias("n_shingles"), F.any_value("sub").alias("sub"), F.min("low").alias("low")
    )
    classes = materialise(classes, "classes")

    side = p.side
    tables = F.transform(
        F.sequence(F.lit(0), F.lit(side * side - 1)),
        lambda t: F.xxhash64(F.get("sub", F.floor(t / side).cast("int")), F.get("sub", t % side + side), t),
    )
    keys = classes.select("class", F.explode(tables).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(merged(keys, shared, "key"), "members")

    met = materialise(members.groupBy("class").agg(F.sum("n").alias("met")), "met")
    hubs = merged(members, met, "class").groupBy("key").agg(F.max(F.struct("met", "class"))["class"].alias("hub"))
    starred = materialise(merged(members, hubs, "key").select("key", "class", "hub"), "starred")
    sets = materialise(_sets(docs, merged(classes, met, "class", "left_semi"), p), "sets")
    pairs = starred.where("class <> hub").select("class", "hub").distinct()
    links = materialise(_star_links(pairs, classes.select("class", "n_shingles"), sets, p), "links")

    roots = components(links).withColumnRenamed("node", "class")
    rooted = merged(starred.select("key", "class"), roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    more = materialise(_apart(rooted, classes, sets, p), "apart")
    roots = components(links.unionByName(more)).withColumnRenamed("node", "class")
    rows = merged(signed.select("doc_id", "n_shingles", "class", "digest"), roots, "class", "left")
    return rows.withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept, one row per input row."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(_labelled(docs, params or Params()), "labelled")
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = merged(rows, least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The input's rows, one of each component: that with the smallest id (rows without id last), then the smallest digest of text.

    Texts without words are components by themselves, one for each id and text. Two rows that share an id but no component
    both stay. Of rows with equal id and text the one with the smallest hash over all columns stays.
    """
    with scratch(docs.sparkSession) as keep:
        rows = materialise(_labelled(docs, params or Params()), "labelled")
        own = F.coalesce(F.col("root").cast("string"), F.concat_ws(":", F.lit("none"), F.col("doc_id").cast("string"), F.hex("digest")))
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
        first = rows.groupBy(own.alias("own")).agg(F.min(order).alias("x")).select("x.doc_id", "x.digest")
        copies = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
        chosen = merged(first, copies, first["doc_id"].eqNullSafe(copies["doc_id"]) & (first["digest"] == copies["digest"])).select(
            first["doc_id"].alias("chosen_id"), first["digest"].alias("chosen_digest"), "copies"
        )
        chosen = keep(chosen, "chosen")
    every = kept_struct(docs, docs.columns)
    wide = docs.select(every.alias("kept_columns"), named("doc_id").cast("long").alias("id"),
                       F.unhex(F.md5(F.coalesce(named("text").cast("string"), F.lit("")).cast("binary"))).alias("digest"), F.xxhash64(every).alias("h"))
    wide = merged(wide, chosen, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("digest") == F.col("chosen_digest")))
    many = wide.where("copies > 1").groupBy("id", "digest").agg(F.min_by("kept_columns", "h").alias("kept_columns"))
    return wide.where("copies = 1").select("kept_columns").unionByName(many.select("kept_columns")).select(*unkept(docs))
