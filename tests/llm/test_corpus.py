"""Operators over whole tables, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import eliasfano, lm, neardup, packing, registry, topk
from recollect.operators import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# 4 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_path():
    return registry.tokenizer_path("word_bpe_49k.json")


def test_word_tokens_equal_the_library(word_path, edge_rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_path)
    r, own = random.Random(0), packing.word_tokenizer(word_path)
    letters = [*"abcdeABC  \n\t'stremd0123456789.,;-—éßñ中文字😀́ \x85\xa0\x1cΣσİÀÉDŽST²½ª", "<|endoftext|>", " the", "'LL"]
    every = [x or "" for _, x in [*edge_rows, *texts]] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for text in every:
        assert np.frombuffer(own.packed(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(edge, edge_rows, word_path):
    own = packing.word_tokenizer(word_path)
    rows = packing.pack(edge, word_path).collect()
    wanted = Counter((i, len(ids) // 4, zlib.crc32(ids)) for i, t in edge_rows for ids in [own.packed(t or "") + (1).to_bytes(4, "little")])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for (doc, total), pieces in by_doc.items():
        copies = sum(n for (i, m, _), n in wanted.items() if (i, m) == (doc, total))
        starts = sorted(pieces)
        assert len(starts) == copies * -(-total // packing.WINDOW)
        whole = b"".join(dict(starts)[s] for s in sorted(dict(starts)))
        assert (doc, total, zlib.crc32(whole)) in wanted
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_best_fit_is_tight():
    r = random.Random(1)
    lengths = sorted((r.randint(1, 700) for _ in range(5000)), reverse=True)
    where, _ = packing.best_fit(lengths)
    assert max(where) + 1 <= math.ceil(sum(lengths) / packing.WINDOW) + 1


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest(seed):
    r = random.Random(seed)
    lengths = sorted((r.randint(1, 30) for _ in range(200)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fit:
            room = min(fit)[0]
            i = next(i for i in range(len(rooms)) if rooms[i] == room)
        else:
            i = len(rooms)
            rooms.append(32)
        rooms[i] -= n
        want.append(rooms[i])
    where, offsets = packing.best_fit(lengths, 32)
    assert [32 - o - n for o, n in zip(offsets, lengths)] == want and max(where) + 1 == len(rooms)


def test_packing_empty(empty, word_path):
    assert packing.packing_rows(empty, word_path).count() == 0


# 6 -----------------------------------------------------------------------------------


def brute_top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("spread, chunk", [(0.0, 64_000_000), (3.0, 100)])
def test_top_k(spark, spread, chunk):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) * math.exp(spread * r.random()) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, list(rows[i % 3][1])) for i in range(60)] + [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (704, [0.0] * 8), (750, [2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    small = topk.Params(lane=100, bucket=16, block=5, chunk_bytes=chunk, lane_bytes=20 * chunk)
    assert {tuple(x) for x in topk.top_k(df, small).collect()} == brute_top(rows)


def test_bounds_leave_products_out(spark, data):
    """On the corpus's vectors, all of one length and far apart, coordinates rule out products; on lengths apart lanes are not met."""
    from pyspark.sql import functions as F

    wide = data.replace("sf0.001", "sf0.1")
    vectors = spark.read.parquet(f"{wide}/embeddings.parquet")
    p = topk.Params(lane=512, bucket=128, block=16)
    met = topk.meetings(vectors, p).agg(F.sum("skipped")).first()[0]
    assert met > 0.5 * 40 * vectors.count()
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) / (1 + i) for _ in range(4)]) for i in range(1, 2000)] + [(0, [1.0, 1.0, 1.0, 1.0])]
    some = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lanes = topk.meetings(some, topk.Params(lane=50, block=1000, every=5000)).groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(x.n <= 3 * 5 for x in lanes)  # of forty lanes


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (0, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 3, 256 * 512)]
    assert topk.top_k(df.limit(0)).count() == 0


# 7 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    for universe in (1, 7, 1000, 1 << 40, 1 << 63):
        n = int(r.integers(0, 200))
        values = np.sort(r.integers(0, universe, n).astype(np.uint64))
        ef = eliasfano.EliasFano.build(values, universe)
        assert (ef.get(np.arange(n)) == values).all()
        asked = np.concatenate([r.integers(0, universe, 100).astype(np.uint64), values, values + np.uint64(1)])
        at, hit = ef.successor(asked)
        assert (at == np.searchsorted(values, asked)).all() and (hit == np.isin(asked, values)).all()


def test_trie_survives_its_bytes(tmp_path):
    words = np.array([5, 9, 1 << 60], np.uint64)
    made = eliasfano.BigramTrie.build(words, np.array([3, 1, 2]), np.array([0, 0, 2]), np.array([4, 8, 4], np.uint64), np.array([0.5, 1.0, 2.0]), np.array([-1.0, -2.0, -4.5]))
    (tmp_path / "trie").write_bytes(made.to_bytes())
    for t in (eliasfano.BigramTrie.open(str(tmp_path / "trie")), eliasfano.BigramTrie.mapped(made.to_bytes())):
        number, count = t.word(np.array([9, 6, 1 << 60], np.uint64))
        assert number.tolist() == [1, -1, 2] and count.tolist() == [1, 0, 2]
        assert t.gain(np.array([0, 0, 1, -1, 2]), np.array([8, 5, 4, 4, 4], np.uint64)).tolist() == [256, 0, 0, 0, 512]
        assert (t.alone / t.FINE).tolist() == [1.0, 2.0, 4.5]


def brute_lm(rows, p):
    docs = [(i, SPACE.findall((t or "").translate(LOWER)) + [" end"]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c, pairs = Counter(), Counter()
    for i, w in docs:
        if not held(i):
            c.update(w)
            pairs.update(zip([" start", *w], w))
    n, v = sum(c.values()), len(c)
    total = n + 0.1 * (v + 1)
    out = []
    for i, w in docs:
        base = sum(math.log10((c[x] + 0.1) / total) for x in w)
        model = sum(math.log10((pairs[a, x] + p.mu * (c[x] + 0.1) / total) / ((c[" end"] if a == " start" else c[a]) + p.mu)) for a, x in zip([" start", *w], w))
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, base, model))
    return out


def test_lm_scores(edge, corpus, edge_rows, texts):
    p = lm.Params(tokens_per_shard=3000, tokens_per_batch=20000)
    for df, rows in ((edge, edge_rows), (corpus, texts)):
        want = sorted(brute_lm(rows, p), key=lambda x: (str(x[0]), x[5]))
        got = sorted(map(tuple, lm.score(df, p).collect()), key=lambda x: (str(x[0]), x[5]))
        assert [x[:5] for x in got] == [x[:5] for x in want]
        for g, w in zip(got, want):
            assert g[5] == pytest.approx(w[5], abs=1e-6) and abs(g[6] - w[6]) <= w[2] / eliasfano.BigramTrie.STEPS
    held = [x for x in got if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)  # contexts help on texts the model has not seen


def test_lm_with_one_pair_in_a_third_of_the_tokens(spark, monkeypatch):
    """No shard holds more than twice its share, whatever one pair weighs."""
    r = random.Random(8)
    rows = [(i, " ".join("hot pair" if r.random() < 0.35 else f"w{r.randint(0, 3000)}" for _ in range(200))) for i in range(300)]
    p = lm.Params(tokens_per_shard=4000, tokens_per_batch=8000)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    n = lm.score(df, p).first().train_tokens
    c = Counter(int(w) for _, t in rows for w in lm.token_ids(t))
    hot = np.array(sorted(w for w, k in c.items() if k > p.tokens_per_shard // lm.HOT), np.uint64)
    shards = -(-n // p.tokens_per_shard)
    held = Counter()
    for b in lm._blobs(df, hot, shards, p).collect():
        held[b.shard] += len(b.contexts) // 5
    assert max(held.values()) <= 2 * p.tokens_per_shard
    want, got = sorted(brute_lm(rows, p)), sorted(map(tuple, lm.score(df, p).collect()))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(g[6] - w[6]) <= w[2] / eliasfano.BigramTrie.STEPS for g, w in zip(got, want))


def test_lm_tells_texts_that_occur_twice(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randint(0, 20_000)}" for _ in range(100))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = {i for i in range(20) if not lm.held_out(i) or not lm.held_out(1000 + i)}
    assert all((x.n_again > 0.9 * x.n_tokens) == (i % 1000 in twice and not (lm.held_out(1000 + i % 1000 if i < 1000 else i - 1000))) for i, x in got.items() if not x.held_out)


def test_lm_empty(empty):
    assert lm.score(empty).count() == 0


def test_lm_without_training(spark):
    only = next(i for i in range(100) if lm.held_out(i))
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


# 9 -----------------------------------------------------------------------------------


def brute_near(rows, size=3, percent=85):
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return Counter((i, len(s), least.get(find(n)), i == least.get(find(n))) for n, ((i, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates(edge, corpus, edge_rows, texts):
    for df, rows in ((edge, edge_rows), (corpus, texts)):
        assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == brute_near(rows)


def test_families_of_copies(spark):
    """Copies of copies, whose ends do not link, and a text that shares a passage; small cells are split into blocks."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for family in range(4):
        text = [r.choice(words) for _ in range(80)]
        for _ in range(25):
            text = list(text)
            for _ in range(r.randint(1, 3)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, " ".join([*(r.choice(words) for _ in range(20)), *passage])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_near(rows)
    assert len({c for _, _, c, _ in want}) > 8
    assert Counter(map(tuple, neardup.near_duplicates(df, neardup.Params(cell=8)).collect())) == want
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == want
    assert Counter(map(tuple, neardup.near_duplicates(df, neardup.Params(spokes=3)).collect())) == want


def test_shingles_alike_in_their_low_bits(spark, monkeypatch):
    """Sets whose 64-bit hashes agree in the low 32 bits are told apart, and no link beside them is lost."""
    whole = neardup.shingle_set

    def clashing(text, size):
        s = whole(text, size)
        return np.unique((s & np.uint64(0xFFFFFFFF00000000)) | np.uint64(7))

    r = random.Random(9)
    sets = [clashing(" ".join(r.choice("abcdefgh") for _ in range(60)), 3) for _ in range(12)]
    sets += [np.union1d(x[:-1], x[:1] + np.uint64(1 << 32)) for x in sets[:6]]
    p = neardup.Params(cell=4)
    rows = [(n, n, len(s), 0, np.zeros(p.hashes, "<u2").tobytes(), s.tobytes()) for n, s in enumerate(sets)]
    t = pa.Table.from_pylist([dict(zip(("class", "root", "n_shingles", "part", "low", "packed"), x)) for x in rows])
    got = {tuple(x.values()) for x in neardup._joined(t, p).to_pylist()}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) for i in [len(np.intersect1d(sets[a], sets[b]))] if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i)}
    parts = lambda links: {frozenset(c) for c in closure(links, len(sets))}
    assert want and got <= want and parts(got) == parts(want)


def closure(links, n):
    group = {i: {i} for i in range(n)}
    for a, b in links:
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    return group.values()


def test_near_duplicates_send_no_table_through_the_driver(spark, monkeypatch):
    """An exploded table counts as small as what it was made of, so a limit on broadcasts does not hold it."""
    plans = []

    def noting(df, name, write=components.materialise):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    for module in (neardup, components):
        monkeypatch.setattr(module, "materialise", noting)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        text = " ".join(f"w{n}" for n in range(60))
        df = spark.createDataFrame([(n, f"{text} {n // 2}") for n in range(12)], "doc_id long, text string")
        left = [neardup.near_duplicates(df), neardup.one_of_each(df)]
        plans += [("result", x._jdf.queryExecution().executedPlan().toString()) for x in left]
        assert left[0].where("kept").count() == left[1].count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {"members", "starred", "near", "links", "apart", "hooks"} <= {n for n, _ in plans}
    assert [n for n, plan in plans if "BroadcastExchange" in plan] == []


def test_near_duplicates_empty(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_one_of_each(edge, edge_rows):
    got = neardup.one_of_each(edge)
    assert got.columns == edge.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[5] == 1 and ids[7] == 0 and ids[1] == 1 and ids[None] == 1


def test_one_of_each_with_repeated_and_missing_ids(spark):
    r = random.Random(6)
    a, b, c = (" ".join(r.choice(["x", "y", "z", "u", "v"]) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "p"), (1, b, "q"), (2, b, "r"), (None, c, "s"), (None, c + " tail", "t"), (3, a, "u"), (1, a, "v"), (4, "", "w"), (4, "", "w"), (5, None, "x"), (None, None, "y")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string"))
    found = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert found == sorted([(1, a), (1, b), (4, ""), (5, None), (None, None), (None, min(c, c + " tail", key=neardup.text_digest))], key=str)
    assert got.columns == ["doc_id", "text", "a.b"]


# pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, data, texts, word_path):
    import corpus_pipeline
    from test_rows import measures, personal

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "packing"]
    from recollect.llm import quality

    stops = {*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}
    good = []
    for i, t in texts:
        n, chars, symbols, dup, rep = measures(t)
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        common = sum(w in stops for w in SPACE.findall(t))
        line_chars, once = sum(map(len, lines)), sum(map(len, set(lines)))
        bullets, dots = sum(bool(re.match(r"[ \t]*[-*\u2022]", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|\u2026)[ \t\r]*\Z", x)) for x in lines)
        shape = 2 * dup <= len(lines) and 2 * (line_chars - once) <= line_chars and bullets <= 0.9 * len(lines) and dots <= 0.3 * len(lines)
        if n >= 50 and 2 * rep <= n and chars <= 25 * n and 4 * symbols <= n and common >= 0.08 * n and shape:
            good.append((i, t))
    kept = {i for (i, _, c, k) in brute_near(good, 5, 80) if k}
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, data)
        seen.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen[0]) == {i for i, _ in good} and set(seen[1]) == kept and set(seen[2]) == kept
    assert not any(sum(personal(t)[:4]) for t in seen[2].values())
    clean = {i for i, t in good if i in kept and not sum(personal(t)[:4])}
    assert sum(seen[2][i] == dict(good)[i] for i in clean) >= len(clean) - 3  # the method's own kinds aside
    own = packing.word_tokenizer(word_path)
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == kept
    for i, rows in pieces.items():
        whole = own.packed(seen[2][i]) + (1).to_bytes(4, "little")
        assert sum(r.length for r in rows) == rows[0].doc_tokens == len(whole) // 4
        assert all(zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in rows)
        assert b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start)) == whole


def test_pipeline_on_hard_rows(spark, edge, empty):
    import corpus_pipeline

    text = "the cat and the dog went to the river of gold with a mail to x@y.org and a list of " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text + " it was more of the same", "b"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, "", "f"), (5, "the of and " * 40_000, "g"), (6, text.replace("w", "v"), "h"), (6, text.replace("w", "v"), "h")]
    dotted = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    for docs in (edge, empty, dotted, dotted.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs, before = stage(spark, docs, ""), docs
            assert docs.columns == before.columns, name
        packed = corpus_pipeline.pack(spark, docs, "").collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    left = dotted
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, "")
    assert sorted((r.doc_id, r["a.b"]) for r in left.collect()) == [(1, min((neardup.text_digest(t), x) for _, t, x in rows[:2])[1]), (6, "h")]
    assert all("<EMAIL>" in r.text and "@" not in r.text for r in left.collect())


def test_packing_with_clashing_columns(spark, edge, word_path):
    from pyspark.sql import functions as F

    names = ("ids", "start", "length", "sequence_id", "offset", "n_tokens", "task", "a.b")
    clash = edge.withColumns({c: F.lit("clash") for c in names})
    key = lambda df: sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(packing.pack(clash, word_path)) == key(packing.pack(edge, word_path))
