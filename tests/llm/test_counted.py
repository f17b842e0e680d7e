"""Token counts, clustering and ranked lexical search, against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recollect.llm import clusters, counts, lexical, registry

# 11 ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_path("word_bpe_49k.json")


def wanted_counts(rows, path):
    t = counts.library(path)
    out = []
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        out.append((i, len((x or "").encode()), n, n > 2048))
    return sorted(out, key=str)


def counted(df, path, **options):
    return sorted(map(tuple, counts.count_tokens(df, path, **options).collect()), key=str)


def test_token_counts(edge, corpus, edge_rows, texts, path):
    assert counted(edge, path) == wanted_counts(edge_rows, path)
    assert counted(corpus, path) == wanted_counts(texts, path)


LETTERS = [*"abcdeABC  \n\t'stremd0123456789.,;-—éßñ中文字😀̣́ \x85\xa0\x1cΣσİÀÉDŽST²½ª가각힣ᅡᆨᄀ", "<|endoftext|>", " the", "'LL", "!!!", "<|start", "oftext|>"]


def hard_texts(n, seed=0):
    r = random.Random(seed)
    kinds = [
        lambda k: "".join(r.choice(LETTERS) for _ in range(k)),
        lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)),
        lambda k: "".join(r.choice("中文字符日本語한국어") for _ in range(k)),
        lambda k: r.choice("a=!-é中") * k,
        lambda k: "".join(r.choice(["!", "'", "re", "<|endoftext|>", "=", "#", "—"]) for _ in range(k)),
        lambda k: "".join(r.choice([c for c in LETTERS if not c.isspace()]) for _ in range(k)),
        lambda k: " " * k + "end" + "́" * k,
    ]
    return [(i, kinds[i % len(kinds)](r.randint(200, 2500))) for i in range(n)]


def test_chunks_are_spliced_exactly(spark, path):
    """Short chunks, so that every text is cut; runs of one sign never align and are widened to the whole."""
    rows = hard_texts(210)
    rows += [*rows[:20], rows[3], (None, rows[1][1]), (None, rows[1][1])]  # copies, rows without id
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(df, path, chunk=256, overlap=128) == wanted_counts(rows, path)


def test_every_common_place_gives_the_same_count(path):
    t = counts.library(path)
    spliced = 0
    for _, text in hard_texts(700, 1):
        pieces = []
        for no, (s, e) in enumerate(ends := counts.cut(text, 256, 128)):
            coded = t.encode(text[s:e], add_special_tokens=False)
            head = dict(counts.places(text[s:e], coded, s, counts.MARGIN, 128 - counts.MARGIN)) if no else {}
            tail = counts.places(text[s:e], coded, s, e - s - 128 + counts.MARGIN, e - s - counts.MARGIN) if no + 1 < len(ends) else []
            pieces.append((head, tail, len(coded.ids)))
        total = sum(n for *_, n in pieces)
        for (_, tail, n), (head, _, _) in zip(pieces, pieces[1:]):
            drops = {n - a + head[p] for p, a in tail if p in head}
            assert len(drops) <= 1
            total -= drops.pop() if drops else math.nan
        if total == total:
            spliced += 1
            assert total == len(t.encode(text, add_special_tokens=False).ids)
    assert spliced > 500


def test_token_counts_of_nothing(empty, path):
    df = counts.count_tokens(empty, path)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and df.count() == 0


def test_other_builds_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        counts.library(registry.tokenizer_path("byte_bpe_50k.json"))


# 12 ----------------------------------------------------------------------------------


def brute_clusters(rows, p):
    """Lloyd's rounds in Python integers."""
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == p.width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(p.scale * float(np.float32(x))) for x in v]))
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{p.seed}:{r[0]}".encode()).hexdigest(), r[1]))[: p.clusters]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(p.rounds + 1):
        best = [min((d2(v, x), j) for j, x in enumerate(c)) for _, v in kept]
        if n < p.rounds:
            for j in range(len(c)):
                if mine := [v for (_, v), (_, k) in zip(kept, best) if k == j]:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, j in best:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, best))


@pytest.mark.parametrize("kind", ["normal", "grid", "large", "few", "one"])
def test_clusters_against_rounds_in_integers(spark, kind):
    r = random.Random(len(kind))
    width = 4
    make = {
        "normal": lambda: [r.gauss(0, 1) for _ in range(width)],
        "grid": lambda: [r.choice((-1.0, 0.0, 1.0)) for _ in range(width)],  # ties and equal vectors
        "large": lambda: [r.gauss(0, 1) * 2.0**18 for _ in range(width)],  # whose squares may leave 64 bits
        "few": lambda: [r.gauss(0, 1) for _ in range(width)],
        "one": lambda: [0.5] * width,
    }[kind]
    rows = [(i, make()) for i in range({"few": 5, "large": 12}.get(kind, 600))]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, make()), (9001, None), (9002, [1.0]), (9003, [math.nan] * width), (9004, [1.0, None, 0.0, 0.0]), (9005, [math.inf] * width)]
    p = clusters.Params(width=width, block=97)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    assert sorted(map(tuple, clusters.cluster(df, p).collect())) == brute_clusters(rows, p)
    assert clusters.cluster(df.limit(0), p).count() == 0


def test_bounds_skip_distances(spark):
    r = np.random.default_rng(0)
    centres = r.normal(0, 1, (8, 16))
    v = (centres[r.integers(0, 8, 4000)] + r.normal(0, 0.1, (4000, 16))).tolist()
    p = clusters.Params(width=16)
    rows = clusters.quantise(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), p)
    _, _, computed = clusters.fit(rows, p)
    assert len(computed) == p.rounds + 1 and computed[0] <= 8 * 4000
    assert sum(computed[4:]) < 0.1 * 8 * 4000 * len(computed[4:])


def test_components_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster(df, clusters.Params(width=4)).collect()


# 13 ----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k=50):
    words = [TERM.findall((t or "").translate(SMALL)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for x in words for w in set(x))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(SMALL)))
    out = []
    for i, wanted in asked.items():
        scores = []
        for (doc, _), x in zip(docs, words):
            tf, m = Counter(x), 50 + (50 * len(x) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in wanted if tf[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(i, n + 1, None if none else doc, -s) for n, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [lexical.Params(), lexical.Params(k=7, block=16, sparse=4, cache_bytes=64, salts=2, group_bytes=700)])
def test_ranks(spark, corpus, edge, edge_rows, texts, data, params):
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    items += [(-1, None), (-2, ""), (-3, "one two ABC Ünï 中文 the THE"), (-3, "zero")]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")
    got = sorted(map(tuple, lexical.rank(corpus, asked, params).collect()), key=str)
    assert got == brute_ranks(texts, items, params.k)
    got = sorted(map(tuple, lexical.rank(edge.repartition(3), asked, params).collect()), key=str)
    assert got == brute_ranks(edge_rows, items, params.k)


def test_ranks_of_nothing(spark, empty, edge):
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.rank(empty, asked).count() == 0
    assert lexical.rank(edge, asked.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_bitmaps_add_and_rank(seed):
    r = random.Random(seed)
    n, k = r.randint(1, 200), r.randint(1, 20)
    columns = [{p: r.randint(1, r.choice((3, 1 << 35))) for p in r.sample(range(n), r.randint(1, n))} for _ in range(6)]
    total = []
    for x in columns:
        raw = (lexical.to_slices(np.array([*x]), np.array([*x.values()]), n) if r.random() < 0.5 else lexical.to_places(np.array([*x]), np.array([*x.values()])))
        total = lexical.add(total, lexical.from_slices(raw, n))
    sums = Counter()
    for x in columns:
        sums.update(x)
    places, found = lexical.read_out(total, lexical.top(total, k), n)
    want = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert dict(zip(places.tolist(), found.tolist())) == dict(want)
