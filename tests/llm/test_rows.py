"""Operators that work row by row, against brute force over the corpus and the edge rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from recollect.llm import bpe, chat, licences, pii, quality, registry, secretscan

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def expected(rows, f):
    return sorted(((i, *f(t or "")) for i, t in rows), key=str)


# 1 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_rows(edge, corpus, edge_rows, texts, byte_tokenizer):
    def want(t):
        ids = byte_tokenizer.encode(t, add_special_tokens=False).ids
        return len(ids), sha(",".join(map(str, ids))), sha(byte_tokenizer.decode(ids, skip_special_tokens=False))

    path = registry.tokenizer_path("byte_bpe_50k.json")
    assert by_id(bpe.bpe_rows(edge, path)) == expected(edge_rows, want)
    assert by_id(bpe.bpe_rows(corpus, path)) == expected(texts, want)


def test_bpe_on_random_texts(byte_tokenizer):
    codec, r = bpe.codec(registry.tokenizer_path("byte_bpe_50k.json")), random.Random(0)
    letters = [*"abcdeABC  \n\t'stremd0123456789.,;-—éßñ中文字😀́ \x85\xa0\x1c\x00", "<|endoftext|>", " the", "ing"]
    for n in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 50))) if n % 50 else "".join(r.choice("ab=") for _ in range(3000))
        ids = byte_tokenizer.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_empty(empty):
    assert bpe.encode(empty, registry.tokenizer_path("byte_bpe_50k.json")).count() == 0


# 2 -----------------------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)


def secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    counts = [sum(k == n for _, k, _ in out) for n in range(3)]
    return *counts, ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_rows(spark, edge, corpus, edge_rows, texts):
    for df, rows in ((edge, edge_rows), (corpus, texts)):
        got = secretscan.secret_rows(df).collect()
        assert len(got) == len(rows)
        want = Counter((i, *secrets(t or "")) for i, t in rows)
        base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in secretscan.BASE)
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, base(r.spans)) for r in got) == want
        assert all(sha(base(r.spans)) == r.base_sha256 for r in got)


def token(r, letters, n):
    return "".join(r.choice(letters) for _ in range(n))


HEXES, KEYS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def ordinary(r, n=200):
    words = ["the", "of", "station", "ing", "tion", "re", "market", "gold", "decade", "facade"]
    return ["-".join(r.choice(words) for _ in range(5)) + str(r.randint(1, 9)) for _ in range(n)] + [token(r, "0123456789", 16) for _ in range(n // 10)]


def test_formats_are_learnt():
    r = random.Random(3)
    values = {"hex": [token(r, HEXES, 40) for _ in range(200)], "access": ["AKIA" + token(r, KEYS, 16) for _ in range(200)]}
    f = secretscan.Formats(values, secretscan.pair_counts(ordinary(r, 2000)))
    # the prefix trees have thousands of states; what is left is the format's length, and AKIA one symbol after the other
    assert 41 <= len(f.formats["hex"].edge) <= 50 and 21 <= len(f.formats["access"].edge) <= 30
    assert [list(f.formats["access"].edge[0])] == [["A"]]
    held = [("hex", token(r, HEXES, 40)) for _ in range(100)] + [("access", "AKIA" + token(r, KEYS, 16)) for _ in range(100)]
    assert sum((f.best(v) or (None,))[0] == k for k, v in held) >= 195
    assert sum(f.best(v) is not None for v in ordinary(r, 300)) == 0
    for n in (16, 20, 23, 32, 39, 41, 64):  # the likelihood decides, not the length
        assert sum((f.best(token(r, HEXES, n)) or (None,))[0] == "hex" for _ in range(100)) >= 95


def test_a_loop_is_learnt():
    """Values of any length over two letters in turn: a few states, with edges back."""
    r = random.Random(4)
    a = secretscan.Automaton(["ab" * min(60, int(r.expovariate(0.1)) + 1) for _ in range(400)])
    assert len(a.edge) <= 12 and a.score("ab" * 30) > a.score("ba" * 30) + 20


def test_held_out_labels(data):
    """Half of the corpus's labelled values fit the automata; the other half, its labels gone, and all other tokens are scored."""
    import duckdb
    import numpy as np

    texts = duckdb.sql(f"SELECT doc_id, text FROM '{data.replace('sf0.001', 'sf0.1')}/documents.parquet'").fetchall()

    values, pairs, plain = {}, np.zeros(secretscan._SIDE**2, np.int64), set()
    for _, t in texts:
        spans = secretscan.base_spans(t or "")
        for _, k, _, v in spans:
            values.setdefault(secretscan.BASE[k], set()).add(v)
        plain |= {x for _, _, x in secretscan.candidates(t or "", spans)}
    pairs += secretscan.pair_counts(sorted(plain))
    fit = {k: sorted(v)[::2] for k, v in values.items()}
    f = secretscan.Formats(fit, pairs)
    rest = [v for k, vs in values.items() for v in sorted(vs)[1::2] if v not in fit[k]]
    caught, false = sum(f.best(v) is not None for v in rest), sum(f.best(v) is not None for v in plain)
    assert rest and caught >= 0.95 * len(rest) and false <= 0.05 * len(rest)


def test_long_values_do_not_fit():
    assert secretscan.Formats({}, secretscan.pair_counts([])).best("a" * 100_000) is None


def test_added_span(spark):
    r = random.Random(4)
    plain = ordinary(r, 70)
    rows = [(i, f"password={token(r, HEXES, 20)} and {plain[i]} too") for i in range(60)]
    rows += [(99, f"it was {token(r, HEXES, 20)} all along"), (100, "nothing of interest happened in station-number-12"), (101, "token=" + "xy1" * 5000)]
    got = {r.doc_id: r.spans for r in secretscan.secret_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "like_assign:7:27" and got[100] == "" and got[5].startswith("assign:0:") and got[101] == "assign:0:15006"


# 3 -----------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(t):
    w = WORD.findall(t.translate(LOWER))
    out = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    out.sort()
    return len(w), len(out), out[0][0] if out else None, out[-1][0] if out else None, ",".join(sorted({x for _, x in out}))


def test_license_rows(edge, corpus, edge_rows, texts):
    for df, rows in ((edge, edge_rows), (corpus, texts)):
        got = licences.license_rows(df).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter((i, *phrases(t or "")) for i, t in rows)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}),
        ("GNU Affero General Public License v3", {"agpl-3.0"}),
        ("Apache License, Version 2.0 and the MIT license", {"apache-2.0", "mit"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("the licensed driver had a free license to go", set()),
    ],
)
def test_license_rules(text, want):
    assert {x for _, _, x, _ in licences.scan_text(text)[2]} == want


def test_there_are_hundreds_of_rules():
    assert len({r.pattern for r in licences.rules()}) > 300


# 8 -----------------------------------------------------------------------------------


def measures(t):
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rows(edge, corpus, edge_rows, texts):
    for df, rows in ((edge, edge_rows), (corpus, texts)):
        got = quality.quality_rows(df).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter((i, *measures(t or "")) for i, t in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_windows_that_share_a_key(spark):
    """With one key for all windows every neighbour clashes, so the windows themselves are sorted."""
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(n, " ".join(r.choice("abcd") for _ in range(n))) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same = quality._repeat_words(quality._words(F.col("text")), lambda x: F.xxhash64(x) * 0)
    assert dict(df.select("doc_id", same).collect()) == {n: measures(t)[4] for n, t in rows}


def test_quality_plan_has_no_python(corpus):
    plan = quality.quality_rows(corpus)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_quality_keeps_columns(edge):
    assert quality.keep_good(edge).columns == edge.columns and quality.keep_good(edge.limit(0)).count() == 0


# 10 ----------------------------------------------------------------------------------


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    out = [(m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]
    return *[sum(x[3] == k for x in out) for k, _, _ in kinds], ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TRICKY = ["x a@b.c_d@e.f y a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1", "+++1 2 3 4 5 6 7 8 9", "9" * 5000 + "@b.c", "a." * 3000 + "@" + "b." * 3000 + "c", "0001.002.03.4"]


def test_pii_rows(spark, edge, corpus, edge_rows, texts):
    tricky = list(enumerate(TRICKY, 1000))
    for df, rows in ((edge, edge_rows), (corpus, texts), (spark.createDataFrame(tricky, "doc_id long, text string"), tricky)):
        got = pii.pii_rows(df).collect()
        base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in pii.BASE_KINDS)
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, base(r.spans)) for r in got) == Counter((i, *personal(t or "")) for i, t in rows)
        assert all(sha(base(r.spans)) == r.base_sha256 for r in got)


def test_pii_adds_checked_kinds(spark):
    t = "iban DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01; ssn 123-45-6789"
    got = pii.pii_rows(spark.createDataFrame([(1, t), (2, "code 123-45-6789 alone")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.split(":")[0] for x in got[0].spans.split(",")] == ["iban", "ssn"] and got[1].spans == ""


def test_context_moves_scores(spark):
    one = "DE89 3704 0044 0532 0130 00"
    rows = [(1, f"iban {one}"), (2, one), (3, f"order {one}"), (4, "device 00:1A:2b:3C:4d:5E"), (5, "00:1A:2b:3C:4d:5E"), (6, "order a@b.org"), (7, "passport C01234567"), (8, "C01234567")]
    got = {r.doc_id: (r.n_spans, r.score) for r in pii.pii_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0.75), 2: (1, 0.55), 3: (0, 0.0), 4: (1, 0.65), 5: (0, 0.0), 6: (1, 0.7), 7: (1, 0.55), 8: (0, 0.0)}


def test_context_is_whole_words_by_position(spark):
    rows = [
        (1, "the relationship 10.0.0.1"), (2, "hosts 10.0.0.1"), (3, "hotel localLY +1 212 555 0100"), (4, "social security 123-45-6789, 123-45-6780"),
        (5, "123-45-6789, 123-45-6780 are ssns"), (6, "ssn" + " " * 38 + "123-45-6789"), (7, "ssn" + " " * 37 + "123-45-6789"), (8, "10.0.0.1 repay 10.0.0.2 IP"), (9, "reorders C01234567 passports"),
    ]
    got = {r.doc_id: (r.n_spans, r.score) for r in pii.pii_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0.7), 2: (1, 0.9), 3: (1, 0.6), 4: (2, 0.7), 5: (2, 0.7), 6: (0, 0.0), 7: (1, 0.7), 8: (2, 0.9), 9: (1, 0.55)}


def all_personal(t):
    """Spans and scores of all kinds: patterns by the regex module, windows cut out of the text."""
    import regex

    found = []
    for order, k in enumerate(pii.KINDS):
        for m in regex.finditer(k.pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k.name == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif k.name == "card":
                twice = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(digits))]
                ok = 12 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0
            elif k.name == "phone":
                ok = 9 <= len(digits) <= 15
            elif k.name == "iban":
                x = m[0].replace(" ", "")
                ok = 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
            elif k.name == "ssn":
                ok = not re.search("^(?:000|666|9)|-00-|0000$", m[0])
            else:
                ok = True
            if ok:
                near = f"{t[max(0, m.start() - 40) : m.start()]} {t[m.end() : m.end() + 40]}".lower()
                said = lambda words: regex.search(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?:e?s)?(?![\p{{L}}\p{{N}}])", near) is not None
                score = round(k.score + k.bonus * said(k.context) - k.malus * said(k.counter), 3)
                if score >= pii.THRESHOLD:
                    found.append((m.start(), order, m.end(), k.name, score))
    return sorted(found)


@pytest.mark.parametrize("seed", range(2))
def test_all_kinds_and_scores_against_brute_force(spark, seed):
    r = random.Random(seed)
    said = ["iban", "hosts", "order", "invoices", "ssn", "social security", "the", "relationship", "ip", "passport", "device", "card", "pay", "é", "中", ",", "\n", "", " ", "a b", "serial", "tel"]
    data = ["10.0.0.1", "300.1.1.1", "a@b.org", "u.v@x-y.co.uk", "4111 1111 1111 1111", "4111 1111 1111 1112", "12", "+1 (212) 555-0100", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01",
            "123-45-6789", "000-45-6789", "00:1A:2b:3C:4d:5E", "C01234567", "7", "1-2"]
    texts_ = [(n, "".join(r.choice(data if r.random() < 0.4 else said) + r.choice([" ", " ", "", ", "]) for _ in range(r.randint(1, 60)))) for n in range(150)]
    df = spark.createDataFrame(texts_, "doc_id long, text string")
    got = {row.i: [tuple(x) for x in row.spans] for row in pii.find(df).selectExpr("kept_columns.c0 AS i", "spans").collect()}
    assert got == {n: all_personal(t) for n, t in texts_}


def test_base_kinds_clear_the_threshold_in_any_context():
    assert all(k.score - k.malus >= pii.THRESHOLD for k in pii.KINDS if k.name in pii.BASE_KINDS)


def test_many_matches_in_one_text(spark):
    r = random.Random(5)
    pieces = [r.choice([f"u{n}@x{n}.org", f"+1 (212) 555-{n % 10000:04}", f"10.0.{n % 300}.7", "é plain 😀", f"DE89 3704 0044 0532 0130 00 x{n}@y.de"]) for n in range(30_000)]
    text = " ".join(pieces)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.pii_rows(df).first()
    assert tuple(got)[1:5] == personal(text)[:4] and got.base_sha256 == sha(personal(text)[4])
    want, at = "", 0
    for kind, start, end in (x.split(":") for x in got.spans.split(",")):
        if int(start) >= at:
            want += text[at : int(start)] + f"<{kind.upper()}>"
        at = max(at, int(end))
    assert pii.redact(df).first().text == want + text[at:]


def test_names_with_dots(spark):
    rows = [(1, "mail a@b.org " + "the of and " * 30, "x", "y", 5)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "kept_columns", "c0"])
    assert pii.redact(df).columns == df.columns and quality.keep_good(df).columns == df.columns
    assert pii.redact(df).first()["a.b"] == "x" and pii.redact(df).first().c0 == 5


def test_empty_tables(empty):
    for rows in (secretscan.secret_rows, licences.license_rows, pii.pii_rows, pii.redact, quality.quality_rows):
        assert rows(empty).count() == 0


def test_redaction(spark, edge):
    got = {r.doc_id: r for r in pii.redact(edge.where("doc_id IN (1, 2, 12)")).collect()}
    assert got[1].text is None and got[2].text == "" and got[12].n_chars == len(got[12].text)
    assert got[12].text == "mail <EMAIL>, ip <IP> or 300.1.1.1, card <CARD>, <PHONE>, <IBAN>"
    assert pii.redact(edge).schema == edge.schema


NOTICES = {
    "GPL v2": "gpl-2.0", "gnu gpl version 2 or later": "gpl-2.0", "gnu gpl v3": "gpl-3.0", "GNU LGPL v2.1": "lgpl-2.1", "MPL 2.0": "mpl-2.0", "BSD-3-Clause License": "bsd-3-clause",
    "Apache-2.0": "apache-2.0", "under Apache-2.0.": "apache-2.0", "Creative Commons Attribution 4.0": "cc-by", "CC Attribution-ShareAlike 4.0": "cc-by-sa", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "mit apache-2.0",
    "spdx-license-identifier: gpl-2.0-or-later with classpath-exception-2.0 and more": "gpl-2.0 classpath-exception", "spdx-license-identifier: isc text mit": "isc", "EPL 2.0, LGPLv3": "epl-2.0 lgpl-3.0",
    "sample-2 gplx 2 temple 2.0 ample mpl vim apache-2.0.1": "",
}


def test_notices_as_they_are_written(spark):
    found = lambda t: [x for _, _, x, _ in licences.scan_text(t)[2]]
    for text, labels in NOTICES.items():
        assert list(dict.fromkeys(found(text))) == labels.split(), text
    gpl = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
    as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
    You should have received a copy of the GNU General Public License along with this program."""
    assert found(gpl) == ["gpl-2.0"]
    assert found("gnu gpl" + " x" * 300 + " gpl v2") == ["gpl", "gpl-2.0"]  # too far apart for one notice
    got = licences.license_rows(spark.createDataFrame([(1, "x GPL v2, MPL 2.0")], "doc_id long, text string")).first()
    assert got.spans == "gpl-2.0:2:8,mpl-2.0:10:17" and got.labels == "gpl-2.0,mpl-2.0"


# 5 -----------------------------------------------------------------------------------


def test_chat_round_trip(spark, data):
    raw = [
        (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "### x </turn>\n\\l"), (1, 3, "user", "more"), (1, 4, "assistant", "yes: <b>"),
        (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (4, None, None, "first"), (None, 0, "a:b#\\", "odd role"),
    ]
    df = spark.createDataFrame(raw, "conv_id long, turn long, role string, text string")
    turns = {}
    for c, n, role, text in raw + [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]:
        turns.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.expand(chat.with_probe(df))).collect()}
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in ts))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
    examples = chat.expand(df).where("conv_id = 1").orderBy("example").collect()
    assert len(examples) == 2
    assert examples[1].text.startswith(examples[0].text) and examples[0].text[examples[0].loss_start :][: examples[0].loss_chars] == "\\h\\h\\h x \\l/turn>\n\\bl"
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_chat_with_long_texts_a_hot_conversation_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, n, "assistant" if n % 2 else "user", f"turn {n} # \\ <") for n in range(300)] + [(2, 0, "user", "x" * 200_000), (2, 1, "assistant", "é\n" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("clash") for c in ("example", "loss_start", "loss_chars", "n_turns", "p", "lines", "loss_sha256", "a.b")})
    got = {r.conv_id: r for r in chat.read_back(chat.expand(clash)).collect()}
    for c in (1, 2):
        mine = [(r, t) for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(mine), len(loss), sha(loss))
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in mine))
