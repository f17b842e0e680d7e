"""DuckDB statements for the rows of the queries."""

from __future__ import annotations

from . import quality

_WORDS = r"list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '')"


def quality_rules() -> str:
    words = ", ".join(f"'{w}'" for w in dict.fromkeys([*quality.STOP_WORDS, *(x.capitalize() for x in quality.STOP_WORDS)]))
    passes = []
    for r in quality.RULES:
        unit = r.per or "1"
        if r.least is not None:
            passes.append(f"{r.measure} >= {r.least} * {unit}")
        if r.most is not None:
            passes.append(f"{r.measure} <= {r.most} * {unit}")
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
    wins AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
             FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM wins) WHERE n > 1),
    cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(ws, lambda x: x IN ({words}))) AS n_stop_words,
                 coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS line_chars,
                 coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(ls), lambda x: length(x))), 0) AS dup_line_chars,
                 len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}]'))) AS n_bullet_lines,
                 len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\r]*\z'))) AS n_ellipsis_lines
          FROM w LEFT JOIN cov USING (rid)),
    f AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {" AND ".join(passes)} AS kept FROM f
    """


def chat_formatting() -> str:
    """The contract's columns; formatted_chars follows from the template: every example holds all turns up to its own."""
    return r"""
    WITH c AS (SELECT conv_id, turn, role, text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
               UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS i,
                 count(*) OVER (PARTITION BY conv_id) AS n,
                 14 + length(r) + length(regexp_replace(r, '[^\\<#:]', '', 'g')) + length(x) + length(regexp_replace(x, '[^\\<#]', '', 'g')) AS f FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
           coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
           sum(f * k)::BIGINT AS formatted_chars
    FROM (SELECT *, count(*) FILTER (r = 'assistant' OR i = n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM n)
    GROUP BY conv_id
    """



def near_duplicates() -> str:
    """All pairs that share a shingle, counted exactly, then components by a recursive walk."""
    return r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM d),
    e AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM s),
    p AS (SELECT x.rid AS a, y.rid AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i
          FROM e x JOIN e y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL),
    l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
    both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    walk AS (SELECT rid AS a, rid AS b FROM s UNION SELECT w.a, x.b FROM walk w JOIN both_ways x ON w.b = x.a),
    c AS (SELECT w.a AS rid, min(s.doc_id) AS component_id FROM walk w JOIN s ON s.rid = w.b GROUP BY 1)
    SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c USING (rid)
    """


def top_k() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """


def clustering() -> str:
    """Ten rounds of assignment and floors of means, one statement a round."""
    d2 = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = [
        """e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v FROM e QUALIFY j < 8)",
    ]
    for n in range(11):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT e.rid, e.vec_id, e.v, min((({d2}), c.j)) AS best FROM e, c{n} c GROUP BY ALL)")
        if n < 10:
            ctes.append(f"s{n} AS (SELECT best[2] AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) r(i) GROUP BY ALL)")
            floors = "list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY i)"
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT j, {floors} AS v FROM s{n} GROUP BY j) m USING (j))")
    return f"""
    WITH {", ".join(ctes)}
    SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
           sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
    FROM a10 JOIN c10 ON c10.j = best[2]
    """


def lexical() -> str:
    """Scores of all documents that share a term with an item, ranked."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents WHERE text IS NOT NULL),
    g AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
    q AS (SELECT DISTINCT item_id, unnest({words}) AS t FROM benchmark),
    p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, n_docs),
    s AS (SELECT item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * n_docs) // n_terms))))::BIGINT AS score
          FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (rid), g GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (rid) WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
    """
