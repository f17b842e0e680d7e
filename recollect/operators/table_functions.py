"""The searches as SQL table functions of a session.

``register(spark, view)`` defines, over a view of memories:

* ``match_thoughts(query, threshold, k, project, type, topic, created_by, include_archived)``
* ``hybrid_match_thoughts(query, words, k, threshold, project, type, topic, created_by, include_archived, rrf_k, candidate_pool)``
* ``match_thoughts_by_source(file_hash, k, include_archived)``

and the scalar functions they are made of: ``thought_similarity``, ``web_query`` (words and phrases of a query), ``text_hit`` and ``text_rank``. All are SQL, so
Spark puts their bodies in place of the calls: filters reach the scan, and a rank held to a constant is an ordered limit.
They may stand in a LATERAL join, where each row of the left side asks its own query.

Semantics are those of ``operators.search``, with the leg of plain words: stems need Python and are left to the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SCOPE = """
    ({f}.include_archived OR archived = false) AND ({f}.project IS NULL OR t.project = {f}.project) AND ({f}.type IS NULL OR t.type = {f}.type)
    AND ({f}.topic IS NULL OR array_contains(topics, {f}.topic)) AND ({f}.created_by IS NULL OR t.created_by = {f}.created_by)"""
_SCOPED = "project STRING DEFAULT NULL, type STRING DEFAULT NULL, topic STRING DEFAULT NULL, created_by STRING DEFAULT NULL, include_archived BOOLEAN DEFAULT false"
_GROUPS = "ARRAY<ARRAY<STRUCT<words: ARRAY<STRING>, negated: BOOLEAN>>>"



def _tokens(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '([\\p{{L}}\\p{{N}}]+)', 1)"


def _places(words: str) -> str:
    """Where the words stand one after the other. Bodies of functions may not call functions of SQL inside a lambda, hence text."""
    return f"filter(transform(lexemes, (x, i) -> CASE WHEN x = {words}[0] AND slice(lexemes, i + 1, size({words})) = {words} THEN i END), p -> p IS NOT NULL)"


_NO_TERMS = "CAST(array() AS ARRAY<STRUCT<words: ARRAY<STRING>, negated: BOOLEAN>>)"
#: The last place of each wanted term, once x is seen, and where a cover that ends there starts.
_LAST = "transform(acc.last, (v, i) -> CASE WHEN i = x.t THEN x.p ELSE v END)"
_START = f"array_min({_LAST})"

_SCALARS = (
    """thought_similarity(a ARRAY<FLOAT>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
    CASE WHEN aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate(b, 0D, (s, x) -> s + x * x) > 0 THEN
        aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)
        / (sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END""",
    # an OR of groups of words and quoted phrases; a quote that is never closed ends with the query
    rf"""web_query(query STRING) RETURNS {_GROUPS} RETURN
    filter(aggregate(regexp_extract_all(query, '(-?(?:"[^"]*"?|[^\\s"]+))', 1), array({_NO_TERMS}),
        (acc, x) -> CASE WHEN lower(x) = 'or' THEN concat(acc, array({_NO_TERMS})) WHEN size({_tokens("x")}) = 0 THEN acc
            ELSE concat(slice(acc, 1, size(acc) - 1), array(array_append(element_at(acc, -1), struct({_tokens("x")} AS words, startswith(x, '-') AS negated)))) END),
        g -> size(g) > 0)""",
    f"""text_hit(lexemes ARRAY<STRING>, query {_GROUPS}) RETURNS BOOLEAN RETURN
    exists(query, g -> forall(g, t -> CASE WHEN size(t.words) = 1 THEN array_contains(lexemes, t.words[0]) ELSE size({_places("t.words")}) > 0 END <> t.negated))""",
    f"""text_rank(lexemes ARRAY<STRING>, query {_GROUPS}) RETURNS DOUBLE RETURN
    aggregate(transform(query, g -> filter(g, t -> NOT t.negated)), 0D, (total, g) -> total + CASE WHEN size(g) = 0 THEN 0D ELSE
        aggregate(array_sort(flatten(transform(g, (t, n) -> transform({_places("t.words")}, p -> struct(p AS p, n AS t, size(t.words) AS w))))),
            struct(array_repeat(-1, size(g)) AS last, -1 AS start, 0D AS sum),
            (acc, x) -> struct({_LAST} AS last, greatest(acc.start, {_START}) AS start,
                acc.sum + CASE WHEN {_START} > acc.start THEN 0.1D / (1 + greatest(x.p + x.w - {_START} - aggregate(g, 0, (s, t) -> s + size(t.words)), 0)) ELSE 0D END AS sum),
            acc -> acc.sum) END)""",
)


def _tables(view: str) -> tuple[str, ...]:
    near = """SELECT id, content, similarity, created_at FROM (
        SELECT id, content, created_at, {sim} AS similarity FROM {view} t WHERE embedding IS NOT NULL AND {scope}) WHERE similarity >= {f}.threshold AND NOT isnan(similarity)"""

    def scope(f: str) -> str:
        return _SCOPE.format(f=f)

    def leg(f: str) -> str:
        return near.format(sim=f"thought_similarity(embedding, {f}.query)", view=view, scope=scope(f), f=f)

    return (
        f"""match_thoughts(query ARRAY<DOUBLE>, threshold DOUBLE DEFAULT 0.5D, k INT DEFAULT 10, {_SCOPED})
        RETURNS TABLE(id STRING, content STRING, similarity DOUBLE, created_at TIMESTAMP) RETURN
        SELECT id, content, similarity, created_at FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM ({leg('match_thoughts')})) WHERE n <= match_thoughts.k""",
        f"""hybrid_match_thoughts(query ARRAY<DOUBLE>, words STRING, k INT DEFAULT 10, threshold DOUBLE DEFAULT 0.5D, {_SCOPED}, rrf_k INT DEFAULT 60, candidate_pool INT DEFAULT 50)
        RETURNS TABLE(id STRING, content STRING, similarity DOUBLE, text_rank DOUBLE, score DOUBLE, matched_by STRING, created_at TIMESTAMP) RETURN
        WITH near AS (SELECT id, similarity, n FROM (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM ({leg('hybrid_match_thoughts')}))
                      WHERE n <= hybrid_match_thoughts.candidate_pool),
        lexed AS (SELECT id, {_tokens('content')} AS w FROM {view} t WHERE {scope('hybrid_match_thoughts')}),
        hits AS (SELECT id, text_rank(w, web_query(hybrid_match_thoughts.words)) AS r FROM lexed WHERE text_hit(w, web_query(hybrid_match_thoughts.words))),
        said AS (SELECT id, r, n FROM (SELECT id, r, row_number() OVER (ORDER BY r DESC, id) AS n FROM hits) WHERE n <= hybrid_match_thoughts.candidate_pool),
        fused AS (SELECT coalesce(near.id, said.id) AS id, similarity, r AS text_rank,
                         coalesce(1D / (hybrid_match_thoughts.rrf_k + near.n), 0D) + coalesce(1D / (hybrid_match_thoughts.rrf_k + said.n), 0D) AS score,
                         CASE WHEN near.n IS NOT NULL AND said.n IS NOT NULL THEN 'both' WHEN near.n IS NOT NULL THEN 'semantic' ELSE 'text' END AS matched_by
                  FROM near FULL JOIN said ON near.id = said.id)
        SELECT id, content, similarity, text_rank, score, matched_by, created_at FROM (
            SELECT /*+ BROADCAST(f) */ t.id, content, similarity, text_rank, score, matched_by, created_at, row_number() OVER (ORDER BY score DESC, created_at DESC, t.id) AS n
            FROM {view} t JOIN fused f ON t.id = f.id) WHERE n <= hybrid_match_thoughts.k""",
        f"""match_thoughts_by_source(file_hash STRING, k INT DEFAULT 25, include_archived BOOLEAN DEFAULT false)
        RETURNS TABLE(id STRING, content STRING, source_file_hash STRING, code_hash STRING, created_at TIMESTAMP) RETURN
        SELECT id, content, source_file_hash, code_hash, created_at FROM (
            SELECT t.*, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM {view} t
            WHERE source_file_hash = match_thoughts_by_source.file_hash AND (match_thoughts_by_source.include_archived OR archived = false)) WHERE n <= match_thoughts_by_source.k""",
    )


def register(spark: SparkSession, view: str) -> None:
    """Define the functions over ``view`` (a temporary view or a table) for this session."""
    for body in (*_SCALARS, *_tables(view)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
