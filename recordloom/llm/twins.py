"""The queries of this folder that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH e AS (SELECT vec_id, {WHOLE} AS v FROM embeddings WHERE {FINITE}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op12(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [
        f"e AS MATERIALIZED (SELECT vec_id, label, {WHOLE} AS v FROM embeddings WHERE {FINITE})",
        f"""p AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x
  FROM e CROSS JOIN (SELECT unnest(range({parts})) AS part) t)""",
        f"""b0 AS MATERIALIZED (
  SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INT AS entry, x AS c FROM p
  QUALIFY entry < {entries})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, x, d[1] AS error, d[2]::INT AS entry FROM (
    SELECT p.vec_id, p.part, any_value(x) AS x, min([
      list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c), entry::DOUBLE]) AS d
    FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part))""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY place) AS c FROM (
      SELECT part, entry, place, floor(sum(y) / count(*)) AS mean
      FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS place FROM a{r}) GROUP BY part, entry, place
    ) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (
  SELECT part, entry, unnest(c) AS z, unnest(range(len(c))) AS place FROM b{rounds})),
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, f.error, (sum(f.error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM f JOIN e USING (vec_id) CROSS JOIN h
"""


TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP13 = f"""
WITH d AS (SELECT doc_id, {TERMS} AS words FROM documents WHERE len({TERMS}) > 0),
s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS all_words FROM d),
p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL
),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
x AS (
  SELECT item_id, doc_id, sum(
    floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_words))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""
