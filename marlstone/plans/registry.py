"""A list of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self, prelude: str = ""):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.prelude = prelude

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = self.prelude + sql
            return f

        return put


#: The views of sources.store in SQL.
VIEWS = r"""
WITH RECURSIVE cur AS (
  SELECT id, payload.type AS type, payload.label AS label, coalesce(payload.content, '') AS content, coalesce(TRY_CAST(trim(payload.importance) AS DOUBLE), 0.5) AS importance,
    coalesce(nullif(lower(trim(payload.status)), ''), 'active') AS status, payload.status AS raw_status, payload.domain AS raw_domain,
    lower(trim(coalesce(nullif(trim(payload.domain), ''), nullif(payload.character_name, ''), 'general'))) AS domain,
    payload.created_at AS created_at, payload.source AS source, payload.source_path AS source_path, payload.title AS title, payload.chunk_index AS chunk_index,
    payload.valid_at AS valid_at, payload.invalid_at AS invalid_at, payload.expired_at AS expired_at, payload.linked_from AS linked_from,
    coalesce(payload.hit_count, 0) AS hit_count, payload.meta AS meta, payload.character_name AS character_name, stored_at
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stored_at DESC) AS n FROM nodes WHERE deleted_at IS NULL) WHERE n = 1),
raw_ed AS (
  SELECT nullif(regexp_replace(replace(regexp_replace(source, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '') AS src,
         nullif(regexp_replace(replace(regexp_replace(target, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '') AS dst,
         upper(trim(relation)) AS label, coalesce(weight, 1.0) AS weight FROM graph_edges),
ed AS (SELECT src, dst, label, max(weight) AS weight FROM raw_ed WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL),
hub AS (SELECT src AS p FROM ed GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 1),
req AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY received_at) AS n FROM mem_ingest_request) WHERE n = 1),
flinks AS (SELECT DISTINCT src, dst FROM (SELECT node_id AS src, unnest(superseded) AS dst FROM mem_fact_history) WHERE src <> dst),
ch AS (SELECT * FROM (SELECT node_id, chunk_idx, arg_max(struct_pack(chunk_text, vector, dim, model), updated_at) AS v FROM node_chunks GROUP BY ALL)),
vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
"""
