"""Queries of the general problems (2, 5 and 6) with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import hierarchy as H
from marlstone.operators import references as R
from marlstone.operators import timestamps as T
from marlstone.runtime import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return H.part_of_links(table(spark, d, "graph_edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_links(spark, d))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.paths_and_sizes(_links(spark, d))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(_links(spark, d))


def p2_circles(spark: SparkSession, d: str) -> DataFrame:
    return H.on_circles(_links(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "mem_fact_history").select("fact_id", "created_at", "client_tz")
    got = T.normalise_timestamps(facts, key="fact_id", text="created_at", tz="client_tz", source="client_tz")
    return got.select(F.col("key").alias("fact_id"), "created_us").distinct()


def p5_layouts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "mem_fact_history").select("fact_id", "created_at", "client_tz")
    got = T.normalise_timestamps(facts, key="fact_id", text="created_at", tz="client_tz", source="client_tz")
    return got.groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"), F.max("n_readings").alias("most_readings"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """All references to nodes, as (ref_table, ref_key, ref_field, ref_id, t)."""
    ts = table(spark, d, "temporal_state")
    parts = [
        ts.select(F.lit("temporal_state").alias("ref_table"), F.col("qid").alias("ref_key"), F.lit(f).alias("ref_field"), F.explode(f).alias("ref_id"), F.col("created_at").alias("t"))
        for f in ("gold_ids", "stale_ids")
    ]
    req = table(spark, d, "mem_ingest_request").groupBy("request_id").agg(F.min("received_at").alias("t"), F.min_by("replaces", "received_at").alias("replaces"))
    parts.append(req.select(F.lit("mem_ingest_request").alias("ref_table"), F.col("request_id").cast("string").alias("ref_key"), F.lit("replaces").alias("ref_field"), F.explode(R.digit_runs(F.col("replaces"))).alias("ref_id"), "t"))
    return parts[0].union(parts[1]).union(parts[2])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(references(spark, d), table(spark, d, "nodes").select("id", "stored_at", "deleted_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_key", "ref_field", "ref_id", "period").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, d))


_LINKS_SQL = r"""
WITH RECURSIVE named AS (
  SELECT nullif(regexp_replace(replace(regexp_replace(source, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '') AS child,
         nullif(regexp_replace(replace(regexp_replace(target, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '') AS parent
  FROM graph_edges WHERE upper(regexp_replace(relation, '^\s+|\s+$', '', 'g')) = 'PART_OF'),
links AS (SELECT DISTINCT child, parent FROM named WHERE child IS NOT NULL AND parent IS NOT NULL),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
reach AS (SELECT child AS node, parent AS anc FROM links UNION SELECT r.node, l.parent FROM reach r JOIN links l ON l.child = r.anc),
circle AS (SELECT DISTINCT node FROM reach WHERE node = anc),
tree AS (
  SELECT node, node AS root, CAST(0 AS BIGINT) AS depth FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL SELECT node, '', CAST(-1 AS BIGINT) FROM circle
  UNION SELECT l.child, t.root, CASE WHEN t.depth < 0 THEN CAST(-1 AS BIGINT) ELSE t.depth + 1 END
  FROM tree t JOIN links l ON l.parent = t.node WHERE l.child NOT IN (SELECT node FROM circle))
"""

_REFS_SQL = """
WITH req AS (SELECT request_id, min(received_at) AS t, arg_min(replaces, received_at) AS replaces FROM mem_ingest_request GROUP BY request_id),
refs AS (
  SELECT 'temporal_state' AS ref_table, qid AS ref_key, 'gold_ids' AS ref_field, unnest(gold_ids) AS ref_id, created_at AS t FROM temporal_state
  UNION SELECT 'temporal_state', qid, 'stale_ids', unnest(stale_ids), created_at FROM temporal_state
  UNION SELECT 'mem_ingest_request', CAST(request_id AS VARCHAR), 'replaces', TRY_CAST(unnest(regexp_extract_all(translate(replaces, '０１２３４５６７８９', '0123456789'), '[0-9]+')) AS BIGINT), t FROM req),
orphans AS (
  SELECT r.*, strftime(r.t, '%Y-%m') AS period FROM refs r WHERE r.ref_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = r.ref_id AND n.stored_at <= r.t AND (n.deleted_at IS NULL OR n.deleted_at > r.t)))
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_circles, p5_found, p5_layouts, p6_found, p6_report)}
SQL = {
    "p2_found": _LINKS_SQL + "SELECT DISTINCT node, root, depth FROM tree",
    "p2_circles": _LINKS_SQL + "SELECT node FROM circle",
    "p2_paths": _LINKS_SQL
    + """
, ways AS (
  SELECT node, node AS root, CAST(0 AS BIGINT) AS depth, node AS path FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, w.root, w.depth + 1, w.path || ' > ' || l.child FROM ways w JOIN links l ON l.parent = w.node WHERE l.child NOT IN (SELECT node FROM circle)),
best AS (SELECT node, root, depth, min(path) AS path FROM ways GROUP BY ALL UNION ALL SELECT DISTINCT node, root, depth, NULL FROM tree WHERE depth < 0),
below AS (SELECT anc AS node, count(DISTINCT node) AS n FROM reach WHERE anc <> node GROUP BY anc)
SELECT b.node, root, depth, path, coalesce(n, 0) AS n_below FROM best b LEFT JOIN below USING (node)""",
    "p2_descendants": _LINKS_SQL.split("circle AS")[0]
    + """
far AS (SELECT parent AS ancestor, child AS node, CAST(1 AS BIGINT) AS distance FROM links
  UNION SELECT f.ancestor, l.child, f.distance + 1 FROM far f JOIN links l ON l.parent = f.node WHERE f.distance < (SELECT count(*) FROM nodes))
SELECT ancestor, node, min(distance) AS distance FROM far GROUP BY ALL""",
    "p6_found": _REFS_SQL + "SELECT DISTINCT ref_table, ref_key, ref_field, ref_id, period FROM orphans",
    "p6_report": _REFS_SQL
    + """
, why AS (SELECT DISTINCT ref_table, ref_key, ref_field, ref_id, t, period,
  CASE WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.id = o.ref_id AND n.stored_at <= o.t) THEN 'deleted'
       WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.id = o.ref_id) THEN 'late' ELSE 'missing' END AS reason FROM orphans o)
SELECT ref_table, ref_field, period, reason, count(*) AS n_refs, count(DISTINCT ref_id) AS n_ids FROM why GROUP BY ALL""",
}
