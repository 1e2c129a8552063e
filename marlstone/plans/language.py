"""The query language and the text cutters as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chunks as K
from marlstone.operators import tql
from marlstone.plans.registry import VIEWS, Registry
from marlstone.runtime import table
from marlstone.sources import store as S

R = Registry(VIEWS)


@R.add("SELECT id, hit_count + 1 AS more FROM cur WHERE type = 'memory' AND importance >= 0.5 ORDER BY hit_count DESC, id LIMIT 7 OFFSET 2")
def q1_find(spark: SparkSession, d: str) -> DataFrame:
    return tql.query("FIND {type: $t, importance: {$gte: 0.5}} RETURN id, hit_count + 1 AS more ORDER BY hit_count DESC, id LIMIT 7 OFFSET 2", S.nodes(spark, d), given={"t": "memory"})


@R.add("SELECT count(*) AS n, max(hit_count) AS top FROM cur WHERE type = 'plan' OR type = 'task'")
def q2_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return tql.query('FIND {$or: [{type: "plan"}, {type: "task"}]} RETURN COUNT(*) AS n, MAX(hit_count) AS top', S.nodes(spark, d))


@R.add("SELECT l.src AS a, l.dst AS b FROM flinks l JOIN cur x ON x.id = l.src JOIN cur y ON y.id = l.dst WHERE y.importance > 0.4 AND x.type != 'record'")
def q3_match(spark: SparkSession, d: str) -> DataFrame:
    e = S.fact_links(spark, d).withColumn("label", F.lit("REVISED_BY"))
    return tql.query('MATCH (x)-[:REVISED_BY]->(y) WHERE y.importance > 0.4 AND x.type != "record" RETURN x.id AS a, y.id AS b', S.nodes(spark, d), e)


@R.add(", two AS (SELECT src, dst FROM flinks UNION SELECT p.src, q.dst FROM flinks p JOIN flinks q ON p.dst = q.src) SELECT DISTINCT x.id AS a, y.id AS b FROM two t JOIN cur x ON x.id = t.src JOIN cur y ON y.id = t.dst")
def q4_match_hops(spark: SparkSession, d: str) -> DataFrame:
    e = S.fact_links(spark, d).withColumn("label", F.lit("REVISED_BY"))
    return tql.query("MATCH (x)-[:REVISED_BY*1..2]->(y) RETURN DISTINCT x.id AS a, y.id AS b", S.nodes(spark, d), e)


@R.add("SELECT doc_id, CAST(i AS INTEGER) AS i, substr(text, CAST(i AS INTEGER) * 450 + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 50) / 450.0) - 1) AS INTEGER))) AS i FROM documents WHERE length(text) > 0)")
def k1_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(K.windows(F.col("text"), 500, 50)).alias("i", "piece"))


@R.add(r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*\n\s*'), lambda p: trim(p, ' ')), lambda p: p <> '')) AS n FROM documents""")
def k2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(K.paragraphs(F.col("text"))).cast("bigint").alias("n"))


@R.add()
def k3_merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs joined to chunks of 200 characters or more."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(K.merged(K.paragraphs(F.col("text")), 200)).alias("i", "chunk"))


@R.add(r"SELECT doc_id, regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^#{1,6}[ \t]+([^\n]+?)[ \t]*$', 1) AS headings FROM documents")
def k4_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", K.headings(F.regexp_replace("text", r"\r\n?", "\n")).alias("headings"))


@R.add()
def k5_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(K.sections(F.col("text"))).alias("i", "section"))


QUERIES, SQL = R.queries, R.sql
