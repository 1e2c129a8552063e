"""Queries of the problems tagged llm with production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import leaks as L
from marlstone.llm import mixing as M
from marlstone.llm import neardup as N
from marlstone.llm import reading as R
from marlstone.llm import split as S
from marlstone.llm import vectors as V
from marlstone.runtime import cut, ensure_checkpoint_dir, table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """The current chunks' vectors, and the lists fitted on a sample of the raw rows."""
    raw = table(spark, d, "node_chunks").select("node_id", "chunk_idx", "vector", "dim", "model", "updated_at")
    key = (F.col("node_id").alias("id_a"), F.col("chunk_idx").cast("bigint").alias("id_b"))
    index = V.build_index(raw.select(*key, "model", "vector", "dim"))
    return V.latest_chunks(raw, "vector", "dim", "model").select(*key, "model", "vector", "dim"), index


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    vectors, index = _vectors(spark, d)
    return V.similar_pairs(vectors, k=10, least=0.90, index=index).select("node_a", F.col("chunk_a").cast("int").alias("chunk_a"), "node_b", F.col("chunk_b").cast("int").alias("chunk_b"))


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar chunks of every chunk of the nodes whose id is divisible by 100, among all chunks."""
    vectors, index = _vectors(spark, d)
    got = V.most_similar(vectors, k=10, queries=F.col("id_a") % 100 == 0, probes=16, index=index)
    return got.select(F.col("q_a").alias("node_id"), F.col("q_b").cast("int").alias("chunk_idx"), "rank", F.col("d_a").alias("near_node"), F.col("d_b").cast("int").alias("near_chunk"), F.round("cosine", 5).alias("cosine"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the lists lose of p1_similar, against all rows in blocks."""
    vectors, index = _vectors(spark, d)
    asked = F.col("id_a") % 100 == 0
    return V.recall(V.most_similar(vectors, k=10, queries=asked, probes=16, index=index), V.exact_similar(vectors, k=10, queries=asked))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Each request once; deliveries of one request have one content."""
    return table(spark, d, "mem_ingest_request").select(F.col("request_id").alias("id"), F.col("content").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = N.similar_pairs(_requests(spark, d), q=5, least=0.7, min_chars=80)
    return pairs.select(F.col("id_a").alias("request_a"), F.col("id_b").alias("request_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return N.groups(_requests(spark, d), q=5, least=0.7, min_chars=80).withColumnRenamed("id", "request_id")


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    """Current chunks and requests as (src, item_id, part_id, text); texts within the limit travel as nulls, since only the newest row of a key counts."""
    long = F.when(F.char_length("text") > 1_500, F.col("text")).alias("text")
    chunks = V.latest_chunks(table(spark, d, "node_chunks").select("node_id", "chunk_idx", F.col("chunk_text").alias("text"), "updated_at").withColumn("text", long), "text")
    requests = table(spark, d, "mem_ingest_request").select("request_id", F.col("content").alias("text"), "received_at").withColumn("text", long)
    first = requests.groupBy("request_id").agg(F.min_by(F.struct("text"), "received_at").alias("v"))
    a = chunks.select(F.lit("node_chunks").alias("src"), F.col("node_id").alias("item_id"), F.col("chunk_idx").cast("bigint").alias("part_id"), "text")
    b = first.select(F.lit("mem_ingest_request").alias("src"), F.col("request_id").alias("item_id"), F.lit(-1).cast("bigint").alias("part_id"), F.col("v.text").alias("text"))
    return a.union(b).where("text is not null")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    got = S.pieces(_oversized(spark, d), most=1_500, overlap=100)
    return got.select("src", "item_id", F.col("part_id").cast("int").alias("chunk_idx"), "piece_no", "start", "stop", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = S.pieces(_oversized(spark, d), most=1_500, overlap=100, number=False)
    return got.select("src", "item_id", F.col("part_id").cast("int").alias("chunk_idx")).distinct()


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """The items put together again from their pieces, and whether lengths and overlaps keep to the limits."""
    keys = ["src", "item_id", "part_id"]
    got = S.reassembled(S.pieces(_oversized(spark, d), most=1_500, overlap=100), keys)
    return got.select("src", "item_id", F.col("part_id").cast("int").alias("chunk_idx"), F.md5("text").alias("hash"), (F.col("longest") <= 1_500).alias("short"), (F.col("most_repeated") <= 100).alias("near"), (F.col("n_pieces") > 1).alias("cut"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a few large files in the shared folder, cut by byte ranges: do the pieces keep to the limits and cover every byte?"""
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("text").where("text is not null").coalesce(4).write.text(folder)
    got = S.file_pieces(spark, folder, most=1_500, overlap=100, length=1 << 18)
    w = Window.partitionBy("src", F.floor(F.col("start") / (1 << 22))).orderBy("piece_no")  # neighbours within four megabytes
    p = got.withColumn("new", F.col("stop") - F.greatest("start", F.coalesce(F.lag("stop").over(w), F.lit(0))))
    whole = got.groupBy("src").agg(F.max("stop").alias("size"), F.max("piece_no").alias("last"), F.count(F.lit(1)).alias("n"))
    steps = p.agg(F.max(F.octet_length("text")).alias("longest"), F.min("new").alias("least"))
    return whole.agg(F.sum("size").alias("bytes"), F.bool_and(F.col("n") == F.col("last") + 1).alias("numbered")).join(steps).select("bytes", "numbered", (F.col("longest") <= 1_500).alias("short"), (F.col("least") > 0).alias("onward"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return L.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "passage"), n=5, run=20)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose alignment is worth 20 words, of which then 20 in a row must be shared."""
    return _leaks(spark, d).where("score * n_words >= 20 - 1e-6").where("longest_run >= 20").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("longest_run >= 20 or score >= 0.5").withColumn("score", F.round("score", 6))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    tokens = cut(M.token_counts(table(spark, d, "documents").select("doc_id", "source", "text")))
    return M.mix(tokens, targets), tokens, targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.reached(*_mix(spark, d))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Do the selections keep to caps, repetitions and shares?"""
    return M.kept(*_mix(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return R.reading_levels(table(spark, d, "documents").select("doc_id", "text", "lang"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("grade > 13").select("doc_id")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("grade").isNull(), "none").when(F.col("grade") <= 5, "primary").when(F.col("grade") <= 8, "middle").when(F.col("grade") <= 13, "high").otherwise("college")
    return p9_levels(spark, d).groupBy("lang", level.alias("level")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_similar, p1_recall, p3_found, p3_groups, p4_found, p4_pieces, p4_checks, p4_files, p7_found, p7_leaks, p8_mix, p8_shares, p8_kept, p9_found, p9_levels, p9_profile)}
SQL = {
    # against all pairs of a model's usable vectors
    "p1_found": """
WITH cur AS (SELECT node_id, chunk_idx, arg_max(struct_pack(vector, dim, model), updated_at) AS v FROM node_chunks GROUP BY ALL),
ok AS (SELECT node_id AS n, chunk_idx AS c, v.model AS m, CAST(v.vector AS DOUBLE[]) AS x FROM cur WHERE len(v.vector) = v.dim AND len(list_filter(v.vector, lambda z: z <> 0)) > 0),
near AS (SELECT a.n AS an, a.c AS ac, b.n AS bn, b.c AS bc, list_cosine_similarity(a.x, b.x) AS s FROM ok a JOIN ok b ON a.m = b.m AND len(a.x) = len(b.x) AND (a.n, a.c) <> (b.n, b.c)),
best AS (SELECT * FROM near WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY an, ac ORDER BY s DESC, bn, bc) <= 10)
SELECT DISTINCT CASE WHEN (an, ac) < (bn, bc) THEN an ELSE bn END AS node_a, CASE WHEN (an, ac) < (bn, bc) THEN ac ELSE bc END AS chunk_a,
  CASE WHEN (an, ac) < (bn, bc) THEN bn ELSE an END AS node_b, CASE WHEN (an, ac) < (bn, bc) THEN bc ELSE ac END AS chunk_b FROM best""",
    # against the sets of all pairs that share a substring
    "p3_found": """
WITH t AS (SELECT request_id, trim(regexp_replace(lower(content), '[\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM (SELECT DISTINCT request_id, content FROM mem_ingest_request)),
g AS (SELECT DISTINCT request_id, unnest(list_transform(generate_series(1, length(t) - 4), lambda i: substr(t, i, 5))) AS g FROM t WHERE length(t) >= 80),
n AS (SELECT request_id, count(*) AS n FROM g GROUP BY 1),
hit AS (SELECT a.request_id AS request_a, b.request_id AS request_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.request_id < b.request_id GROUP BY ALL)
SELECT request_a, request_b FROM hit JOIN n x ON x.request_id = request_a JOIN n y ON y.request_id = request_b WHERE k >= 0.7 * (x.n + y.n - k)""",
    # against all runs of 20 words
    "p7_found": """
WITH w AS (SELECT 'd' AS src, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'i', item_id, passage FROM eval_items),
s AS (SELECT src, id, regexp_extract_all(regexp_replace(lower(t), '(\\p{Han})', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w FROM w WHERE t IS NOT NULL),
runs AS (SELECT DISTINCT src, id, unnest(list_transform(generate_series(1, len(w) - 19), lambda i: array_to_string(w[i:i + 19], ' '))) AS r FROM s WHERE len(w) >= 20)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.r = i.r AND d.src = 'd' AND i.src = 'i'""",
    "p8_kept": """
WITH t AS (SELECT mix_name, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, sum(target_share) AS share FROM mix_targets WHERE mix_name IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY ALL),
have AS (SELECT DISTINCT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source FROM documents WHERE text <> '')
SELECT mix_name, t.source, round(CASE WHEN h.source IS NULL THEN 0 ELSE share / sum(CASE WHEN h.source IS NOT NULL THEN share END) OVER (PARTITION BY mix_name) END, 6) AS share_asked, true AS capped, true AS once, true AS near
FROM t LEFT JOIN have h USING (source)""",
    "p4_checks": """
SELECT src, item_id, chunk_idx, md5(t) AS hash, true AS short, true AS near, true AS cut FROM (
  SELECT 'node_chunks' AS src, node_id AS item_id, chunk_idx, arg_max(chunk_text, updated_at) AS t FROM node_chunks GROUP BY ALL
  UNION ALL SELECT DISTINCT 'mem_ingest_request', request_id, -1, content FROM mem_ingest_request) WHERE length(t) > 1500""",
    "p4_files": "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS numbered, true AS short, true AS onward FROM documents",
    "p4_found": """
SELECT 'node_chunks' AS src, node_id AS item_id, chunk_idx FROM (
  SELECT node_id, chunk_idx, arg_max(chunk_text, updated_at) AS t FROM node_chunks GROUP BY ALL) WHERE length(t) > 1500
UNION ALL SELECT DISTINCT 'mem_ingest_request', request_id, -1 FROM mem_ingest_request WHERE length(content) > 1500""",
}
