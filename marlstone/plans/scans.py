"""Scans, filters, aggregates, windows, sorts and set operations over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators.ranking import global_place
from marlstone.plans.registry import VIEWS, Registry
from marlstone.runtime import table
from marlstone.sources import store as S

R = Registry(VIEWS)
#: The instant that stands for now in all queries (2026-09-21 14:13:20 UTC).
NOW = 1_790_000_000.0


@R.add("SELECT id, type, importance, status, domain, strlen(content) AS bytes FROM cur")
def s1_payloads(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", "type", "importance", "status", "domain", F.octet_length("content").alias("bytes").cast("bigint"))


@R.add("SELECT n.node_id, n.chunks, coalesce(c.type, '') AS type FROM (SELECT node_id, count(*) AS chunks FROM ch GROUP BY 1) n JOIN cur c ON c.id = n.node_id")
def s2_nodes_with_counts(spark: SparkSession, d: str) -> DataFrame:
    n = S.chunks(spark, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"))
    return n.join(S.nodes(spark, d).select(F.col("id").alias("node_id"), F.coalesce("type", F.lit("")).alias("type")), "node_id")


@R.add("SELECT id, type, label, content FROM cur WHERE id = 1003")
def s3_get_node(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where("id = 1003").select("id", "type", "label", "content")


@R.add("SELECT id FROM cur")
def s4_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id")


@R.add("SELECT * FROM ed WHERE src = (SELECT p FROM hub)")
def s5_edges_out(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    return S.edges(spark, d).where(F.col("src") == start)


@R.add("SELECT * FROM ed WHERE dst = 'index/home.md'")
def s5_edges_in(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).where("dst = 'index/home.md'")


@R.add("SELECT id FROM cur ORDER BY id DESC LIMIT 20")
def s6_recent_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id").orderBy(F.desc("id")).limit(20)


@R.add("SELECT coalesce(nullif(type, ''), 'unknown') AS type, count(*) AS n FROM cur GROUP BY 1")
def s7_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT id, importance, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM cur) AS pages FROM cur ORDER BY importance DESC, id LIMIT 50 OFFSET 50")
def s8_export_page(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d)
    pages = n.agg(F.ceil(F.count(F.lit(1)) / 50).cast("bigint").alias("pages"))
    return n.select("id", "importance").orderBy(F.desc("importance"), "id").offset(50).limit(50).join(F.broadcast(pages))


@R.add("SELECT type, count(*) AS n, list(id ORDER BY id)[1:5] AS first_ids FROM cur WHERE type IN ('memory', 'decision', 'task') GROUP BY type")
def s9_summary(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d).where(F.col("type").isin("memory", "decision", "task"))
    first = n.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where("r <= 5").groupBy("type").agg(F.sort_array(F.collect_list("id")).alias("first_ids"))
    return n.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(first, "type")


@R.add("SELECT substr(sha256(string_agg(id || ':' || sha256(content), ',' ORDER BY id)), 1, 16) AS fingerprint, count(*) AS node_total FROM cur WHERE type = 'decision'")
def s16_pack_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A pack's name: one hash over its nodes' hashes in order (a pack is one row of interchange)."""
    n = S.nodes(spark, d).where("type = 'decision'").select("id", F.concat("id", F.lit(":"), F.sha2("content", 256)).alias("h"))
    return n.agg(F.substring(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda x: x["h"])), 256), 1, 16).alias("fingerprint"), F.count(F.lit(1)).alias("node_total"))


@R.add("""
, pack AS (SELECT id, type, content FROM cur WHERE type = 'plan'), base AS (SELECT max(id) AS top FROM cur)
SELECT p.id AS pack_id, b.top + row_number() OVER (ORDER BY p.id) AS id,
  CASE WHEN trim(p.content) = '' THEN 'empty_content' WHEN regexp_matches(p.content, 'sk-[A-Za-z0-9]{16,}') THEN 'secret' ELSE 'ok' END AS issue FROM pack p, base b""")
def s18_import_ids(spark: SparkSession, d: str) -> DataFrame:
    """New ids for imported nodes after the largest there is, with each node's issue."""
    n = S.nodes(spark, d)
    issue = F.when(F.trim("content") == "", "empty_content").when(F.col("content").rlike("sk-[A-Za-z0-9]{16,}"), "secret").otherwise("ok")
    pack = global_place(n.where("type = 'plan'").select("id", "content"), "id")
    return pack.join(F.broadcast(n.agg(F.max("id").alias("top")))).select(F.col("id").alias("pack_id"), (F.col("top") + F.col("place")).alias("id"), issue.alias("issue"))


@R.add("SELECT id, list_sort(list_distinct(list_concat(map_keys(coalesce(meta, MAP {})), ['reviewed']))) AS keys FROM cur")
def s22_merge_meta(spark: SparkSession, d: str) -> DataFrame:
    old = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    merged = E.merge_maps(old, F.create_map(F.lit("reviewed"), F.lit("yes")))
    return S.nodes(spark, d).select("id", F.sort_array(F.map_keys(merged)).alias("keys"))


@R.add("SELECT (SELECT count(*) FROM ed WHERE src NOT LIKE 'tasks/%' AND dst NOT LIKE 'tasks/%') AS edges_left, (SELECT count(*) FROM cur WHERE coalesce(source_path, '') NOT LIKE 'tasks/%') AS nodes_left")
def s24_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left when all pages under tasks/ go, with their edges."""
    e, n = S.edges(spark, d), S.nodes(spark, d)
    gone = e.select(F.col("src").alias("p")).union(e.select("dst")).distinct().where("p like 'tasks/%'")
    left = e.join(gone, e["src"] == gone["p"], "left_anti").join(gone, e["dst"] == gone["p"], "left_anti").agg(F.count(F.lit(1)).alias("edges_left"))
    return left.join(F.broadcast(n.where("coalesce(source_path, '') not like 'tasks/%'").agg(F.count(F.lit(1)).alias("nodes_left"))))


@R.add("SELECT label, count(*) AS n, sum(CASE WHEN weight = 0 THEN 1 ELSE 0 END) AS n_zero FROM ed GROUP BY label")
def s25_edge_table(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") == 0).alias("n_zero"))


# ---- filters

@R.add("SELECT id FROM cur WHERE type = 'task' AND status = 'active'")
def f1_equality(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.find import find

    return find(S.nodes(spark, d), {"type": "task", "status": "active"}).select("id")


@R.add("SELECT id FROM cur WHERE importance >= 0.4 AND importance < 0.7 AND hit_count > 10")
def f2_range(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.find import find

    return find(S.nodes(spark, d), {"importance": {"$gte": 0.4, "$lt": 0.7}, "hit_count": {"$gt": 10}}).select("id")


@R.add("SELECT qid FROM temporal_state WHERE list_contains(gold_ids, 1307) AND list_contains(gold_ids, 1561)")
def f3_all(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.find import find

    return find(table(spark, d, "temporal_state"), {"gold_ids": {"$all": [1307, 1561]}}).select("qid")


@R.add("SELECT id FROM cur WHERE type = 'plan' OR importance > 0.9")
def f4_or(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.find import find

    return find(S.nodes(spark, d), {"$or": [{"type": "plan"}, {"importance": {"$gt": 0.9}}]}).select("id")


@R.add("SELECT request_id, 'there' AS chat FROM req WHERE coalesce(map_contains(meta, 'chat_id'), false) UNION ALL SELECT request_id, 'missing' FROM req WHERE NOT coalesce(map_contains(meta, 'chat_id'), false) UNION ALL SELECT request_id, 'column' FROM req")
def f5_exists(spark: SparkSession, d: str) -> DataFrame:
    """A key of a map, there or missing; a column is there for every row, null or not."""
    from marlstone.operators.find import find

    r = S.requests(spark, d)
    of = lambda spec, name, within: find(r, spec, within).select("request_id", F.lit(name).alias("chat"))
    return of({"chat_id": {"$exists": True}}, "there", "meta").union(of({"chat_id": {"$exists": False}}, "missing", "meta")).union(of({"session_id": {"$exists": True}}, "column", None))


@R.add("SELECT 'logs' AS tier, count(*) AS n FROM cur WHERE type IN ('record','event','git_commit','thought','session') UNION ALL SELECT 'facts', count(*) FROM cur WHERE coalesce(type,'') NOT IN ('record','event','git_commit','thought','session')")
def f9_tier(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d)
    one = lambda t: n.where(E.in_tier(F.col("type"), t, S.LOGS)).agg(F.lit(t).alias("tier"), F.count(F.lit(1)).alias("n"))
    return one("logs").union(one("facts")).select("tier", "n")


@R.add("SELECT id FROM cur WHERE (type = 'kb_chunk' OR domain = 'hermes') AND status NOT IN ('outdated', 'archived')")
def f11_domain(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where(E.in_domain(F.col("type"), F.col("domain"), "hermes") & E.retrievable(F.col("status"))).select("id")


@R.add("SELECT id, domain IN ('task','kb','hermes','novel','general') AS in_block FROM cur WHERE coalesce(type, '') <> 'kb_chunk'")
def f12_block(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where(E.in_scope(F.col("type"), "memory")).select("id", F.col("domain").isin("task", "kb", "hermes", "novel", "general").alias("in_block"))


@R.add("SELECT id FROM cur WHERE NOT coalesce(type IN ('memory','task','plan'), false) OR valid_at IS NULL OR (valid_at <= 1760000000 AND (invalid_at IS NULL OR invalid_at > 1760000000))")
def f15_as_of(spark: SparkSession, d: str) -> DataFrame:
    timed = F.coalesce(F.col("type").isin("memory", "task", "plan"), F.lit(False))
    return S.nodes(spark, d).where(E.valid_at(1_760_000_000, F.col("valid_at"), F.col("invalid_at"), timed)).select("id")


@R.add("SELECT id, coalesce(meta['origin'] IN ('session_digest','dialogue_digest'), false) OR starts_with(content, '[对话沉淀]') AS digest FROM cur")
def f17_digest(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", E.is_digest(F.col("meta"), F.col("content"), ("session_digest", "dialogue_digest"), ("[对话沉淀]",)).alias("digest"))


@R.add("SELECT request_id, CASE WHEN trim(content) = '' THEN 'empty' WHEN length(trim(content)) > 50000 THEN 'too_long' WHEN type = 'task' AND length(trim(content)) > 2000 THEN 'over_soft_limit' ELSE 'ok' END AS verdict FROM req")
def f19_ingest_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length(F.trim("content"))
    verdict = F.when(n == 0, "empty").when(n > 50_000, "too_long").when((F.col("type") == "task") & (n > 2_000), "over_soft_limit").otherwise("ok")
    return S.requests(spark, d).select("request_id", verdict.alias("verdict"))


@R.add("SELECT request_id, meta IS NULL OR (cardinality(meta) <= 8 AND len(list_filter(map_keys(meta), lambda k: NOT regexp_full_match(k, '[a-zA-Z0-9_]{1,32}'))) = 0 AND len(list_filter(map_values(meta), lambda v: v IS NULL OR length(v) > 256)) = 0) AS ok FROM req")
def f21_meta_guard(spark: SparkSession, d: str) -> DataFrame:
    return S.requests(spark, d).select("request_id", E.meta_ok(F.col("meta")).alias("ok"))


@R.add("SELECT request_id, list_sort(list_filter(['outcome','next','pitfalls'], lambda k: trim(coalesce(sections[k], '')) = '')) AS missing FROM req")
def f22_missing_sections(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("outcome"), F.lit("next"), F.lit("pitfalls"))
    return S.requests(spark, d).select("request_id", F.sort_array(F.filter(wanted, lambda k: F.trim(F.coalesce(F.element_at("sections", k), F.lit(""))) == "")).alias("missing"))


@R.add("SELECT DISTINCT src AS path, CASE WHEN src LIKE 'index/%' THEN 'index' WHEN src LIKE 'skills/%' THEN 'skill' WHEN regexp_matches(src, '(^|/)novel/[^/]*$') OR src LIKE 'novel/%' THEN 'novel' ELSE 'note' END AS kind FROM ed WHERE regexp_matches(src, '\\.md$') AND NOT regexp_matches(src, '^archive/')".replace("\\\\", "\\"))
def f24_path_rules(spark: SparkSession, d: str) -> DataFrame:
    """Include and exclude by pattern, kind by the first rule that fits."""
    p = S.edges(spark, d).select(F.col("src").alias("path")).distinct().where(F.col("path").rlike(r"\.md$") & ~F.col("path").rlike("^archive/"))
    kind = F.when(F.col("path").like("index/%"), "index").when(F.col("path").like("skills/%"), "skill").when(F.col("path").rlike("(^|/)novel/[^/]*$") | F.col("path").like("novel/%"), "novel").otherwise("note")
    return p.select("path", kind.alias("kind"))


@R.add("SELECT id FROM cur WHERE raw_domain = 'hermes' AND map_contains(meta, 'chat_id')")
def f27_purge_match(spark: SparkSession, d: str) -> DataFrame:
    """The nodes a purge by mark would take: the domain exactly as written."""
    return S.nodes(spark, d).where((F.col("raw_domain") == "hermes") & F.map_contains_key("meta", "chat_id")).select("id")


@R.add(r"SELECT qid, query, regexp_matches(query, '#\d{1,5}\b') OR regexp_matches(query, '\b[A-Z]{2,}-\d+\b') OR len(list_filter(regexp_extract_all(query, '\b[0-9a-f]{7,40}\b'), lambda x: regexp_matches(x, '[0-9]'))) > 0 AS exact FROM temporal_state")
def f29_exact_identifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_state").select("qid", "query", E.exact_identifier(F.col("query")).alias("exact"))


@R.add(r"SELECT session_id, max(CASE WHEN len(list_filter(map_values(coalesce(sections, MAP {})), lambda v: trim(coalesce(v, '')) <> '')) > 0 OR regexp_matches(content, '做|改|查|写|跑|验证|修|提|生成|整理|分析|对比') OR regexp_matches(content, '(?i)\b(do|make|fix|add|check|run|verify|write|build|create|review|analyze)\b') THEN 1 ELSE 0 END) AS substantive, count(*) AS n FROM req GROUP BY 1")
def f30_substantive(spark: SparkSession, d: str) -> DataFrame:
    return S.requests(spark, d).groupBy("session_id").agg(F.max(E.substantive(F.col("sections"), F.coalesce("content", F.lit(""))).cast("int")).alias("substantive"), F.count(F.lit(1)).alias("n"))


# ---- aggregates

@R.add("SELECT count(*) AS n, round(sum(importance), 6) AS total, round(avg(importance), 6) AS mean, min(importance) AS low, max(importance) AS high FROM cur")
def a1_global(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("importance")
    return S.nodes(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(i), 6).alias("total"), F.round(F.avg(i), 6).alias("mean"), F.min(i).alias("low"), F.max(i).alias("high"))


@R.add("SELECT qid, list_sort(list(g)) AS ids FROM (SELECT qid, unnest(gold_ids) AS g FROM temporal_state) GROUP BY qid")
def a2_collect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_state").select("qid", F.explode("gold_ids").alias("g")).groupBy("qid").agg(F.sort_array(F.collect_list("g")).alias("ids"))


@R.add("SELECT coalesce(type, 'all') AS type, coalesce(domain, 'all') AS domain, count(*) AS n, count(*) FILTER (status = 'outdated') AS outdated FROM (SELECT coalesce(type,'unknown') AS type, domain, status FROM cur) GROUP BY GROUPING SETS ((), (type), (domain))")
def a3_stats(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d).select(F.coalesce("type", F.lit("unknown")).alias("type"), "domain", "status")
    n.createOrReplaceTempView("_a3")
    return spark.sql("SELECT coalesce(type, 'all') AS type, coalesce(domain, 'all') AS domain, count(*) AS n, count_if(status = 'outdated') AS outdated FROM _a3 GROUP BY GROUPING SETS ((), (type), (domain))")


@R.add("SELECT CASE WHEN importance < 0.4 THEN '<0.4' WHEN importance < 0.6 THEN '0.4-0.6' WHEN importance < 0.8 THEN '0.6-0.8' ELSE '>=0.8' END AS bucket, count(*) AS n FROM cur GROUP BY 1")
def a4_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).groupBy(E.bucket(F.col("importance")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT strftime(DATE '1970-01-01' + CAST(floor(created_at / 86400) AS INTEGER), '%Y-%m') AS month, count(*) AS n FROM cur WHERE created_at > 0 GROUP BY 1")
def a5_months(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where("created_at > 0").groupBy(E.month_of(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT count(*) FILTER (coalesce(type,'') IN ('record','event','git_commit','thought','session')) AS logs, count(*) FILTER (coalesce(type,'') NOT IN ('record','event','git_commit','thought','session')) AS facts, count(*) FILTER (coalesce(type,'') NOT IN ('record','event','git_commit','thought','session','memory','correction','decision','plan','task','review','solution','inspiration','user_intent','character_state')) AS unclassified FROM cur")
def a6_tiers(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("type", F.lit(""))
    return S.nodes(spark, d).agg(F.count_if(t.isin(*S.LOGS)).alias("logs"), F.count_if(~t.isin(*S.LOGS)).alias("facts"), F.count_if(~t.isin(*S.LOGS, *S.FACTS)).alias("unclassified"))


@R.add("SELECT count(DISTINCT src) AS with_edges, count(*) AS edges, round(count(*) / CAST(count(DISTINCT src) AS DOUBLE), 2) AS mean_out FROM ed")
def a7_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    out = S.edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return out.agg(F.count(F.lit(1)).alias("with_edges"), F.sum("n").alias("edges"), F.round(F.sum("n") / F.count(F.lit(1)), 2).alias("mean_out"))


@R.add("SELECT id, hit_count FROM cur ORDER BY hit_count DESC, id LIMIT 10")
def a7_top_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", "hit_count").orderBy(F.desc("hit_count"), "id").limit(10)


@R.add("SELECT round(count(*) FILTER (coalesce(meta['origin'] IN ('session_digest','dialogue_digest'), false) OR starts_with(content, '[对话沉淀]')) / CAST(count(*) AS DOUBLE), 4) AS share FROM cur WHERE status = 'active'")
def a8_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of digests among active nodes."""
    digest = E.is_digest(F.col("meta"), F.col("content"), ("session_digest", "dialogue_digest"), ("[对话沉淀]",))
    return S.nodes(spark, d).where("status = 'active'").agg(F.round(F.count_if(digest) / F.count(F.lit(1)), 4).alias("share"))


@R.add("SELECT coalesce(dedupe, 'none') AS dedupe, count(*) AS n, count(*) FILTER (trim(coalesce(replaces,'')) <> '') AS replacing, round(count(*) FILTER (trim(coalesce(replaces,'')) <> '') / CAST(count(*) AS DOUBLE), 4) AS rate FROM req WHERE event_time >= TIMESTAMP '2026-01-01' AND event_time < TIMESTAMP '2026-07-01' GROUP BY 1")
def a9_write_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = S.requests(spark, d).where("event_time >= timestamp_ntz'2026-01-01' and event_time < timestamp_ntz'2026-07-01'")
    some = F.trim(F.coalesce("replaces", F.lit(""))) != ""
    return r.groupBy(F.coalesce("dedupe", F.lit("none")).alias("dedupe")).agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("replacing"), F.round(F.count_if(some) / F.count(F.lit(1)), 4).alias("rate"))


@R.add("SELECT coalesce(model, 'all') AS model, coalesce(dim, 0) AS dim, count(*) AS chunks, count(DISTINCT node_id) AS nodes FROM (SELECT node_id, v.model AS model, v.dim AS dim FROM ch) GROUP BY GROUPING SETS ((), (model), (dim))")
def a10_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    S.chunks(spark, d).select("node_id", "model", "dim").createOrReplaceTempView("_a10")
    return spark.sql("SELECT coalesce(model, 'all') AS model, coalesce(dim, 0) AS dim, count(*) AS chunks, count(DISTINCT node_id) AS nodes FROM _a10 GROUP BY GROUPING SETS ((), (model), (dim))")


@R.add(", p AS (SELECT src AS p FROM raw_ed WHERE src IS NOT NULL UNION SELECT dst FROM raw_ed WHERE dst IS NOT NULL) SELECT count(*) AS pages, count(*) FILTER (p NOT IN (SELECT src FROM ed UNION SELECT dst FROM ed)) AS isolated FROM p")
def a12_isolated(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "graph_edges")
    from marlstone.operators.hierarchy import clean_path

    p = raw.select(clean_path(F.col("source")).alias("p")).union(raw.select(clean_path(F.col("target")))).where("p is not null").distinct()
    e = S.edges(spark, d)
    tied = e.select(F.col("src").alias("p")).union(e.select("dst")).distinct().withColumn("tied", F.lit(True))
    return p.join(tied, "p", "left").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("tied").isNull()).alias("isolated"))


@R.add("SELECT p AS id, count(*) AS degree FROM (SELECT src AS p FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a14_top_degree(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(10)


@R.add("SELECT type, round(quantile_cont(importance, 0.5), 6) AS p50, round(quantile_cont(importance, 0.9), 6) AS p90, round(quantile_cont(importance, 0.99), 6) AS p99 FROM cur GROUP BY 1")
def a15_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).groupBy("type").agg(*[F.round(F.percentile("importance", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


@R.add("SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY CUBE (event_type, user_id)")
def a25_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").cube("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


# ---- windows

@R.add("SELECT id, row_number() OVER (ORDER BY importance DESC, id) - 1 AS place FROM cur")
def w1_rank(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d)
    return global_place(n.select("id", "importance"), F.desc("importance"), F.asc("id")).select("id", (F.col("place") - 1).alias("place"))


@R.add("SELECT dst, src, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src, label) AS r FROM ed) WHERE r = 1")
def w3_argmax(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("dst").orderBy(F.desc("weight"), "src", "label")
    return S.edges(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("dst", "src", "weight")


@R.add("SELECT node_id, chunk_idx, lead(chunk_idx) OVER (PARTITION BY node_id ORDER BY chunk_idx) AS next FROM ch")
def w5_next_chunk(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("node_id").orderBy("chunk_idx")
    return S.chunks(spark, d).select("node_id", "chunk_idx", F.lead("chunk_idx").over(w).alias("next"))


@R.add("SELECT DISTINCT node_id, first_value(chunk_idx) OVER (PARTITION BY node_id ORDER BY chunk_idx) AS hub, count(*) OVER (PARTITION BY node_id) AS members FROM ch")
def w6_hub(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).groupBy("node_id").agg(F.min("chunk_idx").alias("hub"), F.count(F.lit(1)).alias("members"))


@R.add("""
, pins AS (SELECT id, domain, least(length(content), 600) + 20 AS cost, importance FROM cur WHERE status = 'active' AND importance >= 0.8),
run AS (SELECT *, sum(cost) OVER (PARTITION BY domain ORDER BY importance DESC, id DESC ROWS UNBOUNDED PRECEDING) AS total FROM pins)
SELECT id, domain, CAST(cost AS BIGINT) AS cost, CAST(total AS BIGINT) AS total FROM run WHERE total <= 2000""")
def w7_budget(spark: SparkSession, d: str) -> DataFrame:
    """Pinned nodes of each domain, best first, until the first that would overflow the budget (costs are positive, so the running sum stops there)."""
    cost = (F.least(F.char_length("content"), F.lit(600)) + 20).cast("bigint")
    run = Window.partitionBy("domain").orderBy(F.desc("importance"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return S.nodes(spark, d).where("status = 'active' and importance >= 0.8").select("id", "domain", cost.alias("cost"), "importance").withColumn("total", F.sum("cost").over(run)).where("total <= 2000").select("id", "domain", "cost", "total")


@R.add("SELECT qid, CASE WHEN r <= floor(0.8 * n) THEN 'tune' ELSE 'test' END AS part FROM (SELECT qid, row_number() OVER (ORDER BY t, qid) AS r, count(*) OVER () AS n FROM (SELECT qid, min(created_at) AS t FROM temporal_state GROUP BY qid))")
def w9_split(spark: SparkSession, d: str) -> DataFrame:
    """The oldest four fifths of the questions to tune on."""
    q = table(spark, d, "temporal_state").groupBy("qid").agg(F.min("created_at").alias("t"))
    n = q.agg(F.count(F.lit(1)).alias("n"))
    r = global_place(q, "t", "qid", name="r").join(F.broadcast(n))
    return r.select("qid", F.when(F.col("r") <= F.floor(0.8 * F.col("n")), "tune").otherwise("test").alias("part"))


@R.add("SELECT session_id, turn_index, min(request_id) AS request_id FROM req GROUP BY 1, 2")
def w11_first(spark: SparkSession, d: str) -> DataFrame:
    return S.requests(spark, d).groupBy("session_id", "turn_index").agg(F.min("request_id").alias("request_id"))


@R.add("SELECT id, round(CASE WHEN hi = lo THEN 1.0 ELSE (importance - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT id, importance, min(importance) OVER (PARTITION BY type) AS lo, max(importance) OVER (PARTITION BY type) AS hi FROM cur)")
def w14_min_max(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d)
    ends = n.groupBy("type").agg(F.min("importance").alias("lo"), F.max("importance").alias("hi"))
    j = n.join(ends, n["type"].eqNullSafe(ends["type"]))
    return j.select("id", F.round(F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("importance") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("scaled"))


@R.add("SELECT event_id, round(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 6) AS pr, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS quarter FROM events")
def w13_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type")
    return table(spark, d, "events").select("event_id", F.round(F.percent_rank().over(w.orderBy("value")), 6).alias("pr"), F.ntile(4).over(w.orderBy("value", "event_id")).cast("bigint").alias("quarter"))


# ---- sorts

@R.add("SELECT id, coalesce(created_at, 0) AS at FROM cur ORDER BY 2 DESC, 1 DESC LIMIT 25")
def o3_recent(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", F.coalesce("created_at", F.lit(0.0)).alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(25)


@R.add("SELECT id, importance FROM cur WHERE status = 'active' AND type IN ('memory','decision') ORDER BY importance DESC, id DESC LIMIT 30")
def o6_pins(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where("status = 'active' and type in ('memory','decision')").select("id", "importance").orderBy(F.desc("importance"), F.desc("id")).limit(30)


@R.add("SELECT id, hit_count FROM cur WHERE raw_status = 'active' AND hit_count >= 5 ORDER BY hit_count DESC, id LIMIT 50")
def o8_promotable(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where("raw_status = 'active' and hit_count >= 5").select("id", "hit_count").orderBy(F.desc("hit_count"), "id").limit(50)


@R.add("SELECT id, round(importance * pow(0.95, CASE WHEN created_at > 0 THEN greatest(0, (1790000000.0 - created_at) / 86400) ELSE 0 END / 30), 6) AS effective FROM cur WHERE raw_status = 'active' ORDER BY 2, 1 LIMIT 20")
def o9_decayed(spark: SparkSession, d: str) -> DataFrame:
    eff = F.round(F.col("importance") * F.pow(F.lit(0.95), E.days_since(F.col("created_at"), NOW) / 30), 6)
    return S.nodes(spark, d).where("raw_status = 'active'").select("id", eff.alias("effective")).orderBy("effective", "id").limit(20)


@R.add("SELECT id, created_at FROM cur WHERE status = 'outdated' ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def o10_outdated(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where("status = 'outdated'").select("id", "created_at").orderBy(F.desc_nulls_last("created_at"), "id").limit(20)


@R.add("SELECT id FROM cur WHERE type = 'memory' ORDER BY created_at DESC NULLS FIRST, id LIMIT 10 OFFSET 5")
def o12_offset(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where("type = 'memory'").orderBy(F.desc_nulls_first("created_at"), "id").offset(5).limit(10).select("id")


# ---- sets

@R.add("SELECT id FROM cur WHERE type = 'task' UNION SELECT id FROM cur WHERE importance > 0.8")
def u1_union(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d)
    return n.where("type = 'task'").select("id").union(n.where("importance > 0.8").select("id")).distinct()


@R.add("SELECT src AS p FROM ed INTERSECT SELECT dst FROM ed")
def u2_intersect(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d)
    return e.select(F.col("src").alias("p")).intersect(e.select("dst"))


@R.add("SELECT src AS p FROM ed EXCEPT SELECT dst FROM ed")
def u3_except(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d)
    return e.select(F.col("src").alias("p")).subtract(e.select("dst"))


@R.add(r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(regexp_replace(text, '\s+', '', 'g'))")
def u6_content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One document, the smallest id, of those that differ in white space only."""
    h = F.sha2(F.regexp_replace("text", r"\s+", ""), 256)
    return table(spark, d, "documents").groupBy(h.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


QUERIES, SQL = R.queries, R.sql
