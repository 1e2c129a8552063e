"""Tasks, dates, gates, packs, probes and the hybrid dispatcher as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import expr as E
from marlstone.functions import tasks as K
from marlstone.operators import fulltext as T
from marlstone.operators import indexing as I
from marlstone.operators import retrieval as X
from marlstone.operators import vector as V
from marlstone.operators import writes as W
from marlstone.operators.ranking import global_place
from marlstone.plans.registry import VIEWS, Registry
from marlstone.plans.relations import _query
from marlstone.runtime import table
from marlstone.sources import store as S

R = Registry(VIEWS)
NOW = 1_790_000_000.0
_SIM = "list_cosine_similarity(v, (SELECT v FROM vec ORDER BY id LIMIT 1))"

# ---- tasks: the test tables' texts have no marks, so each task gets one by its hit count

_MARKS = ("[待办] ", "【任务（进行中）】", "[挂账，落地后实施] ", "[未完成] ", "[Done 2026] ", "【★接续点】", "")
_TASKS_SQL = (
    ", tk AS (SELECT id, type, status, importance, created_at, title, hit_count % 7 = 5 AS note, CASE hit_count % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + " END || content AS content FROM cur WHERE type = 'task')"
    + r""",
line AS (SELECT id, split_part(content, chr(10), 1) AS line FROM tk),
mk AS (SELECT id, line, unnest(regexp_extract_all(line, '\[([^\[\]\n]*)\]', 1)) AS m, '[' AS o FROM line UNION SELECT id, line, unnest(regexp_extract_all(line, '【([^【】\n]*)】', 1)), '【' FROM line),
mp AS (SELECT id, line, m, instr(line, o || m) AS pos, lower(regexp_replace(m, '\s+', '', 'g')) AS t FROM mk),
voids AS (SELECT unnest(['未完成', '还没', '尚未', '未开始', '未能', '暂未', '没有完成']) AS v),
words(w, s, k) AS (VALUES """ + ", ".join(f"('{w}', '{s}', {i})" for i, (w, s) in enumerate(K.WORDS)) + r"""),
bad AS (SELECT DISTINCT id, pos FROM mp, voids WHERE contains(m, v) OR contains(substr(line, 1, pos - 1), v)),
named AS (SELECT id, pos, arg_min(s, instr(t, w) * 1000 + k) AS state FROM mp JOIN words ON contains(t, w) WHERE (id, pos) NOT IN (SELECT (id, pos) FROM bad) GROUP BY id, pos),
st AS (SELECT t.*, n.state, CASE WHEN t.note THEN 'handoff' END AS kind, CAST(t.created_at AS VARCHAR) IS NOT NULL AS dated FROM tk t LEFT JOIN (SELECT id, arg_min(state, pos) AS state FROM named GROUP BY id) n USING (id))
"""
)


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("hit_count") % 7 + 1).cast("int"))
    t = S.nodes(spark, d).where("type = 'task'").withColumn("content", F.concat(mark, "content"))
    return t.select("id", "type", "status", "importance", "created_at", "title", "content", F.when(F.col("hit_count") % 7 == 5, "handoff").alias("kind"), F.lit(False).alias("legacy"), F.lit(False).alias("recovered"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("last_touched_at"), F.lit(None).cast("string").alias("task_state"), K.parsed_state(F.col("content")).alias("state"))


@R.add(_TASKS_SQL + "SELECT id, state, kind FROM st")
def x8_task_states(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("id", "state", F.when(K.is_handoff(F.col("content")), "handoff").alias("kind"))


@R.add(_TASKS_SQL + "SELECT id, state FROM st WHERE status = 'active' AND NOT note AND state IN ('todo', 'doing', 'blocked')")
def f26_active_tasks(spark: SparkSession, d: str) -> DataFrame:
    return K.active(_tasks(spark, d)).select("id", "state")


@R.add(_TASKS_SQL + "SELECT id, state FROM st WHERE status = 'active' AND NOT note AND state IN ('todo', 'doing', 'blocked') ORDER BY CASE state WHEN 'doing' THEN 0 WHEN 'blocked' THEN 1 ELSE 2 END, importance DESC, id DESC LIMIT 15")
def o4_task_order(spark: SparkSession, d: str) -> DataFrame:
    return K.active(_tasks(spark, d)).orderBy(*K.order()).limit(15).select("id", "state")


@R.add(_TASKS_SQL + "SELECT id, kind FROM st WHERE status = 'active' AND (note OR state IN ('todo', 'doing', 'blocked')) ORDER BY note DESC, CASE WHEN note THEN coalesce(created_at, id) END DESC NULLS LAST, CASE WHEN note THEN importance END DESC NULLS LAST, CASE WHEN note THEN id END DESC NULLS LAST, CASE state WHEN 'doing' THEN 0 WHEN 'blocked' THEN 1 WHEN 'todo' THEN 2 ELSE 3 END, importance DESC, id DESC LIMIT 15")
def o5_handoff_first(spark: SparkSession, d: str) -> DataFrame:
    return K.active(_tasks(spark, d), handoff=True).orderBy(*K.order(handoff_first=True)).limit(15).select("id", "kind")


@R.add(_TASKS_SQL + ", a AS (SELECT id, (1790000000.0 - created_at) / 86400 AS age FROM st WHERE status = 'active' AND NOT note AND state IN ('todo', 'doing', 'blocked')) SELECT count(*) AS n, arg_min(id, (-age, id)) AS oldest_id, CAST(floor(max(age)) AS BIGINT) AS oldest_days FROM a WHERE age > 300")
def r37_stale_tasks(spark: SparkSession, d: str) -> DataFrame:
    return K.folded(K.active(_tasks(spark, d)), (F.lit(NOW) - F.col("created_at")) / 86_400, 300)[1]


@R.add(_TASKS_SQL + "SELECT id, coalesce(state, 'unknown') AS state, state IS NULL AS needs_review, coalesce(state, 'unknown') IN ('done', 'canceled', 'unknown') AND NOT note AS legacy, coalesce(nullif(trim(title), ''), substr(trim(split_part(content, chr(10), 1)), 1, 40)) AS title FROM st")
def r49_task_backfill(spark: SparkSession, d: str) -> DataFrame:
    return K.backfilled(_tasks(spark, d))


@R.add(_TASKS_SQL + "SELECT id, state AS before, CASE id % 6 WHEN 0 THEN 'done' ELSE 'doing' END AS after FROM st WHERE id % 6 IN (0, 3) AND state IS DISTINCT FROM CASE id % 6 WHEN 0 THEN 'done' ELSE 'doing' END")
def r40_task_patches(spark: SparkSession, d: str) -> DataFrame:
    """The log of a batch of patches: some give a state, some a new text that names one."""
    t = _tasks(spark, d)
    p = t.where("id % 6 in (0, 3)").select("id", F.when(F.col("id") % 6 == 3, "[进行中] again").alias("content"), F.when(F.col("id") % 6 == 0, "done").alias("task_state"))
    return K.patched(t, p, "2026-09-21T14:13:20Z")[1].select("id", "before", "after")


# ---- dates in texts

@R.add()
def x21_named_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that requests and documents name, apart into due and mentioned ones."""
    r = S.requests(spark, d).select(F.lit("request").alias("src"), F.col("request_id").alias("id"), F.col("content").alias("text"), D.reference_time(F.col("content"), F.col("event_time").cast("timestamp_ntz"), F.col("received_at").cast("timestamp_ntz")).alias("ref"))
    t = table(spark, d, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), "text", F.col("created_at").cast("timestamp_ntz").alias("ref"))
    return r.union(t).select("src", "id", D.date_fields(F.col("text"), F.col("ref")).alias("f")).where("f.ref is not null").select("src", "id", "f.due", "f.mention")


_DUE_SQL = r""", iso AS (SELECT doc_id, created_at, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '20\d\d-\d\d-\d\d'), lambda x: TRY_CAST(x AS DATE)), lambda x: x IS NOT NULL))) AS due FROM documents)"""


def _due(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("text", F.lit(r"20\d\d-\d\d-\d\d"), F.lit(0)), lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))
    return table(spark, d, "documents").select("doc_id", "created_at", F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("due"))


@R.add(_DUE_SQL + "SELECT doc_id FROM iso WHERE len(list_filter(due, lambda x: x BETWEEN DATE '2025-06-01' - 120 AND DATE '2025-06-01' + 120)) > 0")
def x24_due_scan(spark: SparkSession, d: str) -> DataFrame:
    return _due(spark, d).where(D.due_within(F.col("due"), "2025-06-01", 120)).select("doc_id")


@R.add(_DUE_SQL + "SELECT doc_id FROM iso WHERE len(due) > 0 ORDER BY created_at, doc_id LIMIT 20")
def o13_due_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _due(spark, d).where("size(due) > 0").orderBy("created_at", "doc_id").limit(20).select("doc_id")


# ---- gates and predicates

@R.add("SELECT id FROM cur WHERE status <> 'outdated'")
def f14_not_outdated(spark: SparkSession, d: str) -> DataFrame:
    """What a plain recall may show: archived nodes too, outdated ones not."""
    return S.nodes(spark, d).where("status <> 'outdated'").select("id")


@R.add("SELECT id, coalesce(lower(trim(type)) IN ('rule', 'correction'), false) AS protected FROM cur")
def f18_protected(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", W.is_protected(F.lit(None).cast("boolean"), F.col("type"), ("rule", "correction")).alias("protected"))


@R.add("SELECT item_id, CASE WHEN trim(query) = '' THEN 'empty' WHEN length(query) > 60 THEN 'too_long' ELSE 'ok' END AS verdict FROM eval_items")
def f20_query_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", W.query_verdict(F.col("query"), 60).alias("verdict"))


@R.add(r"SELECT request_id, CASE WHEN content IS NULL THEN 'malformed_node' WHEN trim(content) = '' THEN 'empty_content' WHEN regexp_matches(content, 'sk-[A-Za-z0-9]{16,}') THEN 'secret' ELSE 'ok' END AS issue, list_filter(['phone', 'id_card'], lambda k: CASE k WHEN 'phone' THEN regexp_matches(content, '(^|\D)1[3-9]\d{9}(\D|$)') ELSE regexp_matches(content, '(^|\D)\d{17}[\dXx](\D|$)') END) AS hints FROM req")
def s15_node_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each node of a pack, and the weak marks of secrets in it."""
    c = F.col("content")
    return S.requests(spark, d).select("request_id", W.issue(c).alias("issue"), W.secret_hints(c).alias("hints"))


@R.add("SELECT id, substr(content, 1, 80) AS preview, length(content) AS chars FROM cur WHERE type = 'plan'")
def s17_pack_summary(spark: SparkSession, d: str) -> DataFrame:
    return W.pack_summary(S.nodes(spark, d).where("type = 'plan'"), 80)


@R.add("""
, top AS (SELECT max(id) AS top FROM cur), ok AS (SELECT * FROM req WHERE trim(content) <> '' AND NOT regexp_matches(content, 'sk-[A-Za-z0-9]{16,}'))
SELECT request_id, top + row_number() OVER (ORDER BY request_id) AS id, coalesce(nullif(trim(type), ''), 'memory') AS type, coalesce(importance, 0.5) AS importance, coalesce(nullif(lower(trim(domain)), ''), 'general') AS domain, 'active' AS status FROM ok, top""")
def s21_insert(spark: SparkSession, d: str) -> DataFrame:
    """New nodes with defaults filled in and ids after the largest; strong secrets and empty contents stay out."""
    return W.inserted(S.nodes(spark, d), S.requests(spark, d), "request_id").select("request_id", "id", "type", "importance", "domain", "status")


@R.add("""
, up AS (SELECT dedupe_target AS id, arg_max(content, request_id) AS content FROM req WHERE dedupe_target IS NOT NULL AND trim(content) <> '' GROUP BY 1)
SELECT c.id, u.id IS NOT NULL AND u.content <> c.content AS vector_stale, md5(coalesce(u.content, c.content)) AS hash FROM cur c LEFT JOIN up u USING (id)""")
def s23_update_contents(spark: SparkSession, d: str) -> DataFrame:
    """New contents for nodes; whose text changed has a stale vector."""
    up = S.requests(spark, d).where("dedupe_target is not null and trim(content) <> ''").groupBy(F.col("dedupe_target").alias("id")).agg(F.max_by("content", "request_id").alias("content"))
    return W.with_contents(S.nodes(spark, d), up).select("id", "vector_stale", F.md5("content").alias("hash"))


@R.add("""
, new AS (SELECT dedupe_target AS id, arg_max(coalesce(type, ''), request_id) AS type FROM req WHERE dedupe_target IS NOT NULL GROUP BY 1)
SELECT coalesce(n.id, c.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.type ELSE coalesce(c.type, '') END AS type FROM cur c FULL JOIN new n ON n.id = c.id""")
def s26_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = S.requests(spark, d).where("dedupe_target is not null").groupBy(F.col("dedupe_target").alias("id")).agg(F.max_by(F.coalesce("type", F.lit("")), "request_id").alias("type"))
    return W.upserted(S.nodes(spark, d).select("id", F.coalesce("type", F.lit("")).alias("type")), new, ["id"])


@R.add("""
, gate AS (SELECT request_id, content, dedupe_target, CASE WHEN trim(coalesce(replaces, '')) <> '' THEN 'replace' WHEN lower(dedupe) = 'reject' AND dedupe_target IS NOT NULL THEN 'reject' WHEN lower(dedupe) = 'merge' AND dedupe_target IS NOT NULL THEN 'merge' ELSE 'insert' END AS verdict FROM req)
SELECT g.request_id, length(c.content) + 2 + length(g.content) AS chars, md5(c.content || chr(10) || chr(10) || g.content) AS hash FROM gate g JOIN cur c ON c.id = g.dedupe_target WHERE verdict = 'merge'""")
def r29_merged_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of a node that a request is merged into: both, with an empty line between."""
    r = S.requests(spark, d).where("trim(coalesce(replaces, '')) = '' and lower(dedupe) = 'merge'").select("request_id", F.col("content").alias("more"), F.col("dedupe_target").alias("id"))
    j = r.join(S.nodes(spark, d).select("id", "content"), "id").withColumn("text", F.concat_ws("\n\n", "content", "more"))
    return j.select("request_id", F.char_length("text").cast("bigint").alias("chars"), F.md5("text").alias("hash"))


# ---- retrieval

def _hits(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query(spark, d)])
    return S.vectors(spark, d).select((F.col("id") + 1000).alias("id"), "label", E.cosine(F.col("v"), q).alias("score"))


@R.add(f", s AS (SELECT label, {_SIM} AS s FROM vec WHERE id > 1) SELECT label, max(s) < 0.55 AND count(*) FILTER (s >= 0.65) = 0 AS pass, round(max(s), 3) AS top, count(*) FILTER (s >= 0.65) AS danger FROM s GROUP BY label")
def a24_false_premise(spark: SparkSession, d: str) -> DataFrame:
    """Questions without an answer pass if nothing scores high; the label stands for the question."""
    s = F.col("score")
    h = _hits(spark, d).where("id > 1001").groupBy("label").agg(F.max(s).alias("top"), F.count_if(s >= 0.65).alias("danger"))
    return h.select("label", ((F.col("top") < 0.55) & (F.col("danger") == 0)).alias("pass"), F.round("top", 3).alias("top"), "danger")


@R.add(f", h AS (SELECT 1000 + id AS id, {_SIM} AS s FROM vec ORDER BY s DESC, id LIMIT 100) SELECT h.id FROM h WHERE h.id NOT IN (SELECT id FROM cur WHERE status = 'active' AND importance >= 0.6)")
def j24_without_pins(spark: SparkSession, d: str) -> DataFrame:
    """Recall hits that are not pinned anyway."""
    pins = S.nodes(spark, d).where("status = 'active' and importance >= 0.6").select("id")
    return _hits(spark, d).orderBy(F.desc("score"), "id").limit(100).select("id").join(pins, "id", "left_anti")


@R.add(f", h AS (SELECT 1000 + id AS id, {_SIM} AS s FROM vec ORDER BY s DESC, id LIMIT 60) SELECT h.id, round(s, 6) AS score FROM h JOIN cur c ON c.id = h.id WHERE c.type = 'kb_chunk' AND s > 0.02 ORDER BY s DESC, h.id LIMIT 3")
def r35_linked_slices(spark: SparkSession, d: str) -> DataFrame:
    """The first slices of the knowledge base among the hits of a memory, above a threshold."""
    h = _hits(spark, d).orderBy(F.desc("score"), "id").limit(60).join(S.nodes(spark, d).select("id", "type"), "id").where("type = 'kb_chunk' and score > 0.02")
    return h.orderBy(F.desc("score"), "id").limit(3).select("id", F.round("score", 6).alias("score"))


@R.add(f""", h AS (SELECT 1000 + id AS id, {_SIM} AS s FROM vec), j AS (SELECT c.id, c.domain, h.s FROM h JOIN cur c ON c.id = h.id), top AS (SELECT * FROM j ORDER BY s DESC, id LIMIT 10),
routed AS (SELECT domain FROM top GROUP BY domain ORDER BY count(*) DESC, max(s) DESC, domain LIMIT 1)
SELECT id, round(s + CASE WHEN domain = (SELECT domain FROM routed) THEN 0.1 ELSE 0 END, 6) AS score FROM j ORDER BY s + CASE WHEN domain = (SELECT domain FROM routed) THEN 0.1 ELSE 0 END DESC, id LIMIT 10""")
def r44_domain_routing(spark: SparkSession, d: str) -> DataFrame:
    """The commonest domain of the first ten hits gets a boost."""
    return X.routed(_hits(spark, d).select("id", "score").join(S.nodes(spark, d).select("id", "domain"), "id"), 10, 0.1).select("id", F.round("score", 6).alias("score"))


@R.add(f""", a AS (SELECT id, row_number() OVER (ORDER BY {_SIM} DESC, id) AS r FROM vec QUALIFY r <= 20), b AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(v, (SELECT v FROM vec ORDER BY id LIMIT 1 OFFSET 1)) DESC, id) AS r FROM vec QUALIFY r <= 20)
SELECT id, round(1.0 / (60 + coalesce(a.r, 1000000)) + 1.0 / (60 + coalesce(b.r, 1000000)), 9) AS score FROM a FULL JOIN b USING (id)""")
def r45_two_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question and its rewriting: both rankings fused, places from 1, a missing place as good as a million."""
    v = S.vectors(spark, d)
    first, second = ([float(x) for x in r["v"]] for r in v.orderBy("id").limit(2).collect())
    return X.fused_rankings(X.ranked(V.nearest(v, first, 20)), X.ranked(V.nearest(v, second, 20))).withColumn("score", F.round("score", 9))


@R.add(f""", h AS (SELECT 1000 + id AS id, label, {_SIM} AS s FROM vec), t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS r FROM h QUALIFY r <= 2)
SELECT label AS topic, string_agg(id || ':' || r, ' ' ORDER BY r) AS lines FROM t GROUP BY label""")
def r47_topics(spark: SparkSession, d: str) -> DataFrame:
    """The two best hits of each topic as one line."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    t = _hits(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 2")
    return t.groupBy(F.col("label").alias("topic")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["r"].cast("string"))), " ").alias("lines"))


@R.add("""
, p AS (SELECT qid, query FROM (SELECT qid, query, row_number() OVER (PARTITION BY qid ORDER BY created_at, query) AS n FROM temporal_state) WHERE n = 1),
h AS (SELECT p.qid, min(g.id) AS top FROM p JOIN (SELECT DISTINCT qid, unnest(gold_ids) AS id FROM temporal_state) g USING (qid) GROUP BY p.qid)
SELECT p.qid, coalesce(c.type IN ('memory', 'decision', 'task'), false) AND coalesce(contains(coalesce(c.title, '') || ' ' || c.content || ' ' || coalesce(c.source_path, ''), 'e'), false) AS hit FROM p LEFT JOIN h USING (qid) LEFT JOIN cur c ON c.id = h.top""")
def r43_probes(spark: SparkSession, d: str) -> DataFrame:
    """Does the first hit of each question meet what is expected of it? The smallest gold id stands for the first hit."""
    t = table(spark, d, "temporal_state")
    top = t.select("qid", F.explode("gold_ids").alias("id")).groupBy("qid").agg(F.min("id").alias("id"))
    probes = t.select("qid").distinct().select("qid", F.array(F.lit("memory"), F.lit("decision"), F.lit("task")).alias("types"), F.lit("e").alias("text"), F.lit(None).cast("string").alias("source"))
    return X.probed(probes, top.join(S.nodes(spark, d), "id")).select("qid", "hit")


@R.add(f"""
, sem AS (SELECT id + 1 AS id, row_number() OVER (ORDER BY {_SIM} DESC, id) - 1 AS place FROM vec QUALIFY place < 30),
txt AS (SELECT doc_id AS id, (length(lower(text)) - length(replace(lower(text), 'gate', ''))) / 4.0 AS s FROM documents WHERE contains(lower(text), 'gate') ORDER BY s DESC, id LIMIT 30),
tr AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS place FROM txt), parts AS (SELECT id, 1.0 / (60 + place) AS p FROM sem UNION ALL SELECT id, 0.1 / (60 + place) FROM tr),
rrf AS (SELECT id, round(sum(p), 9) AS score FROM parts GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10)
SELECT 'rrf' AS mode, 'ok' AS text, id, score FROM rrf UNION ALL SELECT 'no such mode', 'ok', id, score FROM rrf
UNION ALL SELECT 'rrf', 'degraded', id, round(1.0 / (60 + place), 9) FROM sem WHERE place < 10""")
def r20_hybrid_modes(spark: SparkSession, d: str) -> DataFrame:
    """The dispatcher: an unknown mode is rrf, and without a text table the vectors answer alone and the state says so."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = S.vectors(spark, d).select((F.col("id") + 1).alias("id"), "v")
    out = None
    for mode, text in (("rrf", docs), ("no such mode", docs), ("rrf", None)):
        got, state = X.dispatch(rows, text, _query(spark, d), "gate", mode=mode, wide=30, limit=10)
        part = got.select(F.lit(mode).alias("mode"), F.lit(state["text"]).alias("text"), "id", F.round("score", 9).alias("score"))
        out = part if out is None else out.union(part)
    return out


@R.add(f"""
, hit AS (SELECT 1000 + id AS id, {_SIM} AS s FROM vec ORDER BY s DESC, id LIMIT 12), e AS (SELECT DISTINCT src, dst FROM flinks),
deg AS (SELECT src, count(*) AS n FROM e GROUP BY src), one AS (SELECT e.dst AS id, sum(h.s / d.n) AS got FROM e JOIN hit h ON h.id = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst)
SELECT id, round(coalesce(h.s, 0) + 0.5 * coalesce(o.got, 0), 6) AS score FROM hit h FULL JOIN one o USING (id)""")
def r2_search_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors, then one round of their scores over the links, shared out among a node's links and damped."""
    hits = _hits(spark, d).orderBy(F.desc("score"), "id").limit(12).select("id", "score")
    return X.diffused(hits, S.fact_links(spark, d), damping=0.5, rounds=1).withColumn("score", F.round("score", 6))


@R.add("""
, s AS (SELECT node_id AS id, list_cosine_similarity(CAST(v.vector AS DOUBLE[]), (SELECT v FROM vec ORDER BY id LIMIT 1)) AS s FROM ch WHERE v.dim = 64 AND len(v.vector) = 64 AND len(list_filter(v.vector, lambda x: x <> 0)) > 0),
r AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY id) AS n FROM s)
SELECT id, round(max(s), 6) AS best, round(avg(s) FILTER (r <= 2), 6) AS mean_top2, round(max(s) / sqrt(max(n)), 6) AS by_root FROM r GROUP BY id""")
def r26_chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ways to one score from a node's chunks: the best, the mean of the best two, the best over the root of their number."""
    q = F.array(*[F.lit(float(x)) for x in _query(spark, d)])
    s = S.chunks(spark, d).where("dim = 64 and vector is not null").select(F.col("node_id").alias("id"), E.cosine(F.transform("vector", lambda x: x.cast("double")), q).alias("s"))
    return X.chunk_scores(s).select("id", *[F.round(c, 6).alias(c) for c in ("best", "mean_top2", "by_root")])


@R.add("SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM (SELECT item_id, CAST('0x' || substr(md5(g), 1, 4) AS INTEGER) % 32 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT item_id, unnest(list_transform(generate_series(1, length(query) + 1), lambda i: substr(' ' || query || ' ', i, 2))) AS g FROM eval_items) GROUP BY ALL)")
def x35_embedder(spark: SparkSession, d: str) -> DataFrame:
    """Hashed character pairs as a unit vector, in its filled places."""
    return V.hashed_pairs(table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("query").alias("text")), 32).select(F.col("id").alias("item_id"), "bucket", F.round("value", 6).alias("value"))


@R.add("SELECT item_id, '\"' || replace(query, '\"', '\"\"') || '\"' AS quoted, greatest(1, least(3, length(query) // 10)) AS depth FROM eval_items")
def x3_quote_and_clamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", T.quoted(F.col("query")).alias("quoted"), E.clamp(F.floor(F.char_length("query") / 10), 1, 3).cast("bigint").alias("depth"))


@R.add("SELECT id, k, v, sum(n) OVER (PARTITION BY id ORDER BY k) AS lines FROM (SELECT request_id AS id, e.key AS k, e.value AS v, len(regexp_split_to_array(e.value, '\\n')) AS n FROM (SELECT request_id, unnest(map_entries(sections)) AS e FROM req) WHERE trim(e.value) <> '') QUALIFY lines <= 2".replace("\\\\", "\\"))
def w8_line_budget(spark: SparkSession, d: str) -> DataFrame:
    """Sections in order while their lines fit a budget."""
    s = S.requests(spark, d).select(F.col("request_id").alias("id"), F.explode("sections").alias("k", "v")).where("trim(v) <> ''")
    return W.within_lines(s, ["id"], "k", "v", 2).select("id", "k", "v", "lines")


@R.add("SELECT request_id, CASE WHEN trim(coalesce(session_id, '')) = '' THEN 'no_session_id' WHEN len(list_filter(map_values(coalesce(sections, MAP {})), lambda v: trim(coalesce(v, '')) <> '')) = 0 THEN 'no_sections' ELSE '' END AS reason FROM req")
def t2_buffer_decision(spark: SparkSession, d: str) -> DataFrame:
    """Why a turn is not kept for its session; blank if it is. Filled sections make a turn substantive."""
    return S.requests(spark, d).select("request_id", W.buffer_reason(F.col("session_id"), F.col("sections"), F.lit("")).alias("reason"))


@R.add(", r AS (SELECT * FROM req WHERE session_id IS NOT NULL AND trim(session_id) <> ''), s AS (SELECT session_id, key AS k, arg_max(value, (turn_index, request_id)) AS v FROM (SELECT session_id, turn_index, request_id, unnest(map_entries(sections), recursive := true) FROM r) WHERE trim(value) <> '' GROUP BY ALL) SELECT session_id, string_agg(k || '=' || md5(v), ',' ORDER BY k) AS capsule, count(*) AS thickness FROM s GROUP BY session_id")
def t4_capsules(spark: SparkSession, d: str) -> DataFrame:
    """A session's buffers as one capsule: of each section the text of its last turn."""
    r = S.requests(spark, d).where("session_id is not null and trim(session_id) <> ''")
    c = W.capsules(r, "session_id", "turn_index", "request_id", "sections")
    return c.select("session_id", F.array_join(F.transform("sections", lambda s: F.concat(s["k"], F.lit("="), F.md5(s["v"]))), ",").alias("capsule"), "thickness")


# ---- the write path as a whole, index builds, reviews

_INGEST_SQL = r"""
, gate AS (SELECT *, CASE WHEN content IS NULL THEN 'malformed_node' WHEN trim(content) = '' THEN 'empty_content' WHEN regexp_matches(content, 'sk-[A-Za-z0-9]{16,}') THEN 'secret' ELSE 'ok' END AS bad FROM req),
act AS (SELECT *, CASE WHEN bad <> 'ok' OR length(trim(content)) > 3000 THEN 'rejected' WHEN lower(trim(coalesce(dedupe, ''))) = 'reject' AND dedupe_target IS NOT NULL THEN 'duplicate' WHEN lower(trim(coalesce(dedupe, ''))) = 'merge' AND dedupe_target IS NOT NULL THEN 'merged' ELSE 'stored' END AS action,
  CASE WHEN coalesce(nullif(trim(type), ''), 'memory') IN ('memory', 'task', 'plan') THEN coalesce(epoch_us(event_time) / 1e6, 1790000000.0) END AS valid FROM gate),
new AS (SELECT request_id, (SELECT max(id) FROM cur) + row_number() OVER (ORDER BY request_id) AS id FROM act WHERE action = 'stored')
"""


@R.add(_INGEST_SQL + "SELECT a.request_id, action, CASE WHEN action = 'stored' THEN n.id WHEN action <> 'rejected' THEN dedupe_target END AS node_id, CASE WHEN bad = 'ok' AND action = 'rejected' THEN 'too_long' ELSE bad END AS issue, coalesce(importance, 0.5) AS importance, coalesce(nullif(lower(trim(domain)), ''), 'general') AS domain, valid AS valid_at FROM act a LEFT JOIN new n USING (request_id)")
def r39_ingest(spark: SparkSession, d: str) -> DataFrame:
    return W.ingested(S.requests(spark, d), S.nodes(spark, d), now=NOW, most=3_000)[0]


@R.add(_INGEST_SQL + r""", named AS (SELECT a.request_id, n.id AS nid, valid, TRY_CAST(unnest(regexp_extract_all(coalesce(replaces, ''), '\d+')) AS BIGINT) AS id FROM act a JOIN new n USING (request_id)) SELECT id, arg_min(nid, request_id) AS "by", coalesce(arg_min(struct_pack(v := valid), request_id).v, 1790000000.0) AS invalid_at FROM named WHERE id IN (SELECT id FROM cur) GROUP BY id""")
def r39_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that a batch of ingest statements makes outdated."""
    return W.ingested(S.requests(spark, d), S.nodes(spark, d), now=NOW, most=3_000)[1]


_OLD_INDEX = ", old AS (SELECT node_id AS path, min(updated_at) AS mtime FROM node_chunks WHERE node_id % 7 <> 0 GROUP BY 1), new AS (SELECT node_id AS path, max(updated_at) AS mtime FROM node_chunks WHERE node_id % 5 <> 0 GROUP BY 1)"


@R.add(_OLD_INDEX + " SELECT path, action FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'orphan' WHEN n.path % 11 = 0 THEN CASE WHEN o.path IS NOT NULL THEN 'retire' END WHEN o.path IS NULL THEN 'insert' WHEN abs(o.mtime - n.mtime) <= 1 THEN 'skip' ELSE 'update' END AS action FROM old o FULL JOIN new n ON o.path = n.path) WHERE action IS NOT NULL")
def s11_index_plan(spark: SparkSession, d: str) -> DataFrame:
    """What an index build does with each file: nodes stand for files, their oldest and newest chunks for what is indexed and what is there."""
    c = table(spark, d, "node_chunks").select(F.col("node_id").alias("path"), "updated_at")
    old = c.where("path % 7 <> 0").groupBy("path").agg(F.min("updated_at").alias("mtime"))
    new = c.where("path % 5 <> 0").groupBy("path").agg(F.max("updated_at").alias("mtime"))
    return I.plan(old, new, retired=F.col("path") % 11 == 0)


@R.add(""", m AS (SELECT node_id AS path, chunk_idx AS member, row_number() OVER (ORDER BY node_id, chunk_idx) AS id FROM ch WHERE chunk_idx % 3 <> 1), n AS (SELECT node_id AS path, chunk_idx AS member FROM ch WHERE chunk_idx % 4 <> 2),
j AS (SELECT coalesce(m.path, n.path) AS path, coalesce(m.member, n.member) AS member, m.id, n.path IS NOT NULL AS new FROM (SELECT * FROM m WHERE path IN (SELECT path FROM n)) m FULL JOIN n ON m.path = n.path AND m.member = n.member)
SELECT path, member, id, CASE WHEN new THEN 'update' ELSE 'delete' END AS action FROM j WHERE id IS NOT NULL UNION ALL SELECT path, member, (SELECT max(id) FROM m) + row_number() OVER (ORDER BY path, member), 'insert' FROM j WHERE id IS NULL""")
def s11_upserted_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of files keep their ids when the files are built again."""
    c = S.chunks(spark, d).select(F.col("node_id").alias("path"), F.col("chunk_idx").alias("member"))
    old = global_place(c.where("member % 3 <> 1"), "path", "member", name="id")
    return I.upserted_members(old, c.where("member % 4 <> 2"))


@R.add("SELECT node_id, chunk_idx, CASE WHEN v.vector IS NULL OR len(v.vector) <> v.dim OR len(list_filter(v.vector, lambda x: x <> 0)) = 0 THEN 'missing' ELSE 'stale' END AS reason FROM ch WHERE trim(coalesce(v.chunk_text, '')) <> '' AND (reason = 'missing' OR coalesce(v.model, '') <> 'local:memvec-base') AND NOT (node_id % 10 = 0)")
def r48_to_embed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose vectors are still to be made for one model, after a run that broke off had done every tenth node."""
    c = S.chunks(spark, d)
    return I.to_embed(c, "local:memvec-base", c.where("node_id % 10 = 0"))


@R.add(f", h AS (SELECT 1000 + id AS id, {_SIM} AS s FROM vec ORDER BY s DESC, id LIMIT 60) SELECT h.id, round(s, 6) AS score FROM h JOIN cur c ON c.id = h.id WHERE coalesce(c.type, '') <> 'kb_chunk' AND c.status <> 'outdated' ORDER BY s DESC, h.id LIMIT 8")
def r12_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Memories only, what is not outdated, the first in the order of the candidates."""
    h = _hits(spark, d).orderBy(F.desc("score"), "id").limit(60).join(S.nodes(spark, d).select("id", "type", "status"), "id")
    return h.where(E.in_scope(F.col("type"), "memory") & (F.col("status") != "outdated")).orderBy(F.desc("score"), "id").limit(8).select("id", F.round("score", 6).alias("score"))


@R.add("SELECT 'stale' AS list, id FROM (SELECT id FROM cur WHERE status = 'active' AND created_at < 1770000000 ORDER BY id LIMIT 30) UNION ALL SELECT 'low', id FROM (SELECT id FROM cur WHERE importance < 0.4 ORDER BY id LIMIT 20) UNION ALL SELECT 'outdated', id FROM (SELECT id FROM cur WHERE status = 'outdated' ORDER BY id LIMIT 20) UNION ALL SELECT 'never_hit', id FROM (SELECT id FROM cur WHERE hit_count = 0 ORDER BY id LIMIT 20)")
def o11_review_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first nodes of each list of a review."""
    n = S.nodes(spark, d)
    st = F.col("status")
    lists = (("stale", (st == "active") & (F.col("created_at") < 1_770_000_000), 30), ("low", F.col("importance") < 0.4, 20), ("outdated", st == "outdated", 20), ("never_hit", F.col("hit_count") == 0, 20))
    parts = [n.where(c).select("id").orderBy("id").limit(k).select(F.lit(name).alias("list"), "id") for name, c, k in lists]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@R.add(_TASKS_SQL + r"SELECT id, NOT (contains(content, '未完成') OR contains(content, '进行中') OR contains(content, '待启动') OR contains(content, '计划中') OR contains(content, '等发布') OR contains(content, '待发布') OR contains(content, '未启动')) AND (regexp_matches(replace(content, '未已完成', ''), '已完成') OR regexp_matches(content, '完成】\s*$') OR regexp_matches(content, '^\s*【[^【\n]*完成')) OR status IN ('completed', 'done') AS finished FROM (SELECT id, status, CASE WHEN note THEN '【全部完成】' ELSE '' END || content AS content FROM st)")
def f25_finished(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d).withColumn("content", F.concat(F.when(F.col("kind") == "handoff", "【全部完成】").otherwise(""), "content"))
    return t.select("id", K.finished(F.col("status"), F.col("content")).alias("finished"))


QUERIES, SQL = R.queries, R.sql
