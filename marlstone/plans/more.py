"""Further operators of the store: gates, channels, expansions, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import conflict as C
from marlstone.operators import fulltext as T
from marlstone.operators import graph as G
from marlstone.operators import retrieval as X
from marlstone.operators import vector as V
from marlstone.plans.registry import VIEWS, Registry
from marlstone.plans.relations import GRAMS_SQL, _query
from marlstone.runtime import table
from marlstone.sources import store as S

R = Registry(VIEWS)
NOW = 1_790_000_000.0
_SIM = "list_cosine_similarity(v, (SELECT v FROM vec ORDER BY id LIMIT 1))"



@R.add("SELECT id FROM cur WHERE coalesce(type, '') = 'kb_chunk'")
def f10_scope(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where(E.in_scope(F.col("type"), "kb")).select("id")


@R.add("SELECT status, count(*) AS n FROM cur WHERE status NOT IN ('outdated', 'archived') GROUP BY 1")
def f13_retrievable(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).where(E.retrievable(F.col("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT id, valid_at IS NULL OR (valid_at < 1765000000 AND 1760000000 < coalesce(invalid_at, 'infinity'::DOUBLE)) AS meets FROM cur")
def f16_overlap(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", E.overlap(F.col("valid_at"), F.col("invalid_at"), F.lit(1_760_000_000.0), F.lit(1_765_000_000.0)).alias("meets"))


@R.add(r"SELECT request_id, c = '' OR starts_with(c, '/') OR regexp_matches(c, '(?i)^(yes|no|ok|okay|sure|thanks|thank you|y|n|yep|nope|yeah|nah|hi|hey|hello|yo|sup|continue|go ahead|do it|proceed|got it|cool|nice|great|done|next|lgtm|k)[[:punct:]\s‘’“”—–…\x{00a0}]*$') AS trivial FROM (SELECT request_id, regexp_replace(coalesce(content, ''), '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g') AS c FROM req)")
def f28_trivial(spark: SparkSession, d: str) -> DataFrame:
    return S.requests(spark, d).select("request_id", E.trivial(F.col("content")).alias("trivial"))


@R.add("SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.id < b.id AND a.label = b.label AND list_cosine_similarity(a.v, b.v) > 0.42")
def j10_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Of one kind and above the threshold, not at it."""
    return V.similar_rows(S.vectors(spark, d), least=0.42, gate="label").where("score > 0.42").select("a", "b")


@R.add("SELECT src, dst FROM ed WHERE label = 'SKILL_RELATED_TO' UNION SELECT dst, src FROM ed WHERE label = 'SKILL_RELATED_TO'")
def j16_both_ways(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d).where("label = 'SKILL_RELATED_TO'")
    return e.select("src", "dst").union(e.select("dst", "src")).distinct()


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node_id FROM node_chunks)")
def j23_not_indexed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "node_chunks").select(F.col("node_id").alias("doc_id")), "doc_id", "left_anti")


@R.add("""
, u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), one AS (SELECT b AS id FROM u WHERE a = 'index/home.md')
SELECT id FROM (SELECT id FROM one UNION SELECT u.b FROM u JOIN one ON u.a = one.id) WHERE id <> 'index/home.md'""")
def j27_reach_both_ways(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight")
    return G.neighbours(e.union(back), "index/home.md", 2).select("id").where("id <> 'index/home.md'")


@R.add(f"""SELECT node_id AS id, round(max(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), (SELECT v FROM vec ORDER BY id LIMIT 1))), 6) AS score FROM ch
WHERE v.model = 'ollama:memvec-base' AND v.dim = 64 AND len(v.vector) = 64 AND len(list_filter(v.vector, lambda x: x <> 0)) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def r10_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    best = X.best_chunk(S.chunks(spark, d), _query(spark, d), "ollama:memvec-base")
    return best.select("id", F.round("chunk_score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@R.add("SELECT count(*) FILTER (status = 'active' AND created_at IS NOT NULL AND created_at < 1770000000) AS stale, count(*) FILTER (importance < 0.4) AS low, count(*) FILTER (status = 'outdated') AS outdated, count(*) FILTER (hit_count = 0) AS never_hit FROM cur")
def a13_review(spark: SparkSession, d: str) -> DataFrame:
    st = F.col("status")
    return S.nodes(spark, d).agg(F.count_if((st == "active") & (F.col("created_at") < 1_770_000_000)).alias("stale"), F.count_if(F.col("importance") < 0.4).alias("low"), F.count_if(st == "outdated").alias("outdated"), F.count_if(F.col("hit_count") == 0).alias("never_hit"))


@R.add("""
, g AS (SELECT qid, min(x) AS g FROM (SELECT qid, unnest(gold_ids) AS x FROM temporal_state) GROUP BY qid), s AS (SELECT qid, min(x) AS s FROM (SELECT qid, unnest(stale_ids) AS x FROM temporal_state) GROUP BY qid)
SELECT g.qid, g.g < s.s AS gold_first FROM g JOIN s ON g.qid = s.qid""")
def a23_twins(spark: SparkSession, d: str) -> DataFrame:
    """Does the best place of a gold id come before that of any stale one (places: by id)?"""
    t = table(spark, d, "temporal_state")
    g = t.select("qid", F.explode("gold_ids").alias("x")).groupBy("qid").agg(F.min("x").alias("g"))
    s = t.select("qid", F.explode("stale_ids").alias("x")).groupBy("qid").agg(F.min("x").alias("s"))
    return g.join(s, "qid").select("qid", (F.col("g") < F.col("s")).alias("gold_first"))


@R.add("""SELECT id, other, r AS rank FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM (
  SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.id <> b.id) WHERE s >= 0.4) WHERE r <= 6""")
def w2_top_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return V.neighbours(V.similar_rows(S.vectors(spark, d), least=0.4), 6).select("id", "other", F.col("rank").cast("bigint").alias("rank"))


@R.add("SELECT session_id, request_id, next_id FROM (SELECT session_id, request_id, received_at AS t, lead(request_id) OVER w AS next_id, lead(received_at) OVER w AS nt FROM req WINDOW w AS (PARTITION BY session_id ORDER BY received_at, request_id)) WHERE next_id IS NOT NULL AND epoch_us(nt) - epoch_us(t) <= 86400000000")
def w4_gap_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("received_at", "request_id")
    r = S.requests(spark, d).select("session_id", "request_id", "received_at").withColumn("next_id", F.lead("request_id").over(w)).withColumn("nt", F.lead("received_at").over(w))
    return r.where(F.col("next_id").isNotNull() & (F.timestamp_diff("MICROSECOND", F.col("received_at").cast("timestamp_ntz"), F.col("nt").cast("timestamp_ntz")) <= 86_400_000_000)).select("session_id", "request_id", "next_id")


@R.add("SELECT id, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 9) AS score FROM (SELECT id, row_number() OVER (PARTITION BY type ORDER BY importance DESC, id) AS r1, row_number() OVER (PARTITION BY type ORDER BY hit_count DESC, id) AS r2 FROM cur WHERE type IS NOT NULL)")
def w12_two_rankings(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("type")
    n = S.nodes(spark, d).where("type is not null").withColumn("r1", F.row_number().over(by.orderBy(F.desc("importance"), "id"))).withColumn("r2", F.row_number().over(by.orderBy(F.desc("hit_count"), "id")))
    return n.select("id", F.round(F.lit(1.0) / (60 + F.col("r1")) + F.lit(1.0) / (60 + F.col("r2")), 9).alias("score"))


@R.add(f"SELECT id, round({_SIM}, 4) AS score FROM vec ORDER BY 2 DESC, 1 LIMIT 15")
def o1_rounded_first(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query(spark, d)])
    return S.vectors(spark, d).select("id", F.round(E.cosine(F.col("v"), q), 4).alias("score")).orderBy(F.desc("score"), "id").limit(15)


@R.add("SELECT dst AS id, max(weight) AS weight FROM ed WHERE src = (SELECT p FROM hub) AND weight >= 0.5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def o7_heaviest_neighbours(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    return G.neighbours(S.edges(spark, d), start, 1, least=0.5, limit=10).select("id", "weight")


@R.add("SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM vec a JOIN vec b ON a.id < b.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, 1, 2 LIMIT 10")
def o15_best_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.similar_rows(S.vectors(spark, d), least=0.4).orderBy(F.desc("score"), "a", "b").limit(10).withColumn("score", F.round("score", 6))


@R.add("SELECT DISTINCT label, src FROM ed")
def u5_distinct(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).select("label", "src").dropDuplicates()


@R.add(GRAMS_SQL.replace("QUESTIONS", "SELECT item_id AS q, query FROM eval_items") + "SELECT q AS item_id, i, g FROM asked")
def r15_query_grams(spark: SparkSession, d: str) -> DataFrame:
    """The grams of every question, in their order."""
    return table(spark, d, "eval_items").select("item_id", F.posexplode(T.query_grams(F.col("query"))).alias("i", "g")).select("item_id", F.col("i").cast("bigint").alias("i"), "g")


@R.add("SELECT item_id, CAST(unnest(list_transform(range(5), lambda i: CASE WHEN n <= 5 THEN CASE WHEN i < n THEN i END ELSE round_even(i * (n - 1) / 4.0, 0) END)) AS BIGINT) AS place FROM (SELECT item_id, length(query) AS n FROM eval_items)")
def r16_even_places(spark: SparkSession, d: str) -> DataFrame:
    """Five characters' places of every question, evenly spread; shorter questions have a null for each place they lack."""
    places = T.even_sample(F.sequence(F.lit(0), F.char_length("query") - 1), 5)
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(places, i))
    rows = F.when(F.char_length("query") > 0, five).otherwise(F.array_repeat(F.lit(None).cast("int"), 5))
    return table(spark, d, "eval_items").select("item_id", F.explode(rows).alias("place")).withColumn("place", F.col("place").cast("bigint"))


_TEXT = "the merge gate"


@R.add(f"""
, sem AS (SELECT 1 + id AS id, row_number() OVER (ORDER BY {_SIM} DESC, id) - 1 AS place FROM vec QUALIFY place < 30),
txt AS (SELECT doc_id AS id, (length(lower(text)) - length(replace(lower(text), 'gate', ''))) / 4.0 AS s FROM documents WHERE contains(lower(text), 'gate') ORDER BY s DESC, id LIMIT 30),
tr AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS place FROM txt)
SELECT id, round(sum(p), 9) AS score FROM (SELECT id, 1.0 / (60 + place) AS p FROM sem UNION ALL SELECT id, 0.1 / (60 + place) FROM tr) WHERE id IN (SELECT doc_id FROM documents) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10""")
def r18_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = S.vectors(spark, d).select((F.col("id") + 1).alias("id"), "v")
    return X.hybrid(rows, docs, _query(spark, d), T.search(docs, "gate", 30).select("id", "score"), wide=30, limit=10).withColumn("score", F.round("score", 9))


@R.add("SELECT request_id, CASE WHEN trim(coalesce(replaces, '')) <> '' THEN 'replace' WHEN lower(dedupe) = 'reject' AND dedupe_target IS NOT NULL THEN 'reject' WHEN lower(dedupe) = 'merge' AND dedupe_target IS NOT NULL THEN 'merge' ELSE 'insert' END AS verdict FROM req")
def r29_dedupe_gate(spark: SparkSession, d: str) -> DataFrame:
    named = F.col("dedupe_target").isNotNull()
    how = F.lower("dedupe")
    verdict = F.when(F.trim(F.coalesce("replaces", F.lit(""))) != "", "replace").when((how == "reject") & named, "reject").when((how == "merge") & named, "merge").otherwise("insert")
    return S.requests(spark, d).select("request_id", verdict.alias("verdict"))


@R.add("SELECT id, CASE WHEN type IN ('memory','task','plan') THEN coalesce(valid_at, created_at) ELSE valid_at END AS valid_at FROM cur")
def r31_stamp(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", F.when(F.col("type").isin("memory", "task", "plan"), F.coalesce("valid_at", "created_at")).otherwise(F.col("valid_at")).alias("valid_at"))


@R.add("""
, n AS (SELECT id - 1000 AS k, type, domain, valid_at, invalid_at FROM cur),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > 0.4)
SELECT p.a, p.b, CASE WHEN s > 0.5 AND (x.valid_at IS NULL OR y.valid_at IS NULL OR (x.valid_at < coalesce(y.invalid_at, 'infinity'::DOUBLE) AND y.valid_at < coalesce(x.invalid_at, 'infinity'::DOUBLE))) THEN 'supersede' ELSE 'related' END AS verdict
FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE x.type = y.type AND x.type <> 'kb_chunk' AND (x.domain = y.domain OR x.domain = 'general' OR y.domain = 'general')""")
def r32_conflict_classes(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d).select((F.col("id") - 1000).alias("id"), "type", "domain", "valid_at", "invalid_at")
    p = C.with_ends(V.similar_rows(S.vectors(spark, d), least=0.4), n, ["type", "domain", "valid_at", "invalid_at"])
    p = p.where((F.col("score") > 0.4) & (F.col("a_type") == F.col("b_type")) & (F.col("a_type") != "kb_chunk") & C.same_scope(F.col("a_domain"), F.col("b_domain")))
    meets = E.overlap(F.col("a_valid_at"), F.col("a_invalid_at"), F.col("b_valid_at"), F.col("b_invalid_at"))
    return p.select("a", "b", C.verdict(F.col("score"), meets, 0.4, 0.5).alias("verdict"))


@R.add("SELECT type, v[1 + CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER)] AS p50, v[1 + CAST(round_even(0.9 * (len(v) - 1), 0) AS INTEGER)] AS p90 FROM (SELECT type, list(importance ORDER BY importance) AS v FROM cur WHERE type IS NOT NULL GROUP BY type)")
def r46_nearest_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles that are values of the data: the nearest place, halves to even, found by place and not from a collected list."""
    w = Window.partitionBy("type")
    n = S.nodes(spark, d).where("type is not null").withColumn("i", F.row_number().over(w.orderBy("importance", "id")) - 1)
    n = n.join(n.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type")
    at = lambda p: F.max(F.when(F.col("i") == F.bround(p * (F.col("n") - 1), 0).cast("int"), F.col("importance")))
    return n.groupBy("type").agg(at(F.lit(0.5)).alias("p50"), at(F.lit(0.9)).alias("p90"))


@R.add("SELECT e.dst AS id, round(max(0.5 * e.weight), 4) AS score FROM ed e WHERE e.src IN (SELECT dst FROM ed WHERE src = (SELECT p FROM hub)) GROUP BY 1")
def g15_passed_scores(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    e = S.edges(spark, d)
    seeds = e.where(F.col("src") == start).select(F.col("dst").alias("src")).distinct()
    return e.join(seeds, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.round(F.max(0.5 * F.col("weight")), 4).alias("score"))


@R.add(f"""
, seeds AS (SELECT 1000 + id AS id FROM vec ORDER BY {_SIM} DESC, id LIMIT 20)
SELECT l.dst AS id, count(*) AS n FROM flinks l JOIN seeds s ON l.src = s.id GROUP BY 1""")
def g12_expand(spark: SparkSession, d: str) -> DataFrame:
    """Vector seeds, then one hop."""
    seeds = V.nearest(S.vectors(spark, d), _query(spark, d), 20).select((F.col("id") + 1000).alias("src"))
    return S.fact_links(spark, d).join(seeds, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = R.queries, R.sql
