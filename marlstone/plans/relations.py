"""Joins, graph operators, conflicts, retrieval, quality metrics and text functions over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import conflict as C
from marlstone.operators import fulltext as T
from marlstone.operators import graph as G
from marlstone.operators import quality as Q
from marlstone.operators import retrieval as X
from marlstone.operators import vector as V
from marlstone.operators.ranking import global_lead
from marlstone.plans.registry import VIEWS, Registry
from marlstone.runtime import table
from marlstone.sources import store as S

R = Registry(VIEWS)
NOW = 1_790_000_000.0
HOME = "index/home.md"


def _query(spark: SparkSession, d: str) -> list[float]:
    """The first embedding stands for an embedded question."""
    return [float(x) for x in S.vectors(spark, d).orderBy("id").limit(1).first()["v"]]


_SIM = "list_cosine_similarity(v, (SELECT v FROM vec ORDER BY id LIMIT 1))"

# ---- joins

@R.add("SELECT a.src AS a, a.dst AS b FROM ed a WHERE a.label = 'NEXT' AND a.weight > 0.5")
def j1_match(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).where("label = 'NEXT' and weight > 0.5").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@R.add(", c AS (SELECT src, dst FROM ed WHERE label = 'CAUSES') SELECT src AS a, dst AS b FROM c UNION SELECT x.src, y.dst FROM c x JOIN c y ON x.dst = y.src")
def j2_one_or_two_hops(spark: SparkSession, d: str) -> DataFrame:
    c = S.edges(spark, d).where("label = 'CAUSES'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    two = c.join(c.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    return c.union(two).distinct()


@R.add(f"""
, hv AS (SELECT id, list_cosine_similarity(v, (SELECT v FROM vec ORDER BY id LIMIT 1)) AS s FROM vec),
main AS (SELECT 1000 + id AS id, s AS score FROM hv WHERE s > 0.1),
cs AS (SELECT node_id AS id, max(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), (SELECT v FROM vec ORDER BY id LIMIT 1))) AS c FROM ch
  WHERE v.model = 'local:memvec-base' AND v.dim = 64 AND len(v.vector) = 64 AND len(list_filter(v.vector, lambda x: x <> 0)) > 0 GROUP BY 1)
SELECT coalesce(m.id, c.id) AS id, round(greatest(coalesce(m.score, 0), coalesce(c.c, 0)), 6) AS score FROM main m FULL JOIN cs c ON m.id = c.id""")
def j3_merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    q = _query(spark, d)
    main = S.vectors(spark, d).select((F.col("id") + 1000).alias("id"), E.cosine(F.col("v"), F.array(*[F.lit(x) for x in q])).alias("score")).where("score > 0.1")
    return X.merge_chunks(main, X.best_chunk(S.chunks(spark, d), q, "local:memvec-base")).withColumn("score", F.round("score", 6))


@R.add(f"""
, sem AS (SELECT id, row_number() OVER (ORDER BY {_SIM} DESC, id) - 1 AS place FROM vec QUALIFY place < 30),
imp AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS place FROM embeddings QUALIFY place < 30)
SELECT id, round(sum(p), 9) AS score FROM (SELECT id, 1.0 / (60 + place) AS p FROM sem UNION ALL SELECT id, 0.1 / (60 + place) FROM imp) GROUP BY id""")
def j4_rrf(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    sem = X.ranked(V.nearest(v, _query(spark, d), 30).select("id", "score"))
    other = X.ranked(v.select("id", F.col("label").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(30))
    return X.rrf([(sem, 1.0), (other, 0.1)]).withColumn("score", F.round("score", 9))


@R.add(f"""
, sem AS (SELECT id, {_SIM} AS score FROM vec ORDER BY score DESC, id LIMIT 30), other AS (SELECT vec_id AS id FROM embeddings WHERE label < 5)
SELECT s.id, round(score, 6) AS score FROM sem s LEFT JOIN other o ON s.id = o.id ORDER BY o.id IS NULL, s.score DESC, s.id LIMIT 10""")
def j5_cascade(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    sem = V.nearest(v, _query(spark, d), 30).select("id", "score")
    return X.cascade(sem, v.where("label < 5").select("id"), 10).withColumn("score", F.round("score", 6))


@R.add("""
, hits AS (SELECT dst AS id FROM ed WHERE src = (SELECT p FROM hub) UNION SELECT (SELECT p FROM hub))
SELECT id, via, weight FROM (SELECT e.dst AS id, e.src AS via, e.weight, row_number() OVER (PARTITION BY e.dst ORDER BY e.weight DESC, e.src, e.label) AS r FROM ed e JOIN hits h ON e.src = h.id WHERE e.dst NOT IN (SELECT id FROM hits)) WHERE r = 1""")
def j6_neighbour_region(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    e = S.edges(spark, d)
    hits = e.where(F.col("src") == start).select(F.col("dst").alias("id")).union(spark.createDataFrame([(start,)], "id string")).distinct()
    around = e.join(hits, e["src"] == hits["id"]).select(F.col("dst").alias("id"), F.col("src").alias("via"), "weight", "label").join(hits, "id", "left_anti")
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "via", "label")
    return around.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "via", "weight")


@R.add("SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM vec a JOIN vec b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.5")
def j8_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.similar_rows(S.vectors(spark, d), least=0.5).withColumn("score", F.round("score", 6))


@R.add("""SELECT a.id AS a, b.id AS b, CASE WHEN list_cosine_similarity(a.v, b.v) > 0.55 THEN 'supersede' ELSE 'related' END AS verdict
FROM vec a JOIN vec b ON a.id < b.id AND a.label = b.label AND list_cosine_similarity(a.v, b.v) > 0.45""")
def j9_conflicts(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    pairs = C.with_ends(V.similar_rows(v, least=0.45, gate="label"), v, ["label"])
    return pairs.select("a", "b", C.verdict(F.col("score"), F.lit(True), 0.45, 0.55).alias("verdict")).where("verdict <> 'ignore'")


@R.add("""SELECT count(*) AS n, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(max(s), 6) AS top, round(avg(CASE WHEN s > 0.6 THEN 1 ELSE 0 END), 6) AS over_06
FROM (SELECT list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.id < b.id) WHERE s >= 0.4""")
def j11_similarity_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return V.similar_rows(S.vectors(spark, d), least=0.4).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(s, 0.5), 6).alias("p50"), F.round(F.percentile(s, 0.9), 6).alias("p90"), F.round(F.max(s), 6).alias("top"), F.round(F.avg((s > 0.6).cast("int")), 6).alias("over_06"))


@R.add("""
, f AS (SELECT id, type, domain, valid_at AS s, invalid_at AS e FROM cur WHERE type IN ('memory','task','plan') AND valid_at IS NOT NULL AND (invalid_at IS NULL OR invalid_at > valid_at))
SELECT a.id AS a, b.id AS b, a.type, a.domain FROM f a JOIN f b ON a.type = b.type AND a.domain = b.domain AND a.id < b.id AND a.s < coalesce(b.e, 'infinity'::DOUBLE) AND b.s < coalesce(a.e, 'infinity'::DOUBLE)""")
def j12_overlaps(spark: SparkSession, d: str) -> DataFrame:
    f = S.nodes(spark, d).where("type in ('memory','task','plan')")
    return C.overlaps(f.select("id", "type", "domain", "valid_at", "invalid_at"), ["type", "domain"], "valid_at", "invalid_at", 30 * 86_400.0)


@R.add("SELECT c.id AS src, l.dst FROM (SELECT id, unnest(linked_from) AS dst FROM cur) l JOIN cur c ON c.id = l.id JOIN cur t ON t.id = l.dst WHERE t.type IN ('kb_chunk','novel_chunk','skill_chunk') AND l.dst <> c.id GROUP BY ALL")
def j13_linked_from(spark: SparkSession, d: str) -> DataFrame:
    n = S.nodes(spark, d)
    links = n.select(F.col("id").alias("src"), F.explode("linked_from").alias("dst")).where("src <> dst").distinct()
    return links.join(n.where(F.col("type").isin(*S.SLICES)).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


@R.add("""
, names AS (SELECT DISTINCT lower(trim(character_name)) AS name FROM cur WHERE length(trim(character_name)) >= 2)
SELECT c.id, n.name FROM cur c JOIN names n ON contains(lower(c.content), n.name)""")
def j14_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names of two or more characters of any script anywhere in contents: an equi-join on their first two characters, then the whole name."""
    n = S.nodes(spark, d)
    names = n.select(F.lower(F.trim("character_name")).alias("name")).where("char_length(name) >= 2").distinct().withColumn("gram", F.substring("name", 1, 2))
    texts = n.select("id", F.lower("content").alias("content"))
    grams = texts.select("id", F.explode(F.array_distinct(T.gram_array(F.col("content"), 2))).alias("gram"))
    held = grams.join(names, "gram").select("id", "name")
    return held.join(texts, "id").where(F.contains("content", "name")).select("id", "name")


@R.add(r"""
, pages AS (SELECT src AS p FROM ed UNION SELECT dst FROM ed), named AS (SELECT p, regexp_extract(p, '([^/]+?)(\.md)?$', 1) AS name FROM pages),
texts AS (SELECT src, string_agg('see [[' || regexp_extract(dst, '([^/]+?)(\.md)?$', 1) || '|there]]', ' ') AS text FROM ed WHERE label = 'WIKI_LINK' GROUP BY src),
links AS (SELECT src, unnest(regexp_extract_all(text, '\[\[([^\]|#]+)', 1)) AS name FROM texts)
SELECT DISTINCT l.src, n.p AS dst FROM links l JOIN named n USING (name) WHERE n.p <> l.src""")
def j15_wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """[[name]] in a page's text, to every page whose file has that name, once a pair; the texts are written from the WIKI_LINK edges."""
    e = S.edges(spark, d)
    base = lambda c: F.regexp_extract(c, r"([^/]+?)(\.md)?$", 1)
    texts = e.where("label = 'WIKI_LINK'").groupBy("src").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("see [["), base("dst"), F.lit("|there]]")))).alias("text"))  # one page's text
    named = e.select(F.col("src").alias("dst")).union(e.select("dst")).distinct().withColumn("name", base("dst"))
    links = texts.select("src", F.explode(E.wiki_names(F.col("text"))).alias("name"))
    return links.join(named, "name").where("dst <> src").select("src", "dst").distinct()


@R.add("""
SELECT src, dst FROM (SELECT event_id AS src, user_id AS u, epoch_us(ts) AS t, lead(event_id) OVER w AS dst, lead(user_id) OVER w AS nu, lead(epoch_us(ts)) OVER w AS nt FROM events WINDOW w AS (ORDER BY ts, event_id))
WHERE nu = u AND nt - t <= 1800000000""")
def j17_follows(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the global order of time that belong together and are at most half an hour apart."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    e = e.withColumn("t", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))
    n = global_lead(e, ["event_id", "user_id", "t"], "t", "event_id")
    return n.where("next_user_id = user_id and next_t - t <= 1800000000").select(F.col("event_id").alias("src"), F.col("next_event_id").alias("dst"))


@R.add("SELECT node_id, chunk_idx, first FROM (SELECT node_id, chunk_idx, min(chunk_idx) OVER (PARTITION BY node_id) AS first FROM ch) WHERE chunk_idx <> first")
def j19_part_of(spark: SparkSession, d: str) -> DataFrame:
    """Every member of a file to its first member; files are nodes, members their chunks."""
    c = S.chunks(spark, d).select("node_id", "chunk_idx")
    return c.join(c.groupBy("node_id").agg(F.min("chunk_idx").alias("first")), "node_id").where("chunk_idx <> first")


@R.add(", cand AS (SELECT dst AS src, src AS dst, label FROM ed WHERE label IN ('RELATED_TO', 'WIKI_LINK', 'NEXT') UNION SELECT src, src, label FROM ed UNION SELECT src, dst, label FROM ed WHERE weight > 0.5) SELECT DISTINCT src, dst, label FROM cand c WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.src = c.src AND e.dst = c.dst AND e.label = c.label)")
def j20_new_edges(spark: SparkSession, d: str) -> DataFrame:
    """Of candidate edges (ways back, loops, known ones) those that are neither loops nor there already."""
    e = S.edges(spark, d)
    cand = e.where("label in ('RELATED_TO', 'WIKI_LINK', 'NEXT')").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label").union(e.select("src", "src", "label")).union(e.where("weight > 0.5").select("src", "dst", "label"))
    return cand.where("src <> dst").distinct().join(e, ["src", "dst", "label"], "left_anti")


@R.add("SELECT coalesce(c.id, k.node_id) AS id, CASE WHEN c.id IS NULL THEN 'stale' ELSE 'missing' END AS state FROM cur c FULL JOIN (SELECT DISTINCT node_id FROM ch) k ON c.id = k.node_id WHERE c.id IS NULL OR k.node_id IS NULL")
def j21_index_drift(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without chunks, and chunks of nodes that are gone: two anti-joins."""
    n, k = S.nodes(spark, d).select("id"), table(spark, d, "node_chunks").select(F.col("node_id").alias("id")).distinct()
    return n.join(k, "id", "left_anti").withColumn("state", F.lit("missing")).union(k.join(n, "id", "left_anti").withColumn("state", F.lit("stale")))


@R.add("SELECT * FROM ed WHERE src IN (SELECT dst FROM ed WHERE label = 'PART_OF') AND dst IN (SELECT dst FROM ed WHERE label = 'PART_OF')")
def j22_both_ends(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d)
    kept = e.where("label = 'PART_OF'").select(F.col("dst").alias("k")).distinct()
    return e.join(kept, e["src"] == kept["k"], "left_semi").join(kept, e["dst"] == kept["k"], "left_semi")


@R.add("SELECT n AS id, way, other FROM (SELECT src AS n, 'replaced' AS way, dst AS other FROM flinks UNION ALL SELECT dst, 'replaced_by', src FROM flinks) WHERE n IN (SELECT id FROM cur)")
def j25_fact_history(spark: SparkSession, d: str) -> DataFrame:
    f = S.fact_links(spark, d)
    both = f.select(F.col("src").alias("id"), F.lit("replaced").alias("way"), F.col("dst").alias("other")).union(f.select("dst", F.lit("replaced_by"), "src"))
    return both.join(S.nodes(spark, d).select("id"), "id", "left_semi")


@R.add("""
, first AS (SELECT src, min(dst) AS dst FROM flinks GROUP BY src),
walk AS (SELECT src AS id, 0 AS step, src AS node, [src] AS seen FROM first
  UNION ALL SELECT w.id, w.step + 1, f.dst, list_append(w.seen, f.dst) FROM walk w JOIN first f ON f.src = w.node WHERE NOT list_contains(w.seen, f.dst))
SELECT id, step, node FROM walk""")
def j26_version_chain(spark: SparkSession, d: str) -> DataFrame:
    return G.chain(S.fact_links(spark, d))


# ---- graph

@R.add("""
, h1 AS (SELECT dst AS id, 1 AS hop, max(weight) AS weight FROM ed WHERE src = (SELECT p FROM hub) GROUP BY dst),
h2 AS (SELECT e.dst AS id, 2 AS hop, max(e.weight) AS weight FROM ed e JOIN h1 ON e.src = h1.id WHERE e.dst NOT IN (SELECT id FROM h1) AND e.dst <> (SELECT p FROM hub) GROUP BY e.dst)
SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def g1_neighbours(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    return G.neighbours(S.edges(spark, d), start, 2).select("id", "hop", "weight")


@R.add("""
, nw AS (SELECT dst AS src, (SELECT p FROM hub) AS dst, 'RELATED_TO' AS label, 0.5 AS weight FROM ed WHERE src = (SELECT p FROM hub)),
al AS (SELECT src, dst, label, weight FROM nw UNION SELECT dst, src, label, weight FROM nw)
SELECT * FROM ed UNION ALL SELECT DISTINCT a.src, a.dst, a.label, CAST(a.weight AS DOUBLE) FROM al a WHERE a.src <> a.dst AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.src = a.src AND e.dst = a.dst AND e.label = a.label)""")
def g2_link(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    e = S.edges(spark, d)
    new = e.where(F.col("src") == start).select(F.col("dst").alias("src"), F.lit(start).alias("dst"), F.lit("RELATED_TO").alias("label"), F.lit(0.5).alias("weight")).distinct()
    return G.link(e, new)


@R.add("SELECT * FROM ed WHERE NOT (label = 'NEXT' AND weight >= 1.0)")
def g3_unlink(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d)
    return G.unlink(e, e.where("label = 'NEXT' and weight >= 1.0").select("src", "dst", "label")).select("src", "dst", "label", "weight")


def _spread_sql(rounds: int) -> str:
    step = "".join(f", l{i + 1} AS MATERIALIZED (SELECT id, c FROM (SELECT u.a AS id, l.c, count(*) AS n FROM nb u JOIN l{i} l ON l.id = u.b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, c) = 1)" for i in range(rounds))
    return f", nb AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS c FROM nb){step} "


@R.add(_spread_sql(5) + "SELECT c AS community, count(*) AS size FROM l5 GROUP BY c HAVING count(*) >= 3")
def g4_communities(spark: SparkSession, d: str) -> DataFrame:
    lab = G.label_propagation(S.edges(spark, d), rounds=5)
    return lab.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 3").orderBy(F.desc("size"), "community")


def _pagerank_sql(jump: str) -> str:
    step = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT b.id, 0.15 * b.jump + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r.rank), 0) FROM r{i} r LEFT JOIN od o ON o.src = r.id WHERE o.src IS NULL) * b.jump) AS rank
  FROM base b LEFT JOIN (SELECT e.dst AS id, sum(r.rank / o.n) AS got FROM pe e JOIN r{i} r ON r.id = e.src JOIN od o ON o.src = e.src GROUP BY 1) g ON g.id = b.id)"""
        for i in range(10)
    )
    return f""", pe AS MATERIALIZED (SELECT DISTINCT src, dst FROM ed), ids AS MATERIALIZED (SELECT src AS id FROM pe UNION SELECT dst FROM pe), od AS MATERIALIZED (SELECT src, count(*) AS n FROM pe GROUP BY src),
base AS MATERIALIZED (SELECT id, {jump} AS jump FROM ids), r0 AS MATERIALIZED (SELECT id, jump AS rank FROM base){step} SELECT id, round(rank, 8) AS rank FROM r10"""


@R.add(_pagerank_sql("1.0 / (SELECT count(*) FROM ids)"))
def g5_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(S.edges(spark, d)).withColumn("rank", F.round("rank", 8))


@R.add(_pagerank_sql("CASE WHEN id = (SELECT p FROM hub) THEN 1.0 ELSE 0.0 END"))
def g6_personal_pagerank(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    start = start or S.hub(spark, d)
    seeds = spark.createDataFrame([(start,)], "id string")
    return G.pagerank(S.edges(spark, d), seeds=seeds).withColumn("rank", F.round("rank", 8))


@R.add("""
, und AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
low(id, component) USING KEY (id) AS (SELECT a, min(a) FROM und GROUP BY a
  UNION SELECT u.b, min(c.component) FROM low c JOIN und u ON u.a = c.id JOIN recurring.low r ON r.id = u.b WHERE c.component < r.component GROUP BY u.b)
SELECT id, component FROM low""")
def g7_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over the edges of all labels."""
    return G.components(S.edges(spark, d))


@R.add("SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, 1 FROM ed) GROUP BY id")
def g8_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(S.edges(spark, d))


@R.add(_spread_sql(5) + "SELECT id, c AS community FROM l5")
def g9_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(S.edges(spark, d), rounds=5)


@R.add("""
, pe AS (SELECT DISTINCT src, dst FROM ed),
bfs(id, hops) USING KEY (id) AS (SELECT (SELECT p FROM hub), 0
  UNION SELECT e.dst, min(b.hops) + 1 FROM bfs b JOIN pe e ON e.src = b.id WHERE e.dst NOT IN (SELECT id FROM recurring.bfs) GROUP BY e.dst)
SELECT id, hops, hops + 1 AS nodes FROM bfs""")
def g10_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths to all that can be reached, however many hops it takes."""
    return G.shortest_paths(S.edges(spark, d), S.hub(spark, d)).select("id", "hops", F.size("path").alias("nodes"))


@R.add(", ids AS (SELECT src AS id FROM ed WHERE label = 'PART_OF') SELECT src, dst, label, 'dst' AS missing FROM ed WHERE dst NOT IN (SELECT id FROM ids) UNION ALL SELECT src, dst, label, 'src' FROM ed WHERE src NOT IN (SELECT id FROM ids)")
def g13_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Edges with an end that is no page of the tree (the children of PART_OF)."""
    e = S.edges(spark, d)
    return G.dangling(e, e.where("label = 'PART_OF'").select(F.col("src").alias("id")))


@R.add("""
, m AS (SELECT node_id, chunk_idx, node_id || ':' || chunk_idx AS id FROM ch)
SELECT src, dst, label FROM (
  SELECT id AS src, lead(id) OVER (PARTITION BY node_id ORDER BY chunk_idx) AS dst, 'NEXT' AS label FROM m
  UNION ALL SELECT id, first_value(id) OVER (PARTITION BY node_id ORDER BY chunk_idx), 'PART_OF' FROM m
  UNION ALL SELECT CAST(id AS VARCHAR), CAST(dst AS VARCHAR), 'REFERENCES' FROM (SELECT id, unnest(linked_from) AS dst FROM cur) WHERE dst IN (SELECT id FROM cur)
  UNION ALL SELECT src, dst, 'SKILL_RELATED_TO' FROM (SELECT src, dst FROM ed WHERE label = 'SKILL_RELATED_TO' UNION SELECT dst, src FROM ed WHERE label = 'SKILL_RELATED_TO')
  UNION ALL SELECT src, dst, 'FOLLOWS' FROM (SELECT CAST(event_id AS VARCHAR) AS src, CAST(lead(event_id) OVER w AS VARCHAR) AS dst, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap <= 1800000000)
WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL""")
def g14_structural_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that follow from structure: order and head of a file's chunks, references between nodes, names in both directions, events of one user within half an hour."""
    n, e = S.nodes(spark, d), S.edges(spark, d)
    m = S.chunks(spark, d).select("node_id", "chunk_idx", F.concat_ws(":", "node_id", "chunk_idx").alias("id"))
    nxt = m.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("node_id").orderBy("chunk_idx")).alias("dst"), F.lit("NEXT").alias("label"))
    part = m.join(m.groupBy("node_id").agg(F.min_by("id", "chunk_idx").alias("dst")), "node_id").select(F.col("id").alias("src"), "dst", F.lit("PART_OF").alias("label"))
    refs = n.select(F.col("id").alias("src"), F.explode("linked_from").alias("dst")).join(n.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("REFERENCES").alias("label"))
    skill = e.where("label = 'SKILL_RELATED_TO'").select("src", "dst", "label")
    both = skill.union(skill.select("dst", "src", "label"))
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, d, "events").select(F.col("event_id").cast("string").alias("src"), F.lead(F.col("event_id").cast("string")).over(user).alias("dst"), F.timestamp_diff("MICROSECOND", F.col("ts").cast("timestamp_ntz"), F.lead(F.col("ts").cast("timestamp_ntz")).over(user)).alias("gap"))
    follows = ev.where("gap <= 1800000000").select("src", "dst", F.lit("FOLLOWS").alias("label"))
    return nxt.union(part).union(refs).union(both).union(follows).where("dst is not null and src <> dst").distinct()


# ---- retrieval

@R.add(f"SELECT id, round({_SIM}, 6) AS score FROM vec ORDER BY {_SIM} DESC, id LIMIT 10")
def r1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(S.vectors(spark, d), _query(spark, d), 10).select("id", F.round("score", 6).alias("score"))


_SCORED = f""", hits AS (SELECT 1000 + id AS id, {_SIM} AS s FROM vec),
j AS (SELECT c.*, h.s, CASE WHEN c.created_at > 0 THEN greatest(0, (1790000000.0 - c.created_at) / 86400) ELSE 0 END AS days FROM hits h JOIN cur c ON c.id = h.id),
soft AS (SELECT *, s + 0.02 * CASE WHEN type = 'kb_chunk' THEN 1.5 ELSE greatest(-1.0, least(1.0, (importance - 0.5) / 0.5)) + pow(0.95, days / 30) END AS score FROM j)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query(spark, d)])
    return S.vectors(spark, d).select((F.col("id") + 1000).alias("id"), E.cosine(F.col("v"), q).alias("score"))


@R.add(_SCORED + "SELECT id, round(score, 4) AS score FROM soft WHERE status NOT IN ('outdated','archived') ORDER BY 2 DESC, 1 LIMIT 20")
def r3_search_soft(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_hits(spark, d), S.nodes(spark, d), now=NOW, limit=20).select("id", "score")


@R.add(_SCORED + "SELECT id, round(CASE WHEN type = 'kb_chunk' THEN s ELSE s * importance * pow(0.95, days / 30) END, 4) AS score FROM soft WHERE status NOT IN ('outdated','archived') ORDER BY 2 DESC, 1 LIMIT 20")
def r4_search_hard(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_hits(spark, d), S.nodes(spark, d), now=NOW, limit=20, hard=True).select("id", "score")


@R.add("SELECT id, round(coalesce(pow(0.5, (CASE WHEN b > 0 THEN greatest(0, (1790000000.0 - b) / 86400) END) / 90), 0), 6) AS fresh FROM (SELECT id, coalesce(valid_at, created_at) AS b FROM cur)")
def r6_freshness(spark: SparkSession, d: str) -> DataFrame:
    b = F.coalesce("valid_at", "created_at")
    age = F.when(b > 0, F.greatest(F.lit(0.0), (F.lit(NOW) - b) / 86400))
    return S.nodes(spark, d).select("id", F.round(E.freshness(age, 90), 6).alias("fresh"))


@R.add(r"""SELECT id, round(r / (r + s + 2), 6) AS b, round(s / (r + s + 2), 6) AS d, round(2 / (r + s + 2), 6) AS u FROM (SELECT id,
  CASE WHEN coalesce(source_path, '') <> '' THEN 0.9 ELSE 0 END + CASE WHEN type = 'git_commit' AND map_contains(coalesce(meta, MAP {}), 'commit') THEN 1.0 ELSE 0 END
  + CASE WHEN len(list_filter(regexp_extract_all(content, '(?i)\b[0-9a-f]{7,40}\b'), lambda x: regexp_matches(x, '(?i)[a-f]'))) > 0 OR regexp_matches(content, '(?i)\bPR\s*#\d+\b') THEN 1.0 ELSE 0 END
  + CASE WHEN regexp_matches(content, '[A-Za-z]:[\\/][^\s，。；、）)\]]{3,}|(^|[^\w/])/(home|mnt|tmp|d)/[^\s]{3,}') THEN 0.8 ELSE 0 END
  + CASE WHEN regexp_matches(content, 'https?://[^\s，。）)]+') THEN 0.8 ELSE 0 END + CASE WHEN regexp_matches(content, '(?i)node\s*\d+|节点\s*\d+') THEN 0.6 ELSE 0 END
  + CASE WHEN regexp_matches(content, '实测|跑出来|测试通过|复跑|验证过|exit code|全绿|全过|断言') THEN 0.7 ELSE 0 END AS r,
  CASE WHEN status = 'outdated' THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(content, '待确认|待验证|存疑|未验证|无法确认|尚无定论|不确定是否|没有证据|缺乏证据|暂未核实') THEN 0.3 ELSE 0 END AS s FROM cur)""")
def r7_belief(spark: SparkSession, d: str) -> DataFrame:
    o = E.opinion(F.col("content"), F.col("source_path"), F.col("status"), F.col("type"), F.coalesce(F.map_contains_key("meta", "commit"), F.lit(False)))
    return S.nodes(spark, d).select("id", *[F.round(o[c], 6).alias(c) for c in "bdu"])


@R.add(_SCORED + "SELECT id, round(score * CASE WHEN domain = 'kb' THEN 1.15 ELSE 1 END + CASE WHEN domain = 'hermes' THEN 0.1 ELSE 0 END, 4) AS score FROM soft WHERE status NOT IN ('outdated','archived') AND coalesce(type,'') NOT IN ('record','event','git_commit','thought','session') ORDER BY 2 DESC, 1 LIMIT 20")
def r8_bias_and_boost(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_hits(spark, d), S.nodes(spark, d), now=NOW, limit=20, tier="facts", domain_bias="kb", boost="hermes").select("id", "score")


@R.add(_SCORED + "SELECT id, round(score, 4) AS score FROM soft WHERE NOT coalesce(type IN ('memory','task','plan'), false) OR valid_at IS NULL OR (valid_at <= 1760000000 AND (invalid_at IS NULL OR invalid_at > 1760000000)) ORDER BY 2 DESC, 1 LIMIT 20")
def r11_search_as_of(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_hits(spark, d), S.nodes(spark, d), now=NOW, limit=20, as_of=1_760_000_000.0).select("id", "score")


@R.add(_SCORED + "SELECT id, round(score, 4) AS score FROM soft WHERE type = 'kb_chunk' AND status NOT IN ('outdated','archived') ORDER BY 2 DESC, 1 LIMIT 5")
def r13_slices_only(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_hits(spark, d), S.nodes(spark, d), now=NOW, limit=5, scope="kb").select("id", "score")


_QUESTION = "the merge gate and the daily digest"


#: The grams of questions (q, query) in SQL, in their order: asked (q, i, g).
GRAMS_SQL = r"""
, parts AS (SELECT q, unnest(s) AS part, unnest(generate_series(1, len(s))) AS p FROM (SELECT q, regexp_split_to_array(query, '[\s,，。；;、/（）()？?！!：:+【】\[\]「」『』\-—·…]+') AS s FROM (QUESTIONS))),
slid AS (SELECT q, p, part, unnest(list_sort(list_distinct(list_concat(generate_series(0, length(part) - 3, greatest(1, (length(part) - 2) // 12)), [length(part) - 3])))) AS pos FROM parts WHERE length(part) >= 3),
numbered AS (SELECT q, substr(part, pos + 1, 3) AS g, row_number() OVER (PARTITION BY q ORDER BY p, pos) - 1 AS k, count(*) OVER (PARTITION BY q) AS n FROM slid),
asked AS (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY k) - 1 AS i FROM numbered WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: round_even(j * (n - 1) / 11.0, 0)), k))
"""


def _grams_sql(grams: str, n: int) -> str:
    return f"""
, low AS (SELECT doc_id AS id, lower(text) AS c FROM documents), whole AS (SELECT count(*) AS n_docs, avg(greatest(length(c) - {n - 1}, 0)) AS mean_len FROM low),
g AS (SELECT id, greatest(length(c) - {n - 1}, 0) AS dl, unnest(list_transform(generate_series(1, length(c) - {n - 1}), lambda i: substr(c, i, {n}))) AS gram FROM low),
tf AS (SELECT id, gram, dl, count(*) AS tf FROM g WHERE gram IN ({grams}) GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram)
SELECT id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 6) AS score FROM tf JOIN df USING (gram), whole GROUP BY id"""


@R.add(GRAMS_SQL.replace("QUESTIONS", f"SELECT 0 AS q, '{_QUESTION}' AS query") + _grams_sql("SELECT lower(g) FROM asked", 3) + " ORDER BY 2 DESC, 1 LIMIT 30")
def r14_text_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return T.search(docs, _QUESTION, 30).select("id", F.round("score", 6).alias("score"))


@R.add("SELECT doc_id AS id, (length(lower(text)) - length(replace(lower(text), 'digest', ''))) / 6.0 AS score FROM documents WHERE contains(lower(text), 'digest') ORDER BY 2 DESC, 1 LIMIT 30")
def r14_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return T.search(docs, "Digest", 30).select("id", "score")


@R.add(_grams_sql("'摘要', '要点', '会话'", 2))
def r17_bm25_bigrams(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return T.bm25(docs, ["摘要", "要点", "会话"], 2).withColumn("score", F.round("score", 6))


@R.add("SELECT id, round(CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (s - lo) / (hi - lo) END, 6) AS score FROM (SELECT id, s, min(s) OVER () AS lo, max(s) OVER () AS hi FROM (SELECT id, " + _SIM + " AS s FROM vec ORDER BY s DESC, id LIMIT 50))")
def r23_min_max_fusion(spark: SparkSession, d: str) -> DataFrame:
    return X.min_max(V.nearest(S.vectors(spark, d), _query(spark, d), 50).select("id", "score")).withColumn("score", F.round("score", 6))


@R.add(f"""
, top AS (SELECT id, label, row_number() OVER (ORDER BY {_SIM} DESC, id) - 1 AS place FROM vec QUALIFY place < 30)
SELECT id, row_number() OVER (ORDER BY CASE WHEN place < 10 THEN 0 ELSE 1 END, CASE WHEN place < 10 THEN -label END, place) - 1 AS place FROM top""")
def r21_rerank(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    top = X.ranked(V.nearest(v, _query(spark, d), 30).select("id", "score", "label"))
    return X.rerank(top, F.col("label").cast("double"), 10).select("id", F.col("place").cast("bigint").alias("place"))


@R.add("SELECT c.id, c.hit_count + coalesce(h.n, 0) AS hit_count FROM cur c LEFT JOIN (SELECT g AS id, count(*) AS n FROM (SELECT unnest(gold_ids) AS g FROM temporal_state) GROUP BY g) h ON h.id = c.id")
def r28_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_hits(S.nodes(spark, d), table(spark, d, "temporal_state").select(F.explode("gold_ids").alias("id")))


@R.add("""
, st AS (SELECT l.dst AS id, min(coalesce(n.valid_at, 1790000000.0)) AS began FROM flinks l LEFT JOIN cur n ON n.id = l.src GROUP BY l.dst)
SELECT c.id, CASE WHEN s.id IS NOT NULL THEN 'outdated' ELSE c.status END AS status, CASE WHEN s.id IS NOT NULL THEN coalesce(c.invalid_at, s.began) ELSE c.invalid_at END AS invalid_at FROM cur c LEFT JOIN st s ON s.id = c.id""")
def r30_supersede(spark: SparkSession, d: str) -> DataFrame:
    return C.supersede(S.nodes(spark, d), S.fact_links(spark, d), NOW).select("id", "status", "invalid_at")


@R.add()
def r33_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to merge, no row in two of them."""
    return C.matching(V.similar_rows(S.vectors(spark, d), least=0.5)).withColumn("score", F.round("score", 6))


@R.add("SELECT id, importance AS old, round(least(importance + 0.1, 0.9), 6) AS new FROM cur WHERE status = 'active' AND hit_count >= 20 AND importance < 0.9")
def r34_promote(spark: SparkSession, d: str) -> DataFrame:
    return C.promoted(S.nodes(spark, d))


@R.add("SELECT id, round(days, 4) AS age, days > 90 AS demote, days > 365 AS archive FROM (SELECT id, CASE WHEN created_at > 0 THEN greatest(0, (1790000000.0 - created_at) / 86400) ELSE 0 END AS days FROM cur)")
def r36_stale(spark: SparkSession, d: str) -> DataFrame:
    return C.stale(S.nodes(spark, d), NOW, 90, 365)


@R.add("""
, res AS (SELECT qid, g AS id, row_number() OVER (PARTITION BY qid ORDER BY g) - 1 AS place FROM (SELECT DISTINCT qid, unnest(list_concat(coalesce(gold_ids, []), coalesce(stale_ids, []))) AS g FROM temporal_state)),
gold AS (SELECT DISTINCT qid, unnest(gold_ids) AS id FROM temporal_state), want AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid),
got AS (SELECT g.qid, count(*) AS found, min(place) AS f, sum(1 / log2(place + 2)) AS dcg FROM res r JOIN gold g ON g.qid = r.qid AND g.id = r.id WHERE place < 3 GROUP BY g.qid)
SELECT w.qid, round(coalesce(found, 0) / CAST(n AS DOUBLE), 6) AS recall, round(coalesce(1.0 / (f + 1), 0), 6) AS mrr,
  round(coalesce(dcg, 0) / (1 + CASE WHEN n > 1 THEN 1 / log2(3) ELSE 0 END + CASE WHEN n > 2 THEN 0.5 ELSE 0 END), 6) AS ndcg, CASE WHEN coalesce(found, 0) > 0 THEN 1 ELSE 0 END AS hit FROM want w LEFT JOIN got USING (qid)""")
def a16_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank, nDCG and hits at 3 of a ranking by id of gold and stale ids together."""
    t = table(spark, d, "temporal_state")
    none = F.array().cast("array<bigint>")
    ids = t.select("qid", F.explode(F.concat(F.coalesce("gold_ids", none), F.coalesce("stale_ids", none))).alias("id")).distinct()
    res = ids.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("id")) - 1)
    gold = t.select("qid", F.explode("gold_ids").alias("id")).distinct().withColumn("gain", F.lit(1.0))
    return Q.per_query(res, gold, 3)


@R.add(", s AS (SELECT importance AS score, status = 'outdated' AS label FROM cur) SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM s p, s n WHERE p.label AND NOT n.label")
def a19_auc(spark: SparkSession, d: str) -> DataFrame:
    return Q.auc(S.nodes(spark, d).select(F.col("importance").alias("score"), (F.col("status") == "outdated").alias("label")))


_BOOTSTRAP = """
, drawn AS (SELECT diff, i, CAST('0x' || substr(md5('42:' || qid || ':' || i), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT qid, ndcg - mrr AS diff FROM met), range(1000) t(i)),
means AS (SELECT i, sum(w * diff) / nullif(sum(w), 0) AS m FROM (SELECT diff, i, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238463 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.999916758850712 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END AS w FROM drawn) GROUP BY i), mean AS (SELECT avg(ndcg - mrr) AS mean FROM met)
SELECT round(max(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN abs(m - mean) >= abs(mean) THEN 1 ELSE 0 END), 4) AS p FROM means, mean"""
_METRICS = R.sql["a16_retrieval_metrics"].removeprefix(VIEWS)


@R.add(_METRICS[: _METRICS.rindex("SELECT w.qid")].rstrip() + ", met AS (" + _METRICS[_METRICS.rindex("SELECT w.qid") :] + ")" + _BOOTSTRAP)
def a21_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    m = a16_retrieval_metrics(spark, d)
    return Q.paired_bootstrap(m.select("qid", (F.col("ndcg") - F.col("mrr")).alias("diff")))


# ---- scalar functions

@R.add("SELECT id, CASE WHEN length(content) > 40 THEN substr(content, 1, 39) || '…' ELSE content END AS short FROM cur")
def x_shorten(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", E.shorten(F.col("content"), 40).alias("short"))


@R.add(r"""
, h AS (SELECT id, content, substr(content, 1, 100) AS head, substr(regexp_replace(regexp_replace(content, '(\d)\.(\d)', '\1·\2', 'g'), '(\d)\.(\d)', '\1·\2', 'g'), 1, 100) AS t FROM cur),
s AS (SELECT *, length(regexp_extract(t, '(?s)^(.*[。！？!?.\n])', 1)) AS se, length(regexp_extract(t, '(?s)^(.*)[ \t,，、]', 1)) AS we FROM h),
e AS (SELECT *, CASE WHEN substr(head, se, 1) = chr(10) THEN se - 1 ELSE se END AS ends FROM s)
SELECT id, CASE WHEN length(content) <= 100 THEN content WHEN se > 0 AND ends >= 50 THEN substr(head, 1, ends) WHEN we >= 50 THEN substr(head, 1, we) ELSE head END AS piece FROM e""")
def x_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return S.nodes(spark, d).select("id", E.excerpt(F.col("content"), 100).alias("piece"))


@R.add("SELECT substr(sha256(concat_ws('|', split_part(model, ':', 1), split_part(model, ':', 2), CAST(dim AS VARCHAR), 'mean')), 1, 16) AS space, model, dim FROM (SELECT DISTINCT model, dim FROM node_chunks)")
def x_space_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "node_chunks").select("model", "dim").distinct()
    f = E.space_fingerprint(F.split_part("model", F.lit(":"), F.lit(1)), F.split_part("model", F.lit(":"), F.lit(2)), F.col("dim").cast("string"), F.lit("mean"))
    return m.select(f.alias("space"), "model", "dim")


@R.add("SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, length(query) - 2), lambda i: substr(lower(query), i, 3))) AS gram FROM eval_items WHERE length(query) >= 3) GROUP BY gram")
def x_grams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.explode(T.gram_array(F.col("query"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@R.add("SELECT doc_id, translate(text, '，。：；！？（）【】', ',.:;!?()[]') AS folded FROM documents")
def x_fold_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", E.fold_punctuation(F.col("text")).alias("folded"))


@R.add("""
, c AS (SELECT node_id, v.model AS model, v.dim AS dim, length(v.chunk_text) AS w, CAST(v.vector AS DOUBLE[]) AS x FROM ch WHERE len(v.vector) = v.dim AND len(list_filter(v.vector, lambda x: x <> 0)) > 0),
p AS (SELECT node_id, model, dim, w, unnest(x) AS x, unnest(generate_series(1, len(x))) AS i FROM c), m AS (SELECT node_id, model, dim, i, sum(x * w) / sum(w) AS m FROM p GROUP BY ALL)
SELECT node_id AS id, model, dim, round(m[1] / n, 6) AS first, round(m[-1] / n, 6) AS last FROM (SELECT node_id, model, dim, list(m ORDER BY i) AS m, sqrt(sum(m * m)) AS n FROM m GROUP BY node_id, model, dim)""")
def x_pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One vector for each node and space of vectors."""
    c = S.chunks(spark, d).where("vector is not null").select(F.struct("node_id", "model", "dim").alias("id"), F.col("vector").cast("array<double>").alias("v"), F.char_length("chunk_text").alias("weight"))
    return V.pool(c).select(F.col("id.node_id").alias("id"), "id.model", "id.dim", F.round(F.col("v")[0], 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))

QUERIES, SQL = R.queries, R.sql
