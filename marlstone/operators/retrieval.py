"""Hybrid retrieval: channels, fusion, reranking, search pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import vector as V
from marlstone.sources.store import LOGS


def ranked(hits: DataFrame) -> DataFrame:
    """Hits (id, score) with their 0-based place; for top-k lists, which are short."""
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def rrf(channels: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(id, score): reciprocal-rank fusion of ranked lists with weights."""
    parts = [c.select("id", (F.lit(w) / (k + F.col("place"))).alias("part")) for c, w in channels if w > 0]
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("part").alias("score"))


def cascade(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Hits of `first` that `second` has too, then the others of `first`, each by its own order; scores stay."""
    both = first.join(second.select("id").withColumn("_in", F.lit(1)), "id", "left")
    return both.orderBy(F.col("_in").isNull(), F.desc("score"), "id").limit(limit).drop("_in")


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of one channel brought to 0..1; if all are equal, 1 where positive."""
    ends = hits.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))  # one row
    lo, hi = F.col("_lo"), F.col("_hi")
    return hits.join(F.broadcast(ends)).withColumn("score", F.when(hi == lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col("score") - lo) / (hi - lo))).drop("_lo", "_hi")


def best_chunk(chunks: DataFrame, query: list[float], model: str) -> DataFrame:
    """(id, chunk_score): each node's best cosine among its chunks of one model."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform("vector", lambda x: x.cast("double"))
    return chunks.where((F.col("model") == model) & (F.col("dim") == len(query)) & F.col("vector").isNotNull()).select(F.col("node_id").alias("id"), E.cosine(v, q).alias("s")).groupBy("id").agg(F.max("s").alias("chunk_score"))


def merge_chunks(main: DataFrame, chunk_scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """Full outer join of node scores (id, score) with chunk scores: the larger counts, nodes known by chunks alone start from 0."""
    return main.join(chunk_scores, "id", "full_outer").select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce(F.col("chunk_score") * weight, F.lit(0.0))).alias("score"))


def search(hits: DataFrame, nodes: DataFrame, *, now: float, limit: int, scope: str = "all", domain: str | None = None, domain_bias: str | None = None, bias: float = 1.15, boost: str | None = None, boost_by: float = 0.10, tier: str = "", as_of: float | None = None, timed: tuple = ("memory", "task", "plan"), hard: bool = False) -> DataFrame:
    """Filter, rerank and cut scored hits (id, score): visible nodes, tier, scope and domain, then the tie-break, bias and boost, rounded to 4 digits before the sort."""
    n = hits.join(nodes, "id")
    kind = F.col("type")
    seen = E.retrievable(F.col("status")) if as_of is None else E.valid_at(as_of, F.col("valid_at"), F.col("invalid_at"), kind.isin(*timed))
    n = n.where(seen & E.in_tier(kind, tier, LOGS) & E.in_scope(kind, scope))
    if domain:
        n = n.where(E.in_domain(kind, F.col("domain"), domain))
    days = E.days_since(F.col("created_at"), now)
    score = (E.hard_rerank if hard else E.soft_rerank)(F.col("score"), kind, F.col("importance"), days)
    if domain_bias:
        score = score * F.when(F.col("domain") == domain_bias, bias).otherwise(1.0)
    if boost:
        score = score + F.when(F.col("domain") == boost, boost_by).otherwise(0.0)
    return n.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(rows: DataFrame, docs: DataFrame, query_vector: list[float], text_hits: DataFrame, *, wide: int, limit: int, w_sem: float = 1.0, w_text: float = 0.1) -> DataFrame:
    """Vector and text channels fused; both are cut before the fusion, so only short lists are joined."""
    sem = ranked(V.nearest(rows, query_vector, wide).select("id", "score"))
    fused = rrf([(sem, w_sem), (ranked(text_hits), w_text)])
    return fused.join(docs.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)


def rerank(hits: DataFrame, scorer: Column, pool: int) -> DataFrame:
    """The first `pool` hits (with place) in the order of another scorer, the rest as they were; a scorer that gives one value to all changes nothing."""
    w = Window.partitionBy()
    s = hits.withColumn("_s", F.when(F.col("place") < pool, scorer))
    flat = F.coalesce(F.max("_s").over(w) == F.min("_s").over(w), F.lit(True))
    s = s.withColumn("_key", F.when(flat | F.col("_s").isNull(), F.lit(None).cast("double")).otherwise(F.col("_s")))
    order = Window.orderBy((F.col("place") >= pool).cast("int"), F.desc_nulls_last("_key"), "place")
    return s.withColumn("place", F.row_number().over(order) - 1).drop("_s", "_key")


def routed(hits: DataFrame, limit: int, boost: float, top: int = 10) -> DataFrame:
    """Hits (id, score, domain) with a boost for the commonest domain among the first `top`; among equals the one with the best hit, then the first by name."""
    first = hits.orderBy(F.desc("score"), "id").limit(top)
    best = first.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s")).orderBy(F.desc("n"), F.desc("s"), "domain").limit(1).select(F.col("domain").alias("_routed"))
    return hits.join(F.broadcast(best)).withColumn("score", F.col("score") + F.when(F.col("domain") == F.col("_routed"), boost).otherwise(0.0)).drop("_routed").orderBy(F.desc("score"), "id").limit(limit)


def fused_rankings(a: DataFrame, b: DataFrame, k: int = 60, missing: int = 1_000_000) -> DataFrame:
    """(id, score) of two rankings (id, place from 0): places count from 1, one that a ranking lacks is `missing`."""
    j = a.select("id", F.col("place").alias("_a")).join(b.select("id", F.col("place").alias("_b")), "id", "full_outer")
    part = lambda c: F.lit(1.0) / (k + F.coalesce(F.col(c) + 1, F.lit(missing)))
    return j.select("id", (part("_a") + part("_b")).alias("score"))


def probed(probes: DataFrame, tops: DataFrame) -> DataFrame:
    """(qid, hit): does the first hit (qid, type, title, content, source_path) meet a probe's expectations (types, text, source; null: none)? Without a hit it does not."""
    j = probes.join(tops.select("qid", "type", "title", "content", "source_path", F.lit(True).alias("_t")), "qid", "left")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "content", F.coalesce("source_path", F.lit("")))
    ok = lambda want, c: F.col(want).isNull() | F.coalesce(c, F.lit(False))
    return j.select("qid", (F.col("_t").isNotNull() & ok("types", F.array_contains("types", F.col("type"))) & ok("text", F.contains(text, F.col("text"))) & ok("source", F.contains("source_path", F.col("source")))).alias("hit"))


def diffused(hits: DataFrame, links: DataFrame, *, damping: float = 0.5, rounds: int = 1) -> DataFrame:
    """(id, score): scores of hits and what they pass on over links (src, dst), shared out among a node's links and damped each round."""
    e = links.select("src", "dst").distinct()
    e = e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src")
    total, front = hits.select("id", "score"), hits.select("id", "score")
    for _ in range(rounds):
        front = e.join(front, F.col("src") == F.col("id")).groupBy("dst").agg((damping * F.sum(F.col("score") / F.col("n"))).alias("score")).select(F.col("dst").alias("id"), "score")
        total = total.union(front)
    return total.groupBy("id").agg(F.sum("score").alias("score"))


def chunk_scores(scores: DataFrame) -> DataFrame:
    """(id, best, mean_top2, by_root) of chunk scores (id, s): the largest, the mean of the two largest, the largest over the root of their number."""
    w = Window.partitionBy("id").orderBy(F.desc("s"))
    two = scores.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("id").agg(F.max("s").alias("best"), F.avg("s").alias("mean_top2"))
    n = scores.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return two.join(n, "id").select("id", "best", "mean_top2", (F.col("best") / F.sqrt("n")).alias("by_root"))


def dispatch(rows: DataFrame, docs: DataFrame | None, query_vector: list[float], query: str, *, mode: str = "rrf", wide: int = 30, limit: int = 10, w_text: float = 0.1, w_exact: float = 1.5) -> tuple[DataFrame, dict]:
    """Hybrid search by mode: 'rrf' (also for unknown modes) or 'cascade'.

    The state names the mode that ran and the text channel's state. A query
    that names one thing weighs its text hits more. Without a text table, or
    with an empty query, the vectors answer alone.
    """
    from marlstone.operators import fulltext as T

    mode = mode if mode in ("rrf", "cascade") else "rrf"
    hits, state = T.search_with_status(docs, query, wide)
    sem = V.nearest(rows, query_vector, wide).select("id", "score")
    exact = rows.sparkSession.range(1).select(E.exact_identifier(F.lit(query)).alias("e")).first()["e"]
    if state != "ok":
        got = rrf([(ranked(sem), 1.0)]) if mode == "rrf" else sem
    elif mode == "cascade":
        return cascade(sem, hits, limit), {"mode": mode, "text": state}
    else:
        got = rrf([(ranked(sem), 1.0), (ranked(hits), w_exact if exact else w_text)])
    return got.orderBy(F.desc("score"), "id").limit(limit), {"mode": mode, "text": state}
