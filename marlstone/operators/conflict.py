"""Candidates for conflicts, duplicates and consolidation among similar rows, and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.runtime import cut


def with_ends(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b, score) with the columns of both ends as a_<column> and b_<column>."""
    left = rows.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = rows.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(left, "a").join(right, "b")


def same_scope(a: Column, b: Column) -> Column:
    """Domains that may meet: equal, or one of them general."""
    return (a == b) | (a == "general") | (b == "general")


def verdict(score: Column, meets: Column, related: float = 0.4, outdated: float = 0.75) -> Column:
    """ignore up to `related`, supersede above `outdated` where the times overlap, else related."""
    return F.when(score <= related, "ignore").when((score > outdated) & meets, "supersede").otherwise("related")


def supersede(nodes: DataFrame, links: DataFrame, now: float) -> DataFrame:
    """Nodes with those replaced by links (src newer, dst older) closed: outdated, ended when the newer began or now, unless an end was known."""
    start = links.join(nodes.select(F.col("id").alias("src"), F.col("valid_at").alias("began")), "src", "left").groupBy(F.col("dst").alias("id")).agg(F.min(F.coalesce("began", F.lit(now))).alias("began"), F.lit(True).alias("hit"))
    j = nodes.join(start, "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    return j.select(
        "id", F.when(hit, F.lit("outdated")).otherwise(F.col("status")).alias("status"), "valid_at",
        F.when(hit, F.coalesce("invalid_at", "began")).otherwise(F.col("invalid_at")).alias("invalid_at"), F.when(hit, F.coalesce("expired_at", F.lit(now))).otherwise(F.col("expired_at")).alias("expired_at"),
    )


def matching(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, score) such that no row is in two: what taking pairs best first (score, then ids) gives.

    Each round takes every pair that is the best of both its ends and drops
    the pairs they touch; the result is the sequential one.
    """
    order = F.struct((-F.col("score")).alias("s"), "a", "b")
    open_pairs, taken = cut(pairs.select("a", "b", "score")), []
    while not open_pairs.isEmpty():
        ends = open_pairs.select(F.explode(F.array("a", "b")).alias("id"), order.alias("o"))
        best = ends.groupBy("id").agg(F.min("o").alias("o"))
        win = cut(best.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("o.a").alias("a"), F.col("o.b").alias("b"), (-F.col("o.s")).alias("score")))
        taken.append(win)
        used = win.select(F.explode(F.array("a", "b")).alias("u")).distinct()
        open_pairs = cut(open_pairs.join(used, open_pairs["a"] == used["u"], "left_anti").join(used, open_pairs["b"] == used["u"], "left_anti"))
    out = pairs.select("a", "b", "score").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def overlaps(rows: DataFrame, keys: list[str], since: str, until: str, width: float) -> DataFrame:
    """(a, b): pairs of rows of one group whose half-open intervals meet, by an equi-join on time bins.

    Each interval is put into every bin of `width` it touches (an open end
    counts as the group's last bin); a pair is taken in the first bin both
    touch, so it comes once and rows far apart never meet.
    """
    top = rows.groupBy(*keys).agg(F.max(F.greatest(F.col(since), F.coalesce(F.col(until), F.col(since)))).alias("_top"))
    r = rows.where(F.col(since).isNotNull()).join(top, keys).withColumn("_end", F.coalesce(F.col(until), F.col("_top") + 1))
    r = r.where(F.col("_end") > F.col(since)).withColumn("_first", F.floor(F.col(since) / width)).withColumn("_last", F.floor(F.col("_end") / width))
    binned = r.select(*keys, "id", F.col(since).alias("s"), F.col("_end").alias("e"), F.col("_first"), F.explode(F.sequence("_first", "_last")).alias("bin"))
    a, b = binned.alias("x"), binned.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    cond = (F.col("x.bin") == F.col("y.bin")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.s") < F.col("y.e")) & (F.col("y.s") < F.col("x.e")) & (F.col("x.bin") == F.greatest(F.col("x._first"), F.col("y._first")))
    for c in same:
        cond = cond & c
    return a.join(b, cond).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *[F.col(f"x.{k}").alias(k) for k in keys])


def merge_hits(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Nodes (id, hit_count) with the counts of a batch of hits (id) added."""
    delta = hits.groupBy("id").agg(F.count(F.lit(1)).alias("_more"))
    return nodes.join(delta, "id", "left").select("id", (F.col("hit_count") + F.coalesce("_more", F.lit(0))).alias("hit_count"))


def promoted(nodes: DataFrame, least: int = 20, step: float = 0.1, most: float = 0.9) -> DataFrame:
    """(id, old, new): the importance of often-hit active nodes raised by a step, to `most` at the most."""
    n = nodes.where((F.col("status") == "active") & (F.col("hit_count") >= least) & (F.col("importance") < most))
    return n.select("id", F.col("importance").alias("old"), F.round(F.least(F.col("importance") + step, F.lit(most)), 6).alias("new"))


def stale(nodes: DataFrame, now: float, demote: float, archive: float) -> DataFrame:
    """(id, age, demote, archive): two flags, not exclusive, by days since the node was made."""
    age = E.days_since(F.col("created_at"), now)
    return nodes.select("id", F.round(age, 4).alias("age"), (age > demote).alias("demote"), (age > archive).alias("archive"))
