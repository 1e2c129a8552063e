"""Graph operators over edge tables (src, dst, label, weight)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import cut, shuffled


def components(edges: DataFrame) -> DataFrame:
    """(id, component): connected components of the undirected edges (src, dst), named by their smallest id.

    Large-star and small-star rounds: every id hooks its larger neighbours to
    its smallest one, so stars form in a logarithmic number of rounds and no
    neighbourhood is ever collected. Null ends and loops count for nothing.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src is not null and dst is not null and src <> dst").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low2), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).distinct()


def neighbours(edges: DataFrame, start, depth: int, *, relation: str | None = None, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """(id, hop, weight, via): nodes reached from one start over outgoing edges, at most `depth` hops; the first reach counts.

    Among reaches of one hop the heaviest edge counts, then the smaller
    predecessor. Each hop is one join and one anti-join with what is known.
    """
    e = edges.where(F.col("weight") >= least)
    if relation:
        e = e.where(F.col("label") == relation)
    spark = edges.sparkSession
    key = dict(edges.dtypes)["src"]
    known = spark.createDataFrame([(start,)], f"id {key}")
    front, out = known, None
    for hop in range(1, depth + 1):
        step = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id"), "weight", F.col("src").alias("via"))
        step = step.groupBy("id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "via")).alias("b")).join(known, "id", "left_anti")
        step = step.select("id", F.lit(hop).alias("hop"), (-F.col("b.w")).alias("weight"), F.col("b.via").alias("via"))
        out = step if out is None else out.union(step)
        front = step.select("id")
        known = known.union(front)
    out = out.orderBy("hop", F.desc("weight"), "id")
    return out.limit(limit) if limit else out


def link(edges: DataFrame, new: DataFrame, both_ways: tuple = ("RELATED_TO", "CAUSES", "REFERS_TO")) -> DataFrame:
    """Edges with the new ones added: no loops, weights to 6 digits, the way back for symmetric labels, known triples stay as they are."""
    n = new.where("src <> dst").withColumn("weight", F.round("weight", 6)).select("src", "dst", "label", "weight")
    back = n.where(F.col("label").isin(*both_ways)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight")
    fresh = n.union(back).groupBy("src", "dst", "label").agg(F.max("weight").alias("weight")).join(edges, ["src", "dst", "label"], "left_anti")
    return edges.select("src", "dst", "label", "weight").unionByName(fresh)


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst", "label"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, *, rounds: int = 10, damping: float = 0.85, seeds: DataFrame | None = None) -> DataFrame:
    """(id, rank): PageRank over distinct edges for a fixed number of rounds, personalised if seeds (id) are given.

    Ranks sum to 1; the rank of nodes without outgoing edges goes where jumps
    go. The adjacency keeps its partitioning; ranks are cut from their lineage
    every few rounds.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    jump = ids.withColumn("jump", F.lit(1.0 / n)) if seeds is None else ids.join(seeds.select("id").distinct().withColumn("s", F.lit(1.0)), "id", "left").withColumn("jump", F.coalesce("s", F.lit(0.0)) / max(1, seeds.select("id").distinct().join(ids, "id", "left_semi").count())).drop("s")
    base = cut(jump.join(out.withColumnRenamed("src", "id"), "id", "left"))
    rank = base.withColumn("rank", F.col("jump"))
    for i in range(rounds):
        sent = e.join(rank.select(F.col("id").alias("src"), (F.col("rank") / F.col("n")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        lost = rank.where("n is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = base.join(sent, "id", "left").join(F.broadcast(lost)).withColumn("rank", (1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump"))).select("id", "jump", "n", "rank")
        if i % 3 == 2:
            rank = cut(rank)
    return rank.select("id", "rank")


def label_propagation(edges: DataFrame, *, rounds: int = 5) -> DataFrame:
    """(id, community): each node takes the commonest label among its undirected neighbours, the smallest of equals, for a fixed number of rounds."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    e = cut(e.union(e.select("dst", "src")).distinct())
    lab = e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = e.join(lab.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        lab = cut(best.select(F.col("src").alias("id"), F.col("b.community").alias("community")))
    return lab


def shortest_paths(edges: DataFrame, start, *, most: int | None = None, relation: str | None = None) -> DataFrame:
    """(id, hops, path): a shortest path to every node within `most` hops (all that can be reached without it), the smallest in order among equals."""
    e = edges if relation is None else edges.where(F.col("label") == relation)
    e = e.select("src", "dst").distinct()
    key = dict(edges.dtypes)["src"]
    front = edges.sparkSession.createDataFrame([(start, 0, [start])], f"id {key}, hops int, path array<{key}>")
    out = front
    for hop in count(1) if most is None else range(1, most + 1):
        step = front.join(e, front["id"] == e["src"]).groupBy("dst").agg(F.min("path").alias("p"))
        step = step.select(F.col("dst").alias("id"), F.lit(hop).alias("hops"), F.concat("p", F.array("dst")).alias("path")).join(out.select("id"), "id", "left_anti")
        front = cut(step)
        if front.isEmpty():
            break
        out = out.union(front)
        if hop % 32 == 0:
            out = cut(out)
    return out


def chain(links: DataFrame, *, most: int | None = None) -> DataFrame:
    """(id, step, node): from every node along its first outgoing link (the smallest dst), until there is none or a node comes again, or after `most` steps."""
    first = cut(links.groupBy("src").agg(F.min("dst").alias("dst")))
    front = first.select(F.col("src").alias("id"), F.lit(0).alias("step"), F.col("src").alias("node"), F.array("src").alias("seen"))
    out = front.select("id", "step", "node")
    for step in count(1) if most is None else range(1, most + 1):
        nxt = front.join(first, front["node"] == first["src"]).where(~F.array_contains("seen", F.col("dst")))
        front = cut(nxt.select("id", F.lit(step).alias("step"), F.col("dst").alias("node"), F.concat("seen", F.array("dst")).alias("seen")))
        if front.isEmpty():
            break
        out = out.union(front.select("id", "step", "node"))
        if step % 32 == 0:
            out = cut(out)
    return out


def dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which an end is not among the ids (id), with the end that is missing."""
    known = ids.select("id").distinct()
    lost = lambda c: edges.join(known.withColumnRenamed("id", c), c, "left_anti").select("src", "dst", "label", F.lit(c).alias("missing"))
    return lost("src").union(lost("dst"))
