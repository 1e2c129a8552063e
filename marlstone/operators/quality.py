"""Retrieval quality: recall, reciprocal rank, nDCG, hits, separability, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, recall, mrr, ndcg, hit) at k. results: qid, id, place (0-based). gold: qid, id, gain (1, or 0.5 for partial). A query without results scores 0."""
    top = results.where(F.col("place") < k).join(gold, ["qid", "id"]).select("qid", "id", "place", "gain")
    got = top.groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("place").alias("first"), F.sum(F.col("gain") / F.log2(F.col("place") + 2)).alias("dcg"))
    ideal = F.aggregate(F.zip_with(F.slice("gains", 1, k), F.sequence(F.lit(0), F.lit(k - 1)), lambda g, i: F.coalesce(g, F.lit(0.0)) / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)
    want = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.col("gain").cast("double")), asc=False).alias("gains"))  # gold ids of one question
    j = want.join(got, "qid", "left")
    found = F.coalesce("found", F.lit(0))
    return j.select(
        "qid", F.round(found / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"), (found > 0).cast("int").alias("hit"),
    )


def auc(scores: DataFrame) -> DataFrame:
    """(auc): the share of (positive, negative) pairs in the right order, ties a half. scores: score, label BOOLEAN; nulls drop out; null without either side.

    From counts per distinct score and a running sum over them, not from pairs:
    scores are range-partitioned, summed up inside their partition and moved on
    by the sums of the partitions before.
    """
    from pyspark.sql import Window

    from marlstone.runtime import cut

    per = scores.where("score is not null").groupBy("score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    parts = cut(per.repartitionByRange("score").withColumn("_p", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.groupBy("_p").agg(F.sum("neg").alias("neg")).select("_p", earlier(Window.orderBy("_p")).alias("_before"))  # one row a partition
    below = parts.withColumn("_in", earlier(Window.partitionBy("_p").orderBy("score"))).join(F.broadcast(before), "_p").withColumn("below", F.col("_before") + F.col("_in"))
    w = below.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return w.select(F.round(F.when(F.col("p") * F.col("n") > 0, F.col("u") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def paired_bootstrap(diffs: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, low, high, p) of per-query differences (qid, diff): n resamples, percentile interval, centred two-sided p.

    A resample is drawn by hashed Poisson weights per (query, resample), so
    each row makes its own draws and only n sums are shuffled.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "qid", "i")), 1, 8), 16, 10).cast("double") / 4_294_967_296
    cdf, weight, term = 0.0, F.lit(8), 0.36787944117144233
    marks = []
    for k in range(8):
        cdf += term
        marks.append((cdf, k))
        term /= k + 1
    for c, k in reversed(marks):
        weight = F.when(u < c, k).otherwise(weight)
    draws = diffs.select("qid", "diff", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("w", weight)
    means = draws.groupBy("i").agg((F.sum(F.col("w") * F.col("diff")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    mean = diffs.agg(F.avg("diff").alias("mean"))
    j = means.join(F.broadcast(mean))
    return j.agg(F.round(F.first("mean"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(F.avg((F.abs(F.col("m") - F.col("mean")) >= F.abs("mean")).cast("int")), 4).alias("p"))
