"""Exact vector search: nearest rows of a query, and joins by cosine without all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E

#: Pivots of a similarity join, drawn by a hash of the id; what is broadcast is at most so many vectors.
PIVOTS, CELL_BLOCK = 64, 2_048


def nearest(rows: DataFrame, query: list[float], k: int, *, least: float | None = None) -> DataFrame:
    """The k rows (id, v, ...) most similar to one query vector, with `score`; ties go to the smaller id. A running top k, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.size("v") == len(query)).withColumn("score", E.cosine(F.col("v"), q))
    return (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.desc("score"), "id").limit(k)


def similar_rows(rows: DataFrame, *, least: float, gate: str | None = None) -> DataFrame:
    """(a, b, score), a < b: all pairs of rows (id BIGINT, v ARRAY<DOUBLE>) with a cosine of at least `least`, exactly.

    Rows live in the cell of their nearest pivot. A row within the angle t of
    another is at most 2t further from the other's pivot than from its own, so
    it is also sent to those cells and to no more. Rows of one cell are cut
    into blocks, and each pair of blocks is a task of its own. Null and zero
    vectors are similar to nothing. `gate`: only rows with an equal value of
    that column meet, none with null; it parts them before any vector is sent.
    """
    good = rows.where("id is not null and v is not null").where(E.norm(F.col("v")) > 0)
    good = good.where(F.col(gate).isNotNull()) if gate else good
    good = good.select("id", "v", (F.xxhash64(gate) if gate else F.lit(0).cast("bigint")).alias("gate"))
    pivots = good.orderBy(F.xxhash64("id")).limit(PIVOTS).select("v").toPandas()["v"].tolist()
    if not pivots:
        return rows.sparkSession.createDataFrame([], "a bigint, b bigint, score double")
    p = np.stack(pivots)
    p = p / np.linalg.norm(p, axis=1, keepdims=True)
    reach = 2 * float(np.arccos(np.clip(least, -1, 1))) + 1e-6

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for i in range(0, len(big), 512):
                b = big.iloc[i : i + 512]
                x = np.stack(b["v"].to_numpy())
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                angle = np.arccos(np.clip(x @ p.T, -1, 1))
                home = angle.argmin(1)
                r, c = np.nonzero(angle <= angle.min(1, keepdims=True) + reach)
                yield pd.DataFrame({"cell": c, "home": c == home[r], "id": b["id"].to_numpy()[r], "gate": b["gate"].to_numpy()[r], "v": list(x[r])})

    placed = good.mapInPandas(place, "cell int, home boolean, id bigint, gate bigint, v array<double>")
    sizes = placed.groupBy("gate", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).cast("int").alias("n"))  # at most PIVOTS rows a gate
    cut_up = placed.join(sizes if gate else F.broadcast(sizes), ["gate", "cell"]).withColumn("block", F.pmod(F.hash("id"), F.col("n")))
    left = cut_up.where("home").select("gate", "cell", "id", "v", F.lit(True).alias("home"), F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"))
    right = cut_up.select("gate", "cell", "id", "v", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"), F.col("block").alias("y"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["home"]], pdf[~pdf["home"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": [], "score": []})
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        r, c = np.nonzero(s >= least - 1e-12)
        x, y = a["id"].to_numpy()[r], b["id"].to_numpy()[c]
        keep = x != y
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "score": s[r, c][keep]})

    found = left.unionByName(right).groupBy("gate", "cell", "x", "y").applyInPandas(meet, "a bigint, b bigint, score double")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, score, rank): the k best partners of each end of undirected pairs (a, b, score)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(pairs.select("b", "a", "score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


def pool(chunks: DataFrame) -> DataFrame:
    """(id, v): one unit vector per id, the mean of its chunks' vectors weighted by tokens. chunks: id, v, weight."""
    parts = chunks.select("id", "weight", F.posexplode("v").alias("i", "x")).groupBy("id", "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"))
    rows = parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))  # as many as the vector is long
    return rows.select("id", F.transform("m", lambda x: x / E.norm(F.col("m"))).alias("v"))


def hashed_pairs(texts: DataFrame, dim: int) -> DataFrame:
    """(id, bucket, value): a unit vector per text (id, text) from the hashes of its character pairs, blanks around it; only filled places are rows. Null texts give none."""
    padded = F.concat(F.lit(" "), "text", F.lit(" "))
    pair = F.explode(F.regexp_extract_all(padded, F.lit("(?s)(?=(..))."), F.lit(1)))
    bucket = F.conv(F.substring(F.md5("pair"), 1, 4), 16, 10).cast("int") % dim
    n = texts.select("id", pair.alias("pair")).groupBy("id", bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.select("id", "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))).alias("value"))  # at most dim rows a text
