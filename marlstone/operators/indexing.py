"""Index builds as set differences: which files to build again, retire or drop; members kept under their ids; vectors still to be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import global_place

#: Seconds by which two times of change may differ and still be one.
TOLERANCE = 1.0


def plan(index: DataFrame, files: DataFrame, *, retired: Column | None = None, tolerance: float = TOLERANCE, full: bool = False) -> DataFrame:
    """(path, action) for an index (path, mtime) and the files there are (path, mtime): 'insert', 'update', 'skip', 'orphan' (no such file) or 'retire'.

    An entry without a time is built again, as is all with `full`. `retired` is
    a condition on the path of files that are there and shall not be; they get
    'retire' if they are indexed and no row if not.
    """
    i = index.select("path", F.col("mtime").alias("_old"), F.lit(True).alias("_i"))
    j = i.join(files.select("path", F.col("mtime").alias("_new"), F.lit(True).alias("_f")), "path", "full_outer")
    gone = F.lit(False) if retired is None else retired
    same = F.coalesce(F.abs(F.col("_old") - F.col("_new")) <= tolerance, F.lit(False)) & F.lit(not full)
    action = F.when(F.col("_f").isNull(), "orphan").when(gone, F.when(F.col("_i"), "retire")).when(F.col("_i").isNull(), "insert").when(same, "skip").otherwise("update")
    return j.select("path", action.alias("action")).where("action is not null")


def upserted_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, member, id, action) of files built again: old members (path, member, id) keep their ids under the new ones (path, member), surplus ones are deleted, further ones get ids after the largest."""
    files = new.select("path").distinct()
    j = old.join(files, "path", "left_semi").select("path", "member", "id").join(new.select("path", "member", F.lit(True).alias("_n")), ["path", "member"], "full_outer")
    kept = j.where("id is not null").select("path", "member", "id", F.when(F.col("_n"), "update").otherwise("delete").alias("action"))
    added = global_place(j.where("id is null").select("path", "member"), "path", "member")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return kept.unionByName(added.join(F.broadcast(top)).select("path", "member", (F.col("top") + F.col("place")).alias("id"), F.lit("insert").alias("action")))


def to_embed(chunks: DataFrame, model: str, done: DataFrame | None = None) -> DataFrame:
    """(node_id, chunk_idx, reason) of chunks (node_id, chunk_idx, chunk_text, vector, model) whose vector is 'missing' or of another model ('stale'), without those a broken-off run has done (node_id, chunk_idx); blank texts need none."""
    reason = F.when(F.col("vector").isNull(), "missing").when(~F.coalesce(F.col("model") == model, F.lit(False)), "stale")
    todo = chunks.where(F.trim(F.coalesce("chunk_text", F.lit(""))) != "").select("node_id", "chunk_idx", reason.alias("reason")).where("reason is not null")
    return todo if done is None else todo.join(done.select("node_id", "chunk_idx"), ["node_id", "chunk_idx"], "left_anti")
