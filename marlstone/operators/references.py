"""References to records that do not exist (problem 6).

References and the validity intervals of their parents are co-partitioned by
the parent's id and sorted by time; one pass over each merged stream carries
the latest end of any interval begun so far. All of it stays in the JVM: the
merge is a running aggregate over a sorted window, one shuffle in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An end that no time reaches, for parents that are still there.
_OPEN = "9999-12-31 23:59:59"


def digit_runs(text: Column) -> Column:
    """Every run of digits in a free-form text as BIGINT; runs too long for one are left out."""
    ascii_text = F.translate(text, "０１２３４５６７８９", "0123456789")
    runs = F.regexp_extract_all(ascii_text, F.lit("[0-9]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def _hot_ids(refs: DataFrame, least: int, share: int) -> list:
    """Ids that more than 1/share of all references name; at most `share` of them by construction."""
    counts = refs.groupBy("ref_id").count()
    top = counts.where(F.col("count") > least).orderBy(F.desc("count")).limit(share).collect()
    if not top:
        return []
    total = refs.count()
    return [r["ref_id"] for r in top if r["count"] * share > total]


def orphan_references(refs: DataFrame, parents: DataFrame, *, hot_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """References without a parent at their time, with the reason.

    refs: ref_table, ref_key, ref_field, ref_id BIGINT, t TIMESTAMP (other columns are ignored).
    parents: id BIGINT, stored_at, deleted_at (null: still there).
    Result: the distinct references with `period` ('YYYY-MM' of t) and `reason`:
    'missing' (no such parent ever), 'late' (stored only after t), 'deleted'
    (stored before t, gone at t).

    A null ref_id names nothing and is left out. A null t has no parent at that
    time: the reference is reported with a null period. Parents without id or
    stored_at never count. Repeated rows on either side count once. Empty
    inputs give an empty result, or all references. An id that more than
    1/256 of the references (and over `hot_rows` rows) name is salted; only
    its own intervals are repeated per salt.
    """
    r = refs.select("ref_table", "ref_key", "ref_field", "ref_id", F.col("t").cast("timestamp_ntz").alias("t")).where("ref_id is not null").distinct()
    p = (
        parents.select("id", F.col("stored_at").cast("timestamp_ntz").alias("stored_at"), F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.lit(_OPEN).cast("timestamp_ntz")).alias("ends"))
        .where("id is not null and stored_at is not null")
        .groupBy("id", "stored_at")
        .agg(F.max("ends").alias("ends"))
    )
    hot = _hot_ids(r, hot_rows, 256)
    salt = F.when(F.col("ref_id").isin(hot), F.pmod(F.xxhash64("ref_table", "ref_key", "ref_field"), F.lit(salts))) if hot else F.lit(None).cast("bigint")
    every = F.when(F.col("id").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    left = p.select(
        "id", F.explode(every.cast("array<bigint>")).alias("salt"), F.col("stored_at").alias("at"), F.lit(0).alias("side"), "ends",
        *[F.lit(None).cast(t).alias(c) for c, t in r.dtypes if c in ("ref_table", "ref_key", "ref_field")],
    )
    right = r.select(
        F.col("ref_id").alias("id"), F.coalesce(salt, F.lit(0)).cast("bigint").alias("salt"), F.col("t").alias("at"), F.lit(1).alias("side"),
        F.lit(None).cast("timestamp_ntz").alias("ends"), "ref_table", "ref_key", "ref_field",
    )
    stream = Window.partitionBy("id", "salt").orderBy("at", "side")
    so_far = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("id", "salt").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = (
        left.unionByName(right)
        .withColumn("until", F.max("ends").over(so_far))
        .withColumn("later", F.max(F.when(F.col("side") == 0, F.lit(1))).over(ahead))
        .where(F.col("side") == 1)
        .where(F.col("at").isNull() | F.col("until").isNull() | (F.col("until") <= F.col("at")))
    )
    reason = F.when(F.col("at").isNull(), "missing").when(F.col("until").isNotNull(), "deleted").when(F.col("later") == 1, "late").otherwise("missing")
    return merged.select("ref_table", "ref_key", "ref_field", F.col("id").alias("ref_id"), F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return orphans.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_ids"))
