from datetime import datetime

from pyspark.sql import functions as F

from marlstone.operators import references as R

REFS = "ref_table string, ref_key string, ref_field string, ref_id long, t timestamp_ntz, period string, id long"
PARENTS = "id long, stored_at timestamp_ntz, deleted_at timestamp_ntz, t string"


def day(n):
    return datetime(2025, 1, n)


def refs(spark, rows):
    return spark.createDataFrame([("a", k, "f", i, t, "x", 0) for k, i, t in rows], REFS)


def found(df):
    return sorted((r.ref_key, r.ref_id, r.period, r.reason) for r in df.collect())


def test_reasons_and_boundaries(spark):
    parents = spark.createDataFrame([(1, day(2), day(5), ""), (1, day(8), None, ""), (2, day(20), None, ""), (None, day(1), None, ""), (3, None, None, "")], PARENTS)
    rows = [("at start", 1, day(2)), ("at end", 1, day(5)), ("before", 1, day(1)), ("again", 1, day(9)), ("late", 2, day(3)), ("never", 9, day(3)), ("unstored", 3, day(3)), ("null id", None, day(3)), ("null t", 1, None)]
    got = found(R.orphan_references(refs(spark, rows + rows), parents))
    assert got == [("at end", 1, "2025-01", "deleted"), ("before", 1, "2025-01", "late"), ("late", 2, "2025-01", "late"), ("never", 9, "2025-01", "missing"), ("null t", 1, None, "missing"), ("unstored", 3, "2025-01", "missing")]


def test_overlapping_stays_and_equal_times(spark):
    parents = spark.createDataFrame([(1, day(1), day(20), ""), (1, day(3), day(4), ""), (1, day(3), day(4), "")], PARENTS)
    assert found(R.orphan_references(refs(spark, [("x", 1, day(10)), ("y", 1, day(3))]), parents)) == []


def test_hot_id_is_salted_and_whole(spark):
    parents = spark.createDataFrame([(1, day(2), None, "")], PARENTS)
    hot = spark.range(500).select(F.lit("a").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), F.lit("f").alias("ref_field"), F.lit(1).cast("long").alias("ref_id"), F.when(F.col("id") < 7, F.lit(day(1))).otherwise(F.lit(day(3))).cast("timestamp_ntz").alias("t"))
    assert len(found(R.orphan_references(hot, parents, hot_rows=100, salts=8))) == 7


def test_empty_tables(spark):
    none, parents = refs(spark, []), spark.createDataFrame([], PARENTS)
    assert found(R.orphan_references(none, parents)) == []
    assert found(R.orphan_references(refs(spark, [("x", 1, day(1))]), parents)) == [("x", 1, "2025-01", "missing")]


def test_digit_runs(spark):
    df = spark.createDataFrame([("1003,#1006",), ("７８，9",), ("none",), (None,), ("99999999999999999999999 5",)], "s string")
    assert [r[0] for r in df.select(R.digit_runs(F.col("s"))).collect()] == [[1003, 1006], [78, 9], [], None, [5]]
