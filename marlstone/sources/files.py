"""Files as sources and sinks: Markdown trees, git logs, JSON lines, memory packs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as E


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths directly below a folder of any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return [str(s.getPath()) for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, content) of every .md file below root, front matter taken off; one row a file, read where it lies."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return raw.select("path", F.col("modificationTime").alias("modified"), E.strip_front_matter(F.decode("content", "UTF-8")).alias("content"))


def tree_changes(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): new, changed or gone, from the modification times of found and known (path, modified)."""
    here = lambda df, c: df.select("path", F.struct("modified").alias(c))
    j = here(found, "a").join(here(known, "b"), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(~F.col("a.modified").eqNullSafe(F.col("b.modified")), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def git_log(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(commit, date, subject) of lines `hash|date|subject`; the subject may hold further bars. Known commits (commit) are left out."""
    parts = F.split("value", r"\|", 3)
    log = spark.read.text(path).where(F.size(parts) == 3).select(parts[0].alias("commit"), parts[1].alias("date"), parts[2].alias("subject"))
    return log if known is None else log.join(known, "commit", "left_anti")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that are no JSON or lack a numeric ts are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("ts is not null")


_PACK = "format string, format_version int, manifest struct<name: string, node_total: long>, nodes array<struct<node_id: long, payload: map<string, string>>>, edges array<struct<source_id: long, target_id: long, label: string, weight: double>>"


def pack_verdict(spark: SparkSession, path: str, format_name: str) -> DataFrame:
    """(path, code) of pack files: ok, not_json, not_a_pack, unsupported_version or malformed."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", _PACK).alias("p"), F.try_parse_json("value").alias("v"))
    code = (
        F.when(F.col("v").isNull(), "not_json").when(F.coalesce(F.col("p.format"), F.lit("")) != format_name, "not_a_pack")
        .when(F.coalesce(F.col("p.format_version"), F.lit(0)) != 1, "unsupported_version").when(F.col("p.nodes").isNull(), "malformed").otherwise("ok")
    )
    return raw.select("path", code.alias("code"))


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a pack file."""
    p = spark.read.text(path, wholetext=True).select(F.from_json("value", _PACK).alias("p"))
    nodes = p.select(F.explode("p.nodes").alias("n")).select("n.node_id", F.col("n.payload")["type"].alias("type"), F.col("n.payload")["content"].alias("content"))
    edges = p.select(F.explode("p.edges").alias("e")).select(F.col("e.source_id").alias("src"), F.col("e.target_id").alias("dst"), F.col("e.label").alias("label"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return nodes, edges


def import_pack(nodes: DataFrame, edges: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with new ids after `top`, and the edges both of whose ends came along."""
    from marlstone.operators.ranking import global_place

    placed = global_place(nodes, "node_id").withColumn("id", F.col("place") + top)
    ids = placed.select("node_id", "id")
    moved = edges.join(ids.select(F.col("node_id").alias("src"), F.col("id").alias("new_src")), "src").join(ids.select(F.col("node_id").alias("dst"), F.col("id").alias("new_dst")), "dst")
    return placed.drop("place"), moved.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "label", "weight")


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Write a frame as parquet, json, csv or orc."""
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(partition_by) if partition_by else w).save(path)
