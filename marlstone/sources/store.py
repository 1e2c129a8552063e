"""Views of the memory store: current nodes, labelled edges, chunks, vectors, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators.hierarchy import clean_path
from marlstone.runtime import table

#: Types by tier (fixed values); a type in neither list counts as a fact.
LOGS = ("record", "event", "git_commit", "thought", "session")
FACTS = ("memory", "correction", "decision", "plan", "task", "review", "solution", "inspiration", "user_intent", "character_state")
SLICES = ("kb_chunk", "novel_chunk", "skill_chunk")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that are in the store: of each id the latest stay that has not ended, payload fields as columns."""
    p = lambda c: F.col(f"payload.{c}")
    last = Window.partitionBy("id").orderBy(F.desc("stored_at"))
    raw = table(spark, d, "nodes").where("deleted_at is null").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return raw.select(
        "id", p("type").alias("type"), p("label").alias("label"), F.coalesce(p("content"), F.lit("")).alias("content"), E.number(p("importance"), 0.5).alias("importance"),
        E.status(p("status")).alias("status"), p("status").alias("raw_status"), p("domain").alias("raw_domain"), E.node_domain(p("domain"), p("character_name")).alias("domain"),
        p("created_at").alias("created_at"), p("source").alias("source"), p("source_path").alias("source_path"), p("title").alias("title"), p("chunk_index").alias("chunk_index"),
        p("valid_at").alias("valid_at"), p("invalid_at").alias("invalid_at"), p("expired_at").alias("expired_at"), p("linked_from").alias("linked_from"),
        F.coalesce(p("hit_count"), F.lit(0)).alias("hit_count"), p("meta").alias("meta"), p("character_name").alias("character_name"), "stored_at",
    )


def label(relation: Column) -> Column:
    return F.upper(F.trim(relation))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labelled edges (src, dst, label, weight) between documents: a missing weight is 1, zero stays, of repeated edges the heaviest; no loops."""
    e = table(spark, d, "graph_edges").select(clean_path(F.col("source")).alias("src"), clean_path(F.col("target")).alias("dst"), label(F.col("relation")).alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return e.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst", "label").agg(F.max("weight").alias("weight"))


def hub(spark: SparkSession, d: str) -> str | None:
    """The page with edges to most others, the first of equals; none without edges."""
    n = edges(spark, d).groupBy("src").agg(F.count_distinct("dst").alias("n")).orderBy(F.desc("n"), "src").first()
    return n and n["src"]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The current chunk of each key, usable vectors only as `vector` (else null)."""
    c = table(spark, d, "node_chunks")
    cur = c.groupBy("node_id", "chunk_idx").agg(F.max_by(F.struct("chunk_text", "vector", "dim", "model"), F.struct("updated_at", F.xxhash64("chunk_text", "vector", "dim", "model"))).alias("v"), F.max("updated_at").alias("updated_at"))
    return cur.select("node_id", "chunk_idx", "v.*", "updated_at").withColumn("vector", F.when((F.size("vector") == F.col("dim")) & F.exists("vector", lambda x: x != 0), F.col("vector")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, v): the plain embeddings in double precision."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Each ingest request once, as first delivered."""
    r = table(spark, d, "mem_ingest_request")
    cols = [c for c in r.columns if c not in ("request_id", "received_at")]
    return r.groupBy("request_id").agg(F.min_by(F.struct(*cols), F.struct("received_at", F.xxhash64(*[F.map_entries(c) if t.startswith("map") else c for c, t in r.dtypes if c in cols]))).alias("v"), F.min("received_at").alias("received_at")).select("request_id", "v.*", "received_at")


def fact_links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): src REVISED_BY-links the older node dst it replaced."""
    f = table(spark, d, "mem_fact_history").select("node_id", "superseded")
    return f.select(F.col("node_id").alias("src"), F.explode("superseded").alias("dst")).where("src <> dst").distinct()
