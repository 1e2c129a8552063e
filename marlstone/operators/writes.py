"""Writes to the store as transforms: gates, inserts, updates, packs, session capsules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators.ranking import global_place

#: Keys that may not be stored, and numbers that are only marked.
STRONG = "sk-[A-Za-z0-9]{16,}"
WEAK = {"phone": r"(^|\D)1[3-9]\d{9}(\D|$)", "id_card": r"(^|\D)\d{17}[\dXx](\D|$)"}


def is_protected(flag: Column, kind: Column, kinds: tuple) -> Column:
    """Marked as protected, or of a protected type whatever its case and blanks."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(F.trim(kind)).isin(*kinds), F.lit(False))


def query_verdict(query: Column, most: int = 8_000) -> Column:
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "empty").when(F.char_length(query) > most, "too_long").otherwise("ok")


def issue(content: Column) -> Column:
    """What keeps a text out of the store: 'malformed_node' (none), 'empty_content', 'secret'; else 'ok'."""
    return F.when(content.isNull(), "malformed_node").when(F.trim(content) == "", "empty_content").when(content.rlike(STRONG), "secret").otherwise("ok")


def secret_hints(content: Column) -> Column:
    """Names of the weak marks of secrets in a text."""
    return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(k)) for k, p in WEAK.items()]))


def pack_summary(nodes: DataFrame, preview: int = 80) -> DataFrame:
    return nodes.select("id", F.substring("content", 1, preview).alias("preview"), F.char_length("content").cast("bigint").alias("chars"))


def inserted(nodes: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New nodes (key, content, type, importance, domain) that no gate keeps out, with ids after the largest there is, defaults and secret_hint; in an empty store ids begin with 1."""
    good = new.where(issue(F.col("content")) == "ok")
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    rows = global_place(good.select(key, "content", blank("type", "memory").alias("type"), F.coalesce("importance", F.lit(0.5)).alias("importance"), blank(F.lower("domain"), "general").alias("domain"), F.lit("active").alias("status"), secret_hints(F.col("content")).alias("secret_hint")), key)
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return rows.join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("place")).drop("top", "place")


def with_contents(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """Nodes with new contents (id, content, one row an id); vector_stale where the text is another now."""
    j = nodes.join(contents.select("id", F.col("content").alias("_new")), "id", "left")
    return j.withColumn("vector_stale", F.coalesce(F.col("_new") != F.col("content"), F.lit(False))).withColumn("content", F.coalesce("_new", "content")).drop("_new")


def upserted(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows with those of `new` (one a key) in place of the ones they share a key with, and added where there is none."""
    return rows.join(new.select(*key), key, "left_anti").unionByName(new)


def within_lines(parts: DataFrame, group: list[str], order: str, text: str, most: int) -> DataFrame:
    """Parts of each group in order while the sum of their lines, as `lines`, stays within `most`."""
    n = F.size(F.split(text, "\n"))
    return parts.withColumn("lines", F.sum(n).over(Window.partitionBy(*group).orderBy(order))).where(F.col("lines") <= most)


def buffer_reason(session: Column, sections: Column, message: Column) -> Column:
    """Why a turn is not kept: 'no_session_id', 'no_sections', 'non_substantive'; blank if it is."""
    filled = F.coalesce(F.exists(F.map_values(sections), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), F.lit(False))
    return F.when(F.trim(F.coalesce(session, F.lit(""))) == "", "no_session_id").when(~filled, "no_sections").when(~E.substantive(sections, message), "non_substantive").otherwise("")


def capsules(turns: DataFrame, session: str, turn: str, tie: str, sections: str) -> DataFrame:
    """(session, sections array<(k, v)>, thickness): of each section the last turn's text that is not blank, by name; sections are few."""
    s = turns.select(session, turn, tie, F.explode(sections).alias("k", "v")).where("trim(v) <> ''")
    last = s.groupBy(session, "k").agg(F.max_by("v", F.struct(turn, tie)).alias("v"))
    return last.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("sections"), F.count(F.lit(1)).alias("thickness"))


def ingested(requests: DataFrame, nodes: DataFrame, *, now: float, timed: tuple = ("memory", "task", "plan"), most: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(results, outdated) of a batch of ingest statements.

    requests: request_id, content, type, importance, domain, replaces, dedupe,
    dedupe_target, event_time. Gates in order: the text's issue, its length, a
    stated dedupe. results: request_id, action ('rejected', 'duplicate',
    'merged', 'stored'), node_id (the target, or a new id after the largest),
    issue, importance, domain, valid_at (the event's epoch seconds, else now,
    for types that have validity). outdated (id, by, invalid_at): nodes that a
    stored request names in `replaces`, the first to name it.
    """
    c, target = F.col("content"), F.col("dedupe_target")
    how = F.lower(F.trim(F.coalesce("dedupe", F.lit(""))))
    bad = issue(c)
    action = F.when(bad != "ok", "rejected").when(F.char_length(F.trim(c)) > most, "rejected").when((how == "reject") & target.isNotNull(), "duplicate").when((how == "merge") & target.isNotNull(), "merged").otherwise("stored")
    kind = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("memory"))
    valid = F.when(kind.isin(*timed), F.coalesce(F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6, F.lit(now)))
    r = requests.select(
        "request_id", action.alias("action"), target.alias("_target"), F.when((bad == "ok") & (action == "rejected"), "too_long").otherwise(bad).alias("issue"), F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("general")).alias("domain"), valid.alias("valid_at"), "replaces",
    )
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = global_place(r.where("action = 'stored'").select("request_id"), "request_id").join(F.broadcast(top)).select("request_id", (F.col("top") + F.col("place")).alias("_new"))
    done = r.join(new, "request_id", "left").withColumn("node_id", F.when(F.col("action") == "stored", F.col("_new")).when(F.col("action") != "rejected", F.col("_target")))
    named = done.where("action = 'stored'").select("request_id", "node_id", "valid_at", F.explode(F.regexp_extract_all(F.coalesce("replaces", F.lit("")), F.lit(r"(\d+)"), F.lit(1))).alias("id")).withColumn("id", F.col("id").try_cast("bigint"))
    first = named.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("node_id", "valid_at"), "request_id").alias("b"))
    return done.select("request_id", "action", "node_id", "issue", "importance", "domain", "valid_at"), first.select("id", F.col("b.node_id").alias("by"), F.coalesce("b.valid_at", F.lit(now)).alias("invalid_at"))
