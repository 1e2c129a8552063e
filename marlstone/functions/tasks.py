"""States of tasks: read from a text's marks, in effect, filtered, ordered, folded and filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for a state inside a mark, earlier ones first where two begin at one place; words that void a mark; what sets a hand-over note apart.
WORDS = (
    ("部分完成", "doing"), ("已拍板·待执行", "todo"), ("进行中", "doing"), ("已开工", "doing"), ("开工", "doing"), ("挂起", "blocked"), ("挂账", "blocked"), ("阻塞", "blocked"), ("落地", "doing"),
    ("待办", "todo"), ("待批准", "todo"), ("待执行", "todo"), ("待启动", "todo"), ("计划中", "todo"), ("待决策", "todo"), ("已完成", "done"), ("完成", "done"), ("取消", "canceled"),
    ("todo", "todo"), ("doing", "doing"), ("blocked", "blocked"), ("done", "done"), ("canceled", "canceled"),
)
VOID = ("未完成", "还没", "尚未", "未开始", "未能", "暂未", "没有完成")
HANDOFF = "接续点"
STATES = ("todo", "doing", "blocked", "done", "canceled", "unknown")
ACTIVE = ("todo", "doing", "blocked")
#: How pressing a state is; all others come after.
PRESSING = ("doing", "blocked", "todo")


def first_line(content: Column) -> Column:
    return F.split_part(F.coalesce(content, F.lit("")), F.lit("\n"), F.lit(1))


def parsed_state(content: Column) -> Column:
    """The state that the first line's marks [..] and 【..】 name; null if none does.

    Marks are tried in their order. In a mark the word that begins first
    counts. A mark that holds a voiding word, or follows one, is passed over.
    """
    line = first_line(content)

    def marks(pattern: str, a: str, b: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda m: F.struct(F.position(F.concat(F.lit(a), m, F.lit(b)), line).alias("at"), m.alias("text")))

    def locate(word: str, text: Column) -> Column:
        return F.position(F.lit(word), text)

    def state(mark: Column) -> Column:
        text = F.lower(F.regexp_replace(mark["text"], r"\s+", ""))
        found = F.array(*[F.when(locate(w, text) > 0, F.struct(locate(w, text).alias("at"), F.lit(i).alias("i"), F.lit(s).alias("state"))) for i, (w, s) in enumerate(WORDS)])
        void = F.lit(False)
        for w in VOID:
            void = void | mark["text"].contains(w) | F.substring(line, F.lit(1), mark["at"] - 1).contains(w)
        return F.when(~void, F.array_min(F.filter(found, lambda x: x.isNotNull()))["state"])

    both = F.array_sort(F.array_union(marks(r"\[([^\[\]\n]*)\]", "[", "]"), marks(r"【([^【】\n]*)】", "【", "】")))
    return F.get(F.filter(F.transform(both, state), lambda s: s.isNotNull()), F.lit(0))


def is_handoff(content: Column) -> Column:
    """The first line, after blanks, marks in brackets and ornaments, begins with the word for a hand-over note."""
    return first_line(content).rlike(r"^\s*(?:\[[^\[\]]*\]\s*)*[【★\s]*" + HANDOFF)


def effective_state(field: Column, content: Column) -> Column:
    """The stored state, else the one the text names; null if neither."""
    return F.coalesce(F.nullif(F.trim(field), F.lit("")), parsed_state(content))


def active(tasks: DataFrame, *, states: tuple = ACTIVE, project: str = "", legacy: bool = False, handoff: bool = False) -> DataFrame:
    """Tasks (type, status, state, kind, legacy, project) in one of the states; hand-over notes have no state and come only when asked for, whatever it is."""
    note = F.coalesce(F.col("kind") == "handoff", F.lit(False))
    ok = (F.col("type") == "task") & (F.col("status") == "active") & F.when(note, F.lit(handoff)).otherwise(F.coalesce(F.col("state").isin(*states), F.lit(False)))
    if not legacy:
        ok = ok & ~F.coalesce(F.col("legacy"), F.lit(False))
    return tasks.where(ok & (F.lit(True) if not project else F.col("project") == project))


def urgency(state: Column) -> Column:
    """0 for the most pressing state, one more for each after, the rest last."""
    place = F.array_position(F.array(*[F.lit(s) for s in PRESSING]), state)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(PRESSING)).otherwise(place - 1).cast("int")


def order(handoff_first: bool = False) -> list[Column]:
    """Sort keys: state, last touched (missing last), importance, id; with hand-over notes before all, the newest first, recovered ones not."""
    usual = [urgency(F.col("state")).asc(), F.coalesce("last_touched_at", F.lit("")).desc(), F.coalesce("importance", F.lit(0.0)).desc(), F.desc("id")]
    if not handoff_first:
        return usual
    top = F.coalesce((F.col("kind") == "handoff") & ~F.coalesce(F.col("recovered"), F.lit(False)), F.lit(False))
    of = lambda c: F.when(top, c)
    return [top.desc(), of(F.coalesce("created_at", F.col("id").cast("double"))).desc(), of(F.coalesce("importance", F.lit(0.0))).desc(), of(F.col("id")).desc(), *usual]


def folded(tasks: DataFrame, age_days: Column, fresh: float = 30) -> tuple[DataFrame, DataFrame]:
    """(visible, summary): tasks older than `fresh` days go into one row (n, oldest_id, oldest_days); hand-over notes and tasks without an age stay. fresh <= 0 folds none."""
    old = F.coalesce((age_days > fresh) & ~F.coalesce(F.col("kind") == "handoff", F.lit(False)), F.lit(False)) if fresh > 0 else F.lit(False)
    summary = tasks.where(old).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct((-age_days).alias("a"), "id")).alias("oldest_id"), F.floor(F.max(age_days)).cast("bigint").alias("oldest_days"))
    return tasks.where(~old), summary


def backfilled(tasks: DataFrame) -> DataFrame:
    """(id, state, needs_review, legacy, title) as filled in for tasks (id, content, kind, title, task_state): a state that nothing names is unknown and to be reviewed; ended and unknown ones are legacy unless hand-over notes; a blank title is the first line's first 40 characters."""
    state = F.coalesce(effective_state(F.col("task_state"), F.col("content")), F.lit("unknown"))
    note = F.coalesce(F.col("kind") == "handoff", F.lit(False)) | is_handoff(F.col("content"))
    return tasks.select("id", state.alias("state"), (state == "unknown").alias("needs_review"), (state.isin("done", "canceled", "unknown") & ~note).alias("legacy"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.substring(F.trim(first_line(F.col("content"))), 1, 40)).alias("title"))


def patched(tasks: DataFrame, patches: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, log) after patches (id, content, task_state): an explicit state goes before one that the new text names, that before the old one; whoever is patched is touched now, and a change of state is a log row (id, before, after, at)."""
    p = patches.select("id", F.col("content").alias("_content"), F.col("task_state").alias("_state"), F.lit(True).alias("_p"))
    j = tasks.join(p, "id", "left")
    old = effective_state(F.col("task_state"), F.col("content"))
    new = F.coalesce(F.nullif(F.trim("_state"), F.lit("")), parsed_state(F.col("_content")), old)
    j = j.withColumns({"_old": old, "_new": F.when(F.col("_p"), new).otherwise(F.col("task_state"))})
    log = j.where("_p").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("id", F.col("_old").alias("before"), F.col("_new").alias("after"), F.lit(now).alias("at"))
    out = j.withColumns({"content": F.coalesce("_content", "content"), "task_state": F.col("_new"), "last_touched_at": F.when(F.col("_p"), F.lit(now)).otherwise(F.col("last_touched_at"))})
    return out.drop("_content", "_state", "_p", "_old", "_new"), log


#: States and marks of a finished task, and words that show one is not.
FINISHED = ("completed", "done")
_FINISHED_MARK = r"(?<!未)已完成|完成】\s*$|^\s*【[^【\n]*完成"
_PENDING = ("未完成", "等发布", "待发布", "等待发布", "待启动", "进行中", "计划中", "未启动")


def finished(st: Column, content: Column) -> Column:
    """By its status, else by a mark in the text, unless a word in it says that something is pending."""
    text, pending = F.coalesce(content, F.lit("")), F.lit(False)
    for w in _PENDING:
        pending = pending | text.contains(w)
    return F.coalesce(F.lower(F.trim(st)).isin(*FINISHED), F.lit(False)) | (~pending & text.rlike(_FINISHED_MARK))
