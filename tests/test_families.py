"""Dates, task states, query grams, filters and the query language on small fixtures."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import expr as E
from marlstone.functions import tasks as K
from marlstone.operators import fulltext as T
from marlstone.operators import indexing as I
from marlstone.operators import retrieval as X
from marlstone.operators import tql
from marlstone.operators import writes as W
from marlstone.operators.find import find

REF = "2026-09-05T10:00:00"
NAMED = [
    ("2026-09-07 交报告", REF, ["2026-09-07"]), ("2026年9月7日交报告", REF, ["2026-09-07"]), ("9月7日交报告", REF, ["2026-09-07"]), ("后天到驿站", REF, ["2026-09-07"]), ("明日交", REF, ["2026-09-06"]),
    ("今天盘点", REF, ["2026-09-05"]), ("大后天验收", REF, ["2026-09-08"]), ("三天后复查", REF, ["2026-09-08"]), ("三十天后交付", REF, ["2026-10-05"]), ("隔两天取件", REF, ["2026-09-07"]), ("过三天回访", REF, ["2026-09-08"]),
    ("两周后交稿", REF, ["2026-09-19"]), ("半个月后回访", REF, ["2026-09-20"]), ("半个星期后", REF, ["2026-09-08"]), ("三个星期之后", REF, ["2026-09-26"]), ("周三碰头", "2026-09-04T10:00:00", ["2026-09-09"]),
    ("这周三碰头", "2026-09-04T10:00:00", ["2026-09-09"]), ("下周三碰头", "2026-09-04T10:00:00", ["2026-09-09"]), ("下下周三碰头", "2026-09-04T10:00:00", ["2026-09-16"]), ("上周五复盘过", "2026-09-07T10:00:00", ["2026-09-04"]),
    ("礼拜天休息", "2026-09-07T10:00:00", ["2026-09-13"]), ("本月27号复查", REF, ["2026-09-27"]), ("27日复查", REF, ["2026-09-27"]), ("下个月5号对账", "2026-12-20T10:00:00", ["2027-01-05"]), ("月底对账", REF, ["2026-09-30"]),
    ("下个月底对账", REF, ["2026-10-31"]), ("月初盘点", REF, ["2026-09-01"]), ("下月初盘点", REF, ["2026-10-01"]), ("下周三碰头", "2026-01-30T10:00:00", ["2026-02-04"]), ("12月31日说明天就到", "2026-12-31T10:00:00", ["2026-12-31", "2027-01-01"]),
    ("二十七号要还书", REF, ["2026-09-27"]), ("十二号开工", REF, ["2026-09-12"]), ("每周三例会", REF, []), ("农历八月初八到家", REF, []), ("八月十七见", REF, []), ("节前三天交", REF, []), ("这个月31号复查", "2026-02-10T10:00:00", []),
    ("2月30日见面", "2026-02-10T10:00:00", []), ("无日期的普通句子", REF, []), ("", REF, []), (None, REF, []),
]


@pytest.mark.parametrize("text,ref,want", NAMED)
def test_named_dates(text, ref, want):
    assert [d.isoformat() for _, d in D.named_dates(text, datetime.fromisoformat(ref))] == want


@pytest.mark.parametrize("text,n", [("二十七", 27), ("十", 10), ("十二", 12), ("二十", 20), ("两", 2), ("27", 27), ("", None), (None, None), ("百", None), ("十百", None)])
def test_chinese_numbers(text, n):
    assert D.chinese_number(text) == n


def test_date_fields_and_reference(spark):
    rows = [(1, "今天说明天交", datetime(2026, 9, 5, 10), datetime(2030, 1, 1)), (2, "2026-09-01T08:00:00+08:00 后天", None, datetime(2030, 1, 1)), (3, "后天", None, datetime(2026, 9, 5)), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, event_time timestamp_ntz, created timestamp_ntz")
    f = df.select("id", D.date_fields(F.col("text"), D.reference_time(F.col("text"), F.col("event_time"), F.col("created"))).alias("f")).select("id", "f.*", D.due_within(F.col("f.due"), "2026-09-05", 1).alias("soon"))
    got = {r.id: (r.due, r.mention, r.soon) for r in f.collect()}
    assert got == {1: (["2026-09-06"], ["2026-09-05"], True), 2: (["2026-09-03"], ["2026-09-01"], False), 3: (["2026-09-07"], [], False), 4: (None, None, False)}
    assert date(2026, 9, 6).isoformat() == got[1][0][0]


STATES = [
    ("[部分完成] x", "doing"), ("[完成 2026-09-05]", "done"), ("【任务·计划（进行中）·挂起待续】", "doing"), ("T-73：… → [待办，2026-09-10 用户]", "todo"), ("[挂账，T-55 换脑落地后实施]", "blocked"), ("[未完成]", None),
    ("还没完成 [done]", None), ("[ Doing ]", "doing"), ("no mark\n[done]", None), ("[x] 【取消】", "canceled"), ("[未开始] [todo]", None), ("", None), (None, None),
]


def test_task_states(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(STATES)], "id int, content string")
    assert [r.s for r in df.select("id", K.parsed_state(F.col("content")).alias("s")).orderBy("id").collect()] == [s for _, s in STATES]
    notes = spark.createDataFrame([(1, "【★接续点·2026】"), (2, "[doing] 接续点 / 新聊天先读"), (3, "补写接续点"), (4, None)], "id int, content string")
    assert [bool(r.h) for r in notes.select("id", K.is_handoff(F.col("content")).alias("h")).orderBy("id").collect()] == [True, True, False, False]


def tasks(spark, rows):
    return spark.createDataFrame(rows, "id long, type string, status string, state string, kind string, legacy boolean, recovered boolean, project string, last_touched_at string, importance double, created_at double, content string, task_state string, title string")


def test_active_order_fold_patch(spark):
    t = tasks(spark, [
        (1, "task", "active", "todo", None, None, None, "p", "2026-01-02", 0.5, 5.0, "[待办] a", None, None), (2, "task", "active", "doing", None, None, None, None, None, 0.5, 1.0, "[doing]", None, "t"),
        (3, "task", "active", None, "handoff", None, False, None, None, 0.1, 9.0, "【接续点】", None, ""), (4, "task", "active", None, "handoff", None, True, None, None, 0.9, 10.0, "【接续点】", None, None),
        (5, "task", "active", "todo", None, True, None, None, None, 0.5, 1.0, "[todo]", None, None), (6, "memory", "active", "todo", None, None, None, None, None, 0.5, 1.0, "", None, None),
        (7, "task", "active", "todo", None, None, None, None, "2026-01-03", None, None, "x", "done", None), (8, "task", "active", "done", None, None, None, None, None, 0.5, 1.0, "[完成]", None, None),
    ])
    ids = lambda df: [r.id for r in df.select("id").collect()]
    assert sorted(ids(K.active(t))) == [1, 2, 7] and ids(K.active(t, project="p")) == [1] and 5 in ids(K.active(t, legacy=True))
    assert ids(K.active(t).orderBy(*K.order())) == [2, 7, 1]
    assert ids(K.active(t, handoff=True).orderBy(*K.order(handoff_first=True))) == [3, 2, 7, 1, 4]
    visible, summary = K.folded(t, F.lit(100.0) - F.col("created_at"), 96)
    assert sorted(ids(visible)) == [1, 3, 4, 7] and tuple(summary.first()) == (4, 2, 99)
    assert K.folded(t, F.lit(100.0) - F.col("created_at"), 0)[1].first().n == 0
    fill = {r.id: (r.state, r.needs_review, r.legacy, r.title) for r in K.backfilled(t).collect()}
    assert fill[1] == ("todo", False, False, "[待办] a") and fill[3] == ("unknown", True, False, "【接续点】") and fill[7] == ("done", False, True, "x") and fill[6] == ("unknown", True, True, "")
    patches = spark.createDataFrame([(1, "[完成]", None), (2, None, "blocked"), (8, "no mark", None)], "id long, content string, task_state string")
    after, log = K.patched(t, patches, "now")
    assert {tuple(r) for r in log.collect()} == {(1, "todo", "done", "now"), (2, "doing", "blocked", "now")}
    assert {r.id for r in after.where("last_touched_at = 'now'").collect()} == {1, 2, 8} and after.count() == 8


def test_query_grams_per_part(spark):
    qs = ["upgrade kernel 0.8.6 to 0.9", "ab", "你 好 a", "", None, "abcdefghijklmnopqrstuvwxyz0123456789", "图数据库0.8.6版遍历中取边锁冲突怎么解？"]
    df = spark.createDataFrame(list(enumerate(qs)), "i int, q string")
    got = {r.i: r.g for r in df.select("i", T.query_grams(F.col("q")).alias("g")).collect()}
    assert any("0.8" in g or ".8." in g for g in got[0]) and "0.9" in got[0] and got[1] == got[2] == got[3] == [] and not got[4]
    assert len(got[5]) == 12 and got[5][0] == "abc" and got[5][-1] == "789" and got[6][0] == "图数据" and got[6][-1] == "怎么解"
    texts = spark.createDataFrame([(1, "之前压测用的那些脚本都放在哪了"), (2, "Q-041 x"), (3, "50% off_y"), (4, None), (5, "")], "id long, content string")
    first = lambda q: [r.id for r in T.search(texts, q, 5).collect()]
    assert first("之前压测用的那些脚本都放在哪了") == [1] and first("q-041") == [2] and first("%") == [1, 2, 3, 5] and first("") == [] and first('a long one with "') == []
    assert T.search_with_status(None, "abc", 3) == (None, "degraded") and T.search_with_status(texts, " ", 3)[1] == "empty"
    assert {r.gram: r.tf for r in T.postings(spark.createDataFrame([(1, "aaaa😀b")], "id long, content string"), 2).collect()} == {"aa": 3, "a😀": 1, "😀b": 1}


def test_bm25_and_its_stored_form(spark):
    docs = spark.createDataFrame([(1, "banana bandana"), (2, "Anagram ana"), (3, "zzz"), (4, "ananas " * 50)], "id long, content string")
    want = {r.id: round(r.score, 9) for r in T.bm25(docs, ["ana", "ban"], 3).collect()}
    n, mean = docs.agg(F.count("*"), F.avg(F.char_length("content") - 2)).first()
    got = {r.id: round(r.score, 9) for r in T.bm25_stored(T.postings(docs, 3), n, mean, ["ana", "ban"]).collect()}
    assert got == want and set(want) == {1, 2, 4}


def test_exists_counts_null_values(spark):
    rows = spark.createDataFrame([(1, "a", {"k": None}), (2, None, {"k": "v"}), (3, "b", {}), (4, None, None)], "id int, folder string, meta map<string,string>")
    ids = lambda spec, within=None: sorted(r.id for r in find(rows, spec, within).collect())
    assert ids({"folder": {"$exists": True}}) == [1, 2, 3, 4] and ids({"folder": {"$exists": False}}) == [] and ids({"none": {"$exists": False}}) == [1, 2, 3, 4]
    assert ids({"k": {"$exists": True}}, "meta") == [1, 2] and ids({"k": {"$exists": False}}, "meta") == [3, 4] and ids({"k": "v"}, "meta") == [2]
    assert ids({"meta.k": "v"}) == [] and ids({"folder": None}) == [2, 4]


def test_distinct_and_aggregates_before_limit(spark):
    n = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id int, t string")
    q = lambda s: [tuple(r) for r in tql.query(s, n).collect()]
    assert sorted(q("FIND {} RETURN DISTINCT t LIMIT 2")) == [("a",), ("b",)]
    assert q("FIND {} RETURN DISTINCT t ORDER BY t DESC LIMIT 1") == [("b",)] and q("FIND {} RETURN COUNT(*) AS n LIMIT 1") == [(4,)]
    assert q("FIND {} RETURN id + 1 AS x ORDER BY id DESC LIMIT 2 OFFSET 1") == [(4,), (3,)]
    with pytest.raises(tql.QueryError):
        tql.query("FIND {} RETURN DISTINCT t ORDER BY id LIMIT 1", n)


def test_small_expressions(spark):
    df = spark.createDataFrame([("ok!!",), ("go ahead…",), ("/help",), ("okay then",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(E.trivial(F.col("t")).alias("x")).collect()] == [True, True, True, False, True, True]
    ex = spark.createDataFrame([("Pi is 3.14 or so and more words follow here",), ("One. Two\nthree four five six",), ("abcdefghijklmnopqrstuvwxyz",), ("short",)], "t string")
    assert [r.x for r in ex.select(E.excerpt(F.col("t"), 20).alias("x")).collect()] == ["Pi is 3.14 or so", "One. Two\nthree four", "abcdefghijklmnopqrst", "short"]
    s = spark.createDataFrame([({"1": " "}, "please fix it"), ({"1": "x"}, ""), (None, "hm"), (None, "帮我改一下")], "s map<string,string>, m string")
    assert [r.x for r in s.select(E.substantive(F.col("s"), F.col("m")).alias("x")).collect()] == [True, True, False, True]
    c = spark.createDataFrame([("sk-abcdefghijklmnop1234",), ("call 13812345678 now",), (" ",), (None,)], "c string")
    assert [(r.i, r.h) for r in c.select(W.issue(F.col("c")).alias("i"), W.secret_hints(F.col("c")).alias("h")).collect()] == [("secret", []), ("ok", ["phone"]), ("empty_content", []), ("malformed_node", [])]


def test_dispatcher_states(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, v array<double>")
    docs = spark.createDataFrame([(3, "gate gate"), (2, "a gate"), (1, "none")], "id long, content string")
    run = lambda d, m: X.dispatch(rows, d, [1.0, 0.0], "gate", mode=m, limit=3)
    got, state = run(docs, "cascade")
    assert [r.id for r in got.collect()] == [2, 3, 1] and state == {"mode": "cascade", "text": "ok"}
    assert run(docs, "x")[1]["mode"] == "rrf" and run(None, "rrf")[1]["text"] == "degraded" and [r.id for r in run(None, "rrf")[0].collect()] == [1, 2, 3]


def test_thoughts_sections_limits_and_finished(spark):
    df = spark.createDataFrame([("a <thought> 1. did: x\n2、 next\nmore\n3.\n1. again\n9. no </thought> b <thought>z</thought>",), ("<thought>open",), (None,)], "t string")
    got = df.select(E.thought(F.col("t")).alias("x")).select("x.*").collect()
    assert [(r.found, r.segments, r.unclosed) for r in got] == [(True, 2, False), (False, 0, True), (False, 0, False)]
    m = df.select(E.numbered_sections(E.thought(F.col("t"))["text"], ("done", "next", "risk")).alias("m")).collect()
    assert m[0].m == {"done": "again", "next": "next\nmore"} and m[1].m == {} and m[2].m == {}
    lim = spark.createDataFrame([("task:20000, Plan : 80000,bad,x:y",), ("",), (None,)], "t string")
    assert [r.m for r in lim.select(E.limits(F.col("t")).alias("m")).collect()] == [{"task": 20000, "plan": 80000}, {}, {}]
    f = spark.createDataFrame([("done", ""), ("active", "✅ 已完成"), ("active", "未已完成"), ("active", "预热已完成，待发布"), ("active", "【任务完成】 x"), ("active", None)], "s string, c string")
    assert [r.f for r in f.select(K.finished(F.col("s"), F.col("c")).alias("f")).collect()] == [True, True, False, False, True, False]


def test_index_plan_and_members(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 1.0), ("r", 1.0)], "path string, mtime double")
    new = spark.createDataFrame([("a", 1.5), ("b", 9.0), ("c", 1.0), ("e", 1.0), ("r", 1.0), ("q", 1.0)], "path string, mtime double")
    plan = lambda **how: {r.path: r.action for r in I.plan(old, new, retired=F.col("path").isin("r", "q"), **how).collect()}
    assert plan() == {"a": "skip", "b": "update", "c": "update", "d": "orphan", "e": "insert", "r": "retire"} and plan(full=True)["a"] == "update"
    members = I.upserted_members(spark.createDataFrame([("a", 0, 5), ("a", 1, 6), ("z", 0, 9)], "path string, member int, id long"), spark.createDataFrame([("a", 0), ("a", 2), ("n", 0)], "path string, member int"))
    assert {tuple(r) for r in members.collect()} == {("a", 0, 5, "update"), ("a", 1, 6, "delete"), ("a", 2, 10, "insert"), ("n", 0, 11, "insert")}
