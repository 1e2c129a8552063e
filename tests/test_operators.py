import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import chunks as K
from marlstone.functions import expr as E
from marlstone.operators import conflict as C
from marlstone.operators import find as FI
from marlstone.operators import graph as G
from marlstone.operators import quality as Q
from marlstone.operators import tql
from marlstone.operators import vector as V
from marlstone.operators.ranking import global_lead, global_place
from marlstone.plans import more, relations, scans
from marlstone.sources import files


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "REL", 1.0) for a, b in rows], "src long, dst long, label string, weight double")


RING = [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (5, 6), (6, 7), (7, 8), (8, 5)]


def test_components_and_ranks(spark):
    e = edges(spark, RING)
    assert {r.id: r.component for r in G.components(e).collect()} == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 9), 5)}
    assert G.components(edges(spark, [])).collect() == []
    ranks = {r.id: r.rank for r in G.pagerank(e, rounds=20).collect()}
    assert len(ranks) == 9 and abs(sum(ranks.values()) - 1) < 1e-9 and ranks[0] == max(ranks.values())
    assert {r.id for r in G.label_propagation(e).collect()} == set(range(9))


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    got = G.components(edges(spark, list(zip(ids, ids[1:])))).collect()
    assert {r.component for r in got} == {0} and len(got) == 200


def test_all_components_cover_every_label(spark, tmp_path):
    rows = [("a.md", "b.md", "CAUSES"), ("b.md", "c.md", "NEXT"), ("d.md", "e.md", "WIKI_LINK"), ("f.md", "e.md", "PART_OF"), ("g.md", "h.md", "CAUSES")]
    spark.createDataFrame([(*r, 1.0) for r in rows], "source string, target string, relation string, weight double").write.parquet(f"{tmp_path}/graph_edges.parquet")
    got = {r.id: r.component for r in relations.QUERIES["g7_components"](spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys(("a.md", "b.md", "c.md"), "a.md"), **dict.fromkeys(("d.md", "e.md", "f.md"), "d.md"), **dict.fromkeys(("g.md", "h.md"), "g.md")}


def test_paths(spark):
    got = {r.id: (r.hops, r.path) for r in G.shortest_paths(edges(spark, RING), 0, most=5).collect()}
    assert got == {0: (0, [0]), 1: (1, [0, 1]), 3: (1, [0, 3]), 2: (2, [0, 1, 2]), 4: (2, [0, 3, 4])}


def test_chains_end_only_where_links_do(spark):
    links = edges(spark, [(i, i + 1) for i in range(105)] + [(200, 201), (201, 200)])
    got = {(r.id, r.step, r.node) for r in G.chain(links).collect()}
    assert got == {(i, s, i + s) for i in range(105) for s in range(106 - i)} | {(200, 0, 200), (200, 1, 201), (201, 0, 201), (201, 1, 200)}


def test_version_chain_has_no_cap(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(relations.S, "fact_links", lambda *a: None)
    monkeypatch.setattr(relations.G, "chain", lambda links, **how: calls.append(how.get("most")))
    relations.j26_version_chain(spark, "")
    assert calls == [None]


def test_text_and_pooling_queries_cover_all_rows(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "好，", "zh"), (2, "good！", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in relations.QUERIES["x_fold_punctuation"](spark, str(tmp_path)).collect()} == {(1, "好,"), (2, "good!")}
    chunks = [(1, "ab", [3.0, 4.0], 2, "x"), (1, "cd", [0.0, 2.0, 0.0], 3, "y"), (2, "ef", [1.0, 0.0], 2, "x")]
    monkeypatch.setattr(relations.S, "chunks", lambda *a: spark.createDataFrame(chunks, "node_id long, chunk_text string, vector array<float>, dim int, model string"))
    assert {tuple(r) for r in relations.QUERIES["x_pooled_vectors"](spark, "").collect()} == {(1, "x", 2, 0.6, 0.8), (1, "y", 3, 0.0, 0.0), (2, "x", 2, 1.0, 0.0)}
    monkeypatch.setattr(relations.S, "nodes", lambda *a: spark.createDataFrame([(1, "x" * 60 + ". " + "y" * 20 + " 3.5 " + "z" * 40), (2, "a 1.5 b")], "id long, content string"))
    assert {tuple(r) for r in relations.QUERIES["x_excerpt"](spark, "").collect()} == {(1, "x" * 60 + "."), (2, "a 1.5 b")}


def test_mentions_of_names_of_any_script(spark, monkeypatch):
    names = ["李明", "Zoë", "Al", "Mary Ann", "x"]
    texts = ["今天李明来了", "with ZOË", "halted", "mary ann, x", "y"]
    monkeypatch.setattr(relations.S, "nodes", lambda *a: spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, names))], "id long, content string, character_name string"))
    got = {tuple(r) for r in relations.QUERIES["j14_mentions"](spark, "").collect()}
    assert got == {(0, "李明"), (1, "zoë"), (2, "al"), (3, "mary ann")}


def test_walks_from_the_hub_reach_the_end(spark, tmp_path):
    chain = [f"p{i:02}.md" for i in range(12)]
    rows = [*zip(chain, chain[1:]), ("p00.md", "q.md"), ("p03.md", "index/home.md")]
    spark.createDataFrame([(a, b, "NEXT", 1.0) for a, b in rows], "source string, target string, relation string, weight double").write.parquet(f"{tmp_path}/graph_edges.parquet")
    got = {n: q(spark, str(tmp_path)).collect() for n, q in (("g10_hub_paths", relations.g10_shortest_paths), ("s5_hub_edges_out", scans.s5_edges_out), ("g15_hub_scores", more.g15_passed_scores))}
    assert {r.id: r.hops for r in got["g10_hub_paths"]} == {**{p: i for i, p in enumerate(chain)}, "q.md": 1, "index/home.md": 4}
    assert {r.dst for r in got["s5_hub_edges_out"]} == {"p01.md", "q.md"} and {r.id for r in got["g15_hub_scores"]} == {"p02.md"}


def test_places_over_many_partitions(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("x")).repartition(13)
    assert [(r.x, r.place) for r in global_place(df, "x").orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]
    assert [(r.x, r.next_x) for r in global_lead(df, ["x"], "x").orderBy("x").collect()] == [(i, i + 1 if i < 999 else None) for i in range(1000)]


def test_similarity_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "PIVOTS", 12)
    monkeypatch.setattr(V, "CELL_BLOCK", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6), (None, [1.0] * 6)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if u[i] @ u[j] >= 0.8}
    assert {(r.a, r.b) for r in V.similar_rows(df, least=0.8).collect()} == want and len(want) > 50
    assert V.similar_rows(df.limit(0), least=0.8).collect() == []


def test_matching_is_the_sequential_one(spark):
    rng = random.Random(4)
    pairs = [(a, b, rng.choice([0.5, 0.6, 0.7])) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.4]
    used, want = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in C.matching(spark.createDataFrame(pairs, "a long, b long, score double")).collect()} == want


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), float(s := rng.randrange(100)), None if rng.random() < 0.2 else float(s + rng.randrange(40))) for i in range(60)]
    far = float("inf")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < (b[3] or far if b[3] is None else b[3]) and b[2] < (far if a[3] is None else a[3]) and (a[3] is None or a[3] > a[2]) and (b[3] is None or b[3] > b[2])}
    got = C.overlaps(spark.createDataFrame(rows, "id long, g string, s double, e double"), ["g"], "s", "e", 10.0)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_auc_and_metrics(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.9, True), (None, True)]
    assert Q.auc(spark.createDataFrame(rows, "score double, label boolean")).first().auc == 0.875
    assert Q.auc(spark.createDataFrame([(0.1, True)], "score double, label boolean")).first().auc is None
    res = spark.createDataFrame([("a", 7, 0), ("a", 3, 1), ("b", 1, 0)], "qid string, id long, place int")
    gold = spark.createDataFrame([("a", 3, 1.0), ("a", 4, 0.5), ("c", 1, 1.0)], "qid string, id long, gain double")
    got = {r.qid: r for r in Q.per_query(res, gold, 5).collect()}
    assert set(got) == {"a", "c"} and got["a"].recall == 0.5 and got["a"].mrr == 0.5 and got["c"].hit == 0 and got["c"].ndcg == 0.0
    assert abs(got["a"].ndcg - (1 / np.log2(3)) / (1 + 0.5 / np.log2(3))) < 1e-5
    boot = Q.paired_bootstrap(spark.createDataFrame([(str(i), 0.1 + 0.01 * (i % 5)) for i in range(40)], "qid string, diff double"), n=200).first()
    assert boot.low <= boot.mean <= boot.high and boot.p < 0.01


NODES = [(i, "memory", f"d{i % 3}", i, ["a", "b"] if i % 2 else ["a"]) for i in range(6)]


@pytest.fixture
def store(spark):
    n = spark.createDataFrame(NODES, "id long, type string, domain string, num long, tags array<string>")
    e = spark.createDataFrame([(0, 1, "REL"), (1, 2, "REL"), (0, 3, "REL"), (4, 5, "REL"), (3, 4, "CAUSES"), (1, 4, "CAUSES")], "src long, dst long, label string").withColumn("weight", F.lit(1.0))
    return n, e


def test_query_language(store):
    n, e = store
    ask = lambda q, **g: [tuple(r) for r in tql.query(q, n, e, g).collect()]
    assert ask("FIND {type: 'memory'} RETURN COUNT(*) AS n, SUM(num) AS s, AVG(num) AS a, MIN(num) AS l, MAX(num) AS h") == [(6, 15, 2.5, 0, 5)]
    assert ask("FIND {} RETURN num ORDER BY num DESC LIMIT 3 OFFSET 1") == [(4,), (3,), (2,)]
    assert sorted(ask("FIND {$or: [{num: {$lte: 1}}, {num: 5}]} RETURN id")) == [(0,), (1,), (5,)]
    assert sorted(ask("FIND {tags: {$all: ['a', 'b']}} RETURN id")) == [(1,), (3,), (5,)]
    assert len(ask("MATCH (a)-[:REL]->(b) RETURN a.id, b.id")) == 4
    assert sorted(ask("MATCH (a)-[:REL]->(b) WHERE b.num > 2 RETURN b.num")) == [(3,), (5,)]
    assert sorted(ask("MATCH (a)-[:REL*1..2]->(b) WHERE a.id = 0 RETURN DISTINCT b.id")) == [(1,), (2,), (3,)]
    assert sorted(ask("FIND {num: $p} RETURN num + 1 AS s", p=3)) == [(4,)]
    assert "Filter" in tql.explain("FIND {num: 3} RETURN id", n)


@pytest.mark.parametrize("text", ["", "FIND", "FIND {num: } RETURN *", "FIND {num: 1 RETURN *", "FIND {nope: 1} RETURN nothing", "FIND {} RETURN nothing", "MATCH (a)-[:REL]->(a) RETURN a.id", "FIND {num: {$near: 1}} RETURN *", "FIND {} RETURN * LIMIT 1.5", "DROP", "FIND {num: $x} RETURN *", "FIND {} RETURN * extra", "FIND {} RETURN id; --"])
def test_bad_queries_raise(store, text):
    with pytest.raises(Exception) as e:
        tql.query(text, *store)
    assert isinstance(e.value, tql.QueryError) or "UNRESOLVED" in str(e.value)


@pytest.mark.parametrize("given", [{}, {"p": 1, "q": 2}, {"p": float("inf")}, {"p": [1]}, {"p": {}}])
def test_bad_parameters_raise(store, given):
    with pytest.raises(tql.QueryError):
        tql.query("FIND {num: $p} RETURN id", *store, given)
    with pytest.raises(ValueError):
        FI.bind({"num": "param:p"}, given)


def test_cutters_and_expressions(spark):
    df = spark.createDataFrame([("one\n\ntwo is longer\n \n\nx",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(K.paragraphs(F.col("t"))).collect()] == [["one", "two is longer", "x"], [], None]
    assert df.select(K.merged(K.paragraphs(F.col("t")), 10)).first()[0] == ["one\n\ntwo is longer\n\nx"]
    assert [r[0] for r in df.select(K.windows(F.lit("abcdefghij"), 4, 1)).limit(1).collect()] == [["abcd", "defg", "ghij"]]
    s = spark.range(1).select(E.excerpt(F.lit("A b c. D e f 3.5 g h i j"), 20).alias("x"), E.shorten(F.lit("abcdef"), 4).alias("y"), E.wiki_names(F.lit("see [[a b|c]] and [[d#e]]")).alias("z"), E.tagged_block(F.lit("x <t>a\nb</t>"), "t").alias("w"))
    assert tuple(s.first()) == ("A b c. D e f 3.5 g", "abc…", ["a b", "d"], "a\nb")


def test_files(spark, tmp_path):
    (tmp_path / "md/sub").mkdir(parents=True)
    (tmp_path / "md/a.md").write_text("---\nid: 1\n---\n# A\n")
    (tmp_path / "md/sub/b.md").write_text("B")
    (tmp_path / "md/c.txt").write_text("no")
    tree = files.markdown_tree(spark, str(tmp_path / "md"))
    assert sorted(r.content for r in tree.collect()) == ["# A\n", "B"]
    known = tree.where("path like '%a.md'").union(spark.createDataFrame([("gone", None, "")], tree.schema))
    assert sorted(r.change for r in files.tree_changes(tree, known).collect()) == ["gone", "new"]
    (tmp_path / "log").write_text("abc|2025-01-01|fix | bars\nbroken\ndef|2025-01-02|more\n")
    assert [r.subject for r in files.git_log(spark, str(tmp_path / "log"), spark.createDataFrame([("def",)], "commit string")).collect()] == ["fix | bars"]
    (tmp_path / "j").write_text('{"ts": 1.5, "n": 2}\n{broken\n{"n": 3}\n')
    assert [r.ts for r in files.json_lines(spark, str(tmp_path / "j"), "ts double, n int").collect()] == [1.5]
    (tmp_path / "p.json").write_text('{"format": "pack", "format_version": 1, "nodes": [{"node_id": 7, "payload": {"type": "memory", "content": "x"}}, {"node_id": 9, "payload": {}}], "edges": [{"source_id": 7, "target_id": 9, "label": "R"}, {"source_id": 7, "target_id": 1, "label": "R"}]}')
    (tmp_path / "q.json").write_text("nope")
    n, e = files.read_pack(spark, str(tmp_path / "p.json"))
    placed, moved = files.import_pack(n, e, 100)
    assert sorted((r.node_id, r.id) for r in placed.collect()) == [(7, 101), (9, 102)]
    assert [(r.src, r.dst) for r in moved.collect()] == [(101, 102)]
    assert files.pack_verdict(spark, str(tmp_path / "p.json"), "pack").first().code == "ok"
    assert files.pack_verdict(spark, str(tmp_path / "q.json"), "pack").first().code == "not_json"
