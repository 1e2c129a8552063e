import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import hierarchy as H


def brute(links):
    parents, nodes = {}, set()
    for c, p in links:
        parents.setdefault(c, set()).add(p)
        nodes |= {c, p}

    def reach(x):
        seen, todo = set(), list(parents.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents.get(y, ())
        return seen

    circle = {x for x in nodes if x in reach(x)}
    out = set()

    def up(start, x, depth):
        if x in circle:
            out.add((start, "", -1))
        elif x not in parents:
            out.add((start, x, depth))
        else:
            for p in parents[x]:
                up(start, p, depth + 1)

    for n in nodes:
        up(n, n, 0)
    return out


def run(spark, links):
    df = spark.createDataFrame(links, "child string, parent string").withColumn("node", F.lit(1)).withColumn("depth", F.lit("x"))
    return {tuple(r) for r in H.hierarchy(df).collect()}


def test_trees_dags_and_circles(spark):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("d", "a"), ("d", "x"), ("p", "q"), ("q", "p"), ("r", "q"), ("r", "a"), ("s", "s"), ("t", "s"), ("q", "a"), ("m", "t"), ("u", "v"), ("v", "u"), ("u", "m"), (None, "a"), ("z", None), ("b", "a")]
    assert run(spark, links) == brute([x for x in links if None not in x])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=14))
def test_any_graph(spark, pairs):
    links = [(str(a), str(b)) for a, b in pairs]
    assert run(spark, links) == brute(links)


def test_deep_chain_and_empty(spark):
    links = [(f"n{i + 1:03}", f"n{i:03}") for i in range(40)]
    random.Random(1).shuffle(links)
    assert run(spark, links) == {(f"n{i:03}", "n000", i) for i in range(41)}
    assert run(spark, []) == set()


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "a")], "child string, parent string")
    paths = {(r.node, r.depth): r.path for r in H.hierarchy(df, with_path=True).collect()}
    assert paths == {("a", 0): "a", ("b", 1): "a > b", ("c", 2): "a > b > c", ("d", 1): "a > d", ("d", 2): "a > b > d"}
    assert {tuple(r) for r in H.descendants(df).collect()} == {("a", "b", 1), ("b", "c", 1), ("b", "d", 1), ("a", "d", 1), ("a", "c", 2)}
    assert {tuple(r) for r in H.subtree_sizes(df).collect()} == {("a", 3), ("b", 2)}


def test_names(spark):
    df = spark.createDataFrame([(" .\\a\\b.md ", "a/c.md", " part_of ", 1.0), ("", "x", "PART_OF", 1.0), (None, "x", "PART_OF", 1.0), ("q", "w", "NEXT", 1.0), ("q", "w", None, 1.0)], "source string, target string, relation string, weight double")
    assert [tuple(r) for r in H.part_of_links(df).collect()] == [("a/b.md", "a/c.md")]


def below(links):
    kids = {}
    for c, p in links:
        kids.setdefault(p, set()).add(c)
    out = {}
    for x in kids:
        seen, todo = set(), list(kids[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += kids.get(y, ())
        out[x] = len(seen - {x})
    return {(k, v) for k, v in out.items() if v}


def test_chains_shared_pages_and_circles_together(spark):
    rng = random.Random(5)
    links = [(f"c{i + 1:02}", f"c{i:02}") for i in range(30)]  # a chain that peeling leaves to doubling
    links += [(f"d{i + 1:02}", f"d{i:02}") for i in range(9)] + [("d05", "c20"), ("d07", "c03"), ("d07", "c11")]
    links += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("t0", "r1"), ("t1", "t0"), ("t2", "t1"), ("t3", "t2")]  # a circle of single parents and its tail
    links += [("e0", "e1"), ("e1", "e2"), ("e2", "e0"), ("e0", "c05"), ("f0", "e1"), ("f1", "f0"), ("f1", "c09")]  # a circle below a tree
    links += [(f"x{i:02}", f"x{rng.randrange(i):02}") for i in range(1, 40)] + [(f"x{i:02}", f"x{rng.randrange(i):02}") for i in range(10, 40, 6)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "child string, parent string")
    want = brute(links)
    got = H.paths_and_sizes(df).collect()
    assert {(r.node, r.root, r.depth) for r in got} == want
    assert {(r.node, r.n_below) for r in got if r.n_below} == below(links)
    assert all((r.path is None) == (r.depth < 0) and (r.path is None or r.path.count(" > ") == r.depth and r.path.split(" > ")[0] == r.root and r.path.endswith(r.node)) for r in got)
    assert {r.node for r in H.on_circles(df).collect()} == {"r0", "r1", "r2", "e0", "e1", "e2"}
    assert {tuple(r) for r in H.subtree_sizes(df).collect()} == below(links)
