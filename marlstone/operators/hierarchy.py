"""Parent-child links to full hierarchies (problem 2).

Leaves are peeled round by round, and each sends the size of its subtree to
its parents. Peeling stops when a round takes off less than an eighth of what
is open: what is left are long chains, circles and the pages above them. Chains
of single parents are then followed by pointer doubling, so a chain of n pages
takes log n rounds and not n; the few pages with several parents, joined by
these chains, form a small graph of their own, whose strongly connected
components are the circles. Against the peel order, roots, depths and paths
are handed down again. A round touches only links that are still open; all
joins are shuffles on page names, nothing is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import cut, shuffled

#: Peeling goes on while a round takes off at least one open link in so many.
SLOW = 8


def clean_path(path: Column) -> Column:
    """A document path without outer blanks, with / for \\ and without a leading ./; null if blank."""
    # fixed by the data's description: outer white space of any kind, one leading ./
    p = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    p = F.regexp_replace(F.translate(p, "\\", "/"), r"^\./", "")
    return F.nullif(p, F.lit(""))


def part_of_links(edges: DataFrame) -> DataFrame:
    """Distinct (child, parent) of the PART_OF rows with both ends."""
    rel = F.upper(F.regexp_replace("relation", r"(?U)^\s+|\s+$", ""))
    return edges.where(rel == "PART_OF").select(clean_path(F.col("source")).alias("child"), clean_path(F.col("target")).alias("parent")).where("child is not null and parent is not null").distinct()


def _prepared(links: DataFrame) -> DataFrame:
    """Distinct links without nulls, and whether the child has several parents."""
    l = links.select("child", "parent").where("child is not null and parent is not null").distinct()
    n = l.groupBy("child").agg((F.count(F.lit(1)) > 1).alias("several"))
    return cut(l.join(shuffled(n), "child"))


def peel(links: DataFrame, *, sizes: bool = False, slow: int = SLOW) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """(rounds, open, sums): links in the rounds in which their child comes off as a leaf, those that stay open, and sums for pages that stay.

    With `sizes` each round's links carry `below`, the pages under the child
    counted along every chain, and `mixed`, whether a page with several parents
    is among them; sums has both for the pages that got messages and never sent
    any.
    """
    open_, rounds = links, []
    pending = None
    if sizes:
        pending = links.select(F.col("child").alias("node"), F.lit(0).cast("bigint").alias("below"), F.lit(False).alias("mixed")).limit(0)
    n = open_.count()
    while n:
        inner = open_.select(F.col("parent").alias("_end")).distinct()
        state = open_.join(shuffled(inner), F.col("child") == F.col("_end"), "left").withColumn("leaf", F.col("_end").isNull()).drop("_end")
        if sizes:
            state = state.join(shuffled(pending.withColumnsRenamed({"node": "_n", "below": "_below", "mixed": "_mixed"})), F.col("child") == F.col("_n"), "left")
            state = state.withColumns({"below": F.coalesce("_below", F.lit(0)), "mixed": F.coalesce("_mixed", F.lit(False))}).drop("_n", "_below", "_mixed")
        state = cut(state)
        off = state.where("leaf").drop("leaf")
        m = state.where("not leaf").count()
        if m < n:
            rounds.append(off)
        if sizes and m < n:
            gone = off.select(F.col("child").alias("node")).distinct()
            sent = off.select(F.col("parent").alias("node"), (F.col("below") + 1).alias("below"), (F.col("mixed") | F.col("several")).alias("mixed"))
            pending = cut(pending.join(shuffled(gone), "node", "left_anti").union(sent).groupBy("node").agg(F.sum("below").alias("below"), F.max("mixed").alias("mixed")))
        open_ = state.where("not leaf").select(*links.columns)
        done = (n - m) * slow < n
        n = m
        if done:
            break
    return rounds, open_, pending


def _core(links: DataFrame) -> DataFrame:
    """Links that lie on circles or between them: what is left when leaves and roots are taken off until nothing moves."""
    for near, far in (("child", "parent"), ("parent", "child")):
        links, n = cut(links), None
        while (m := links.count()) != n and m:
            n = m
            for _ in range(3):
                links = links.join(shuffled(links.select(F.col(far).alias("_end"))), F.col(near) == F.col("_end"), "left_semi")
            links = cut(links)
    return links


def _components(links: DataFrame) -> DataFrame:
    """(node, colour) for the nodes of links (child, parent) on circles: strongly connected components, a link to itself included.

    In the peeled core, the largest name that reaches a node becomes its
    colour; the nodes that reach their colour's own node inside that colour are
    one component. Components are taken out and the rest is peeled again until
    none is left.
    """
    found = links.where("child = parent").select(F.col("child").alias("node"), F.col("child").alias("colour")).distinct()
    core = _core(links.where("child <> parent").select("child", "parent"))
    while not core.isEmpty():
        colour, total = cut(core.select(F.col("child").alias("node")).union(core.select("parent")).distinct().withColumn("colour", F.col("node"))), None
        while True:
            down = core.join(shuffled(colour), F.col("parent") == F.col("node")).select(F.col("child").alias("node"), "colour")
            colour = cut(colour.union(down).groupBy("node").agg(F.max("colour").alias("colour")))
            now = colour.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
            if now == total:
                break
            total = now
        a, b = (colour.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}")) for c in ("child", "parent"))
        same = cut(core.join(shuffled(a), "child").join(shuffled(b), "parent").where("_child = _parent").select("child", "parent"))
        members, n = cut(colour.where("node = colour")), 0
        while (m := members.count()) != n:
            n = m
            up = same.join(shuffled(members), F.col("child") == F.col("node")).select(F.col("parent").alias("node"), "colour")
            members = cut(members.union(up).distinct())
        sized = members.join(shuffled(members.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))), "colour")
        found = found.join(shuffled(sized.where("n > 1").select("node")), "node", "left_anti").union(sized.where("n > 1").select("node", "colour"))
        out = members.select("node")
        core = _core(core.join(shuffled(out), F.col("child") == F.col("node"), "left_anti").join(shuffled(out), F.col("parent") == F.col("node"), "left_anti"))
    return cut(found)


class _Rest:
    """What peeling leaves: chains of single parents by pointer doubling, and the graph of the pages with several parents.

    jumps (node, to, steps, chain): from each page with one parent whose chain
    ends, to the first page above that has several parents or none. steps[k]
    (node, to): 2^k steps up along single parents. lost (node): pages whose
    chain of single parents ends in a circle of them. forks (node, by, to,
    steps, lost, chain, on): for each parent `by` of a page with several, the
    end of that chain; `on` if that is such a page too. circle (node): pages on
    circles.
    """

    def __init__(self, links: DataFrame, separator: str):
        loops = links.where("child = parent").select(F.col("child").alias("node"))
        single = links.where("not several").select(F.col("child").alias("node"), F.col("parent").alias("to"))
        ends = cut(single.join(shuffled(single.select(F.col("node").alias("_n"))), F.col("to") == F.col("_n"), "left").select("node", "to", F.lit(1).cast("bigint").alias("steps"), F.col("_n").isNull().alias("done"), F.col("node").alias("chain")))
        self.steps, done, live = [], ends.where("done"), ends.where("not done")
        n, m = None, live.count()
        while m and m != n:
            self.steps.append(live.select("node", "to"))
            far = done.unionByName(live).select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("steps").alias("_s"), F.col("done").alias("_d"), F.col("chain").alias("_c"))
            nxt = cut(live.join(shuffled(far), F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("done"), F.concat("_c", F.lit(separator), "chain").alias("chain")))
            done, live = done.unionByName(nxt.where("done")), nxt.where("not done")
            n, m = m, live.count()
        self.jumps = cut(done.drop("done"))
        live = live.select("node", "to")
        self.lost, ring = cut(live.select("node")), loops
        if m:  # only circles of single parents and what hangs below them never end: the circles are where all of it gets to
            n = None
            while (k := live.select("to").distinct().count()) != n:
                n = k
                live = cut(live.join(shuffled(live.select(F.col("node").alias("_n"), F.col("to").alias("_to"))), F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to")))
            ring = ring.union(live.select(F.col("to").alias("node")))
        forks = links.where("several").select(F.col("child").alias("node"), F.col("parent").alias("by"))
        heads = forks.select(F.col("node").alias("_head")).distinct()
        j = self.jumps.withColumnsRenamed({"node": "_n", "to": "_to", "steps": "_s"})
        forks = forks.join(shuffled(j), F.col("by") == F.col("_n"), "left").join(shuffled(self.lost.withColumnRenamed("node", "_lost")), F.col("by") == F.col("_lost"), "left")
        forks = forks.select("node", "by", F.coalesce("_to", "by").alias("to"), (F.coalesce("_s", F.lit(0)) + 1).alias("steps"), F.col("_lost").isNotNull().alias("lost"), F.when(F.col("chain").isNull(), F.col("node")).otherwise(F.concat("chain", F.lit(separator), "node")).alias("chain"))
        self.forks = cut(forks.join(shuffled(heads), F.col("to") == F.col("_head"), "left").withColumn("on", F.col("_head").isNotNull() & ~F.col("lost")).drop("_head"))
        self.circle = ring.distinct()
        between = self.forks.where("on").select(F.col("node").alias("child"), F.col("to").alias("parent"))
        if not between.isEmpty():
            groups = _components(between.distinct())
            g1, g2 = groups.withColumnsRenamed({"colour": "_g1"}), groups.withColumnsRenamed({"node": "_n2", "colour": "_g2"})
            inside = self.forks.where("on").join(shuffled(g1), "node").join(shuffled(g2), F.col("to") == F.col("_n2")).where("_g1 = _g2 and by <> to").select(F.col("by").alias("node"))
            marked = inside.distinct()
            for up in self.steps:  # all pages with one parent on the chain from there
                marked = cut(marked.union(up.join(shuffled(marked), "node").select(F.col("to").alias("node"))).distinct())
            self.circle = self.circle.union(groups.select("node")).union(marked).distinct()
        self.circle = cut(self.circle)


def on_circles(links: DataFrame) -> DataFrame:
    """Nodes (node) that lie on a circle, a link to itself included."""
    links = _prepared(links)
    loops = links.where("child = parent").select(F.col("child").alias("node"))
    return _Rest(peel(links)[1], " ").circle.union(loops).distinct()


def hierarchy(links: DataFrame, *, with_path: bool = False, separator: str = " > ") -> DataFrame:
    """Every node with root and depth over all its chains of parents.

    links: child, parent (strings; other columns are ignored). Nulls are left
    out, repeated links count once. Result: node, root, depth (and path: the
    chain from the root, the smallest in order where several have the same
    root and depth). A node without parent has itself as root and depth 0. A
    chain that comes to a circle gives root '' and depth -1 (path null). A
    node that is its own parent is a circle. No links give no rows.
    """
    links = _prepared(links)
    rounds, open_, _ = peel(links)
    return _handed_down(links, rounds, _Rest(open_, separator), with_path, separator)


def _handed_down(links: DataFrame, rounds: list[DataFrame], rest: _Rest, with_path: bool, separator: str) -> DataFrame:
    keys = ["node", "root", "depth"]

    def rows(df: DataFrame, root, depth, path) -> DataFrame:
        return df.select("node", root.alias("root"), depth.cast("bigint").alias("depth"), *([path.alias("path")] if with_path else []))

    def once(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("path").alias("path")) if with_path else df.distinct()

    def further(df: DataFrame, steps: Column, chain: Column) -> DataFrame:
        """The rows of the page above (_root, _depth, _path), carried on to node."""
        return rows(df, F.col("_root"), F.when(F.col("_depth") < 0, -1).otherwise(F.col("_depth") + steps), F.when(F.col("_depth") < 0, None).otherwise(F.concat("_path", F.lit(separator), chain)) if with_path else F.lit(None))

    def above(df: DataFrame) -> DataFrame:
        return shuffled(df.withColumnsRenamed({c: f"_{c}" for c in df.columns}))

    none, text = F.lit(""), F.lit(None).cast("string")
    roots = links.select(F.col("parent").alias("node")).distinct().join(shuffled(links.select(F.col("child").alias("node"))), "node", "left_anti")
    roots = cut(rows(roots, F.col("node"), F.lit(0), F.col("node")))
    lost = rows(rest.circle.union(rest.lost).distinct(), none, F.lit(-1), text)
    # pages with several parents, by the chains between them
    free = rest.forks.join(shuffled(rest.circle), "node", "left_anti")
    first = rows(free.where("lost"), none, F.lit(-1), text).unionByName(further(free.where("not lost and not on").join(above(roots), F.col("to") == F.col("_node")), F.col("steps"), F.col("chain")))
    heads = rest.forks.select("node").distinct()
    front = cut(once(first.unionByName(lost.join(shuffled(heads), "node", "left_semi"))))
    mid, hops = front, free.where("on")
    while not front.isEmpty():
        front = cut(once(further(hops.join(above(front), F.col("to") == F.col("_node")), F.col("steps"), F.col("chain"))))
        mid = mid.unionByName(front)
    known = cut(once(roots.unionByName(mid)))
    chains = rest.jumps.join(shuffled(rest.circle), "node", "left_anti")
    known = known.unionByName(further(chains.join(above(known), F.col("to") == F.col("_node")), F.col("steps"), F.col("chain"))).unionByName(lost)
    parts = [cut(once(known))]
    for off in reversed(rounds):
        down = off.withColumnRenamed("child", "node").join(above(reduce(DataFrame.unionByName, parts)), F.col("parent") == F.col("_node"))
        parts.append(cut(once(further(down, F.lit(1), F.col("node")))))
    return reduce(DataFrame.unionByName, parts)


def descendants(links: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every page below each page, at its least distance.

    As rows, never as one array, so a root above a third of all pages is no row
    of that length. Pairs up to a distance of 2^k are joined with those of
    exactly 2^k, so their number of rounds is the logarithm of the depth and a
    pair of a tree is made once. Inside circles a page lies below itself once.
    """
    l = links.select("child", "parent").where("child is not null and parent is not null").distinct()
    pairs = cut(l.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).cast("bigint").alias("distance")))
    step = 1
    while True:
        far = pairs.where(F.col("distance") == step).select(F.col("ancestor").alias("_mid"), F.col("node").alias("_low"))
        if far.isEmpty():
            return pairs
        longer = pairs.join(shuffled(far), F.col("node") == F.col("_mid")).select("ancestor", F.col("_low").alias("node"), (F.col("distance") + step).alias("distance"))
        pairs = cut(pairs.union(longer).groupBy("ancestor", "node").agg(F.min("distance").alias("distance")))
        step *= 2


def subtree_sizes(links: DataFrame) -> DataFrame:
    """(node, n_below): how many different pages lie below each page that has any.

    Where no page below has several parents, the sizes that leaves send up are
    the answer; along the chains that peeling leaves they are summed by
    doubling. Above pages with several parents, and where there are circles,
    chains would count pages twice: there the pairs of such pages are counted,
    each with what hangs below it alone.
    """
    links = _prepared(links)
    peeled = peel(links, sizes=True)
    return _sizes(links, peeled, _Rest(peeled[1], " "))


def _sizes(links: DataFrame, peeled: tuple, rest: _Rest) -> DataFrame:
    rounds, open_, pending = peeled
    # pages that peeling left, each with what it was sent; `mixed` also for circles and for parents of pages with several
    left = open_.select(F.col("child").alias("node")).union(open_.select("parent")).distinct()
    ringed = rest.circle.union(rest.lost).union(rest.forks.select("by")).distinct()
    own = left.join(shuffled(pending), "node", "left").join(shuffled(ringed.select(F.col("node").alias("_r"))), F.col("node") == F.col("_r"), "left")
    total = cut(own.select("node", (F.coalesce("below", F.lit(0)) + 1).alias("w"), (F.coalesce("mixed", F.lit(False)) | F.col("_r").isNotNull()).alias("mixed")))
    for k in range(len(rest.steps) + 1):
        up = rest.jumps.where(F.col("steps") == 1 << k).select("node", "to")
        up = up.union(rest.steps[k]) if k < len(rest.steps) else up
        sent = total.join(shuffled(up), "node").select(F.col("to").alias("node"), "w", "mixed")
        total = cut(total.union(sent).groupBy("node").agg(F.sum("w").alias("w"), F.max("mixed").alias("mixed")))
    sums = total.select("node", (F.col("w") - 1).alias("below"), "mixed").union(pending.join(shuffled(left), "node", "left_anti"))
    for off in rounds:
        sums = sums.union(off.where("below > 0").select(F.col("child").alias("node"), "below", "mixed").distinct())
    sums = cut(sums.where("below > 0 or mixed"))
    plain = sums.where("not mixed").select("node", F.col("below").alias("n_below"))
    mixed = sums.where("mixed").select("node")
    # pages that are counted one by one: mixed ones and those with several parents
    named = cut(mixed.union(links.where("several").select("child")).distinct())
    inner = links.where("child <> parent").join(shuffled(mixed.withColumnRenamed("node", "parent")), "parent", "left_semi")
    inner = inner.join(shuffled(named.select(F.col("node").alias("_n"))), F.col("child") == F.col("_n"), "left").join(shuffled(plain.select(F.col("node").alias("_p"), "n_below")), F.col("child") == F.col("_p"), "left")
    inner = cut(inner.select("child", "parent", F.col("_n").isNotNull().alias("named"), F.coalesce("n_below", F.lit(0)).alias("n_below")))
    alone = inner.where("not named").groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("n_below") + 1).alias("own"))
    weight = cut(named.join(shuffled(alone), "node", "left").join(shuffled(plain), "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"), (F.coalesce("own", "n_below", F.lit(0)) + 1).alias("weight")))
    pairs = descendants(inner.where("named")).where("ancestor <> node")
    below = pairs.join(shuffled(weight.select("node", "weight")), "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("weight").alias("far"))
    exact = mixed.join(shuffled(weight.select("node", "own")), "node").join(shuffled(below), "node", "left").select("node", (F.col("own") + F.coalesce("far", F.lit(0))).alias("n_below"))
    return plain.union(exact.where("n_below > 0"))


def paths_and_sizes(links: DataFrame, *, separator: str = " > ") -> DataFrame:
    """(node, root, depth, path, n_below): `hierarchy` with paths and `subtree_sizes` from one peeling; a page with nothing below has 0."""
    links = _prepared(links)
    peeled = peel(links, sizes=True)
    rest = _Rest(peeled[1], separator)
    tree, sizes = _handed_down(links, peeled[0], rest, True, separator), _sizes(links, peeled, rest)
    return tree.join(shuffled(sizes), "node", "left").select("node", "root", "depth", "path", F.coalesce("n_below", F.lit(0)).cast("bigint").alias("n_below"))
