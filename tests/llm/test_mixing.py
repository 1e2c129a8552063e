from collections import Counter

import numpy as np
import pytest

from marlstone.llm import mixing as M

TOKENS, TARGETS = "doc_id long, source string, n_tokens long, mix_name string, block int, at int", "mix_name string, source string, target_share double, max_repeats int, quota string"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*r, "", 0, 0) for r in docs], TOKENS), spark.createDataFrame([(*r, "") for r in targets], TARGETS)


DOCS = [(i, "a", 50 + i % 17) for i in range(900)] + [(1000 + i, "b", 40 + i % 31) for i in range(300)] + [(2000 + i, "c", 100) for i in range(20)] + [(3000, "none", 10), (3001, None, 10), (3002, "a", 0), (None, "a", 10)]
GOAL = [("m", " A ", 0.6, 1), ("m", "B", 0.3, 2), ("m", "c", 0.05, 3), ("m", "absent", 0.05, 3), ("n", "b", 1.0, 2), (None, "a", 1.0, 1), ("z", "absent", 1.0, 1)]


def test_shares_repeats_and_disjoint_draws(spark):
    tokens, targets = frames(spark, DOCS, GOAL)
    rows = M.mix(tokens, targets, block_docs=16, shard_tokens=5_000).collect()
    size = Counter()
    for r in rows:
        size[r.mix_name, r.source] += r.n_tokens
    total = sum(v for (m, _), v in size.items() if m == "m")
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.05)):
        assert abs(size["m", s] / total - share / 0.95) < 0.005
    assert size["n", "b"] == 2 * sum(n for i, s, n in DOCS if s == "b")
    uses = Counter((r.mix_name, r.doc_id) for r in rows)
    most = {(m, s.strip().lower()): k for m, s, _, k in GOAL if m}
    assert all(uses[r.mix_name, r.doc_id] <= most[r.mix_name, r.source] for r in rows)
    assert len({(r.mix_name, r.doc_id, r.repeat) for r in rows}) == len(rows)
    assert len({(r.mix_name, r.shard, r.pos) for r in rows}) == len(rows)
    shards = Counter((r.mix_name, r.shard) for r in rows)
    assert len([s for s in shards if s[0] == "m"]) > 3


def test_report_has_every_target(spark):
    tokens, targets = frames(spark, DOCS, GOAL)
    report = {(r.mix_name, r.source): r for r in M.reached(M.mix(tokens, targets), tokens, targets).collect()}
    assert set(report) == {("m", "a"), ("m", "b"), ("m", "c"), ("m", "absent"), ("n", "b"), ("z", "absent")}
    assert report["m", "absent"].tokens == 0 and report["n", "b"].most_repeats == 2 and report["n", "b"].share_reached == 1.0


@pytest.mark.parametrize(("docs", "goal"), [([], GOAL), (DOCS, []), ([], []), ([(1, "a", 0)], GOAL)])
def test_empty(spark, docs, goal):
    tokens, targets = frames(spark, docs, goal)
    assert M.mix(tokens, targets).collect() == []


def test_tree_uses_every_block_once_and_evenly():
    colours = np.array([1000, 300, 0, 7])
    walks = [M.split_tree(colours, 13, s, 5) for s in range(13)]
    at = np.zeros(4, int)
    for first, n in walks:
        assert (first == at).all()
        at += n
    assert (at == colours).all()
    sizes = [n.sum() for _, n in walks]
    assert max(sizes) - min(sizes) <= 13
    assert max(abs(n[0] / n.sum() - 1000 / 1307) for _, n in walks) < 0.15


def test_counts_whole_texts(spark):
    df = spark.createDataFrame([(1, " KB ", "Hello world", 1), (2, None, None, 1), (3, "x", "", 1), (4, "x", "a b " * 50_000, 1)], "doc_id long, source string, text string, n_tokens int")
    got = {r.doc_id: (r.source, r.n_tokens) for r in M.token_counts(df).collect()}
    assert got[1] == ("kb", 2) and got[2] == (None, 0) and got[3] == ("x", 0) and got[4][1] > 90_000
