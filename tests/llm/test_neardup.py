import pytest
import random
import re

from marlstone.llm import neardup as N

SCHEMA = "id long, text string, rep long, seg string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "re", "su") for b in ("lan", "dor", "vik", "pem") for c in ("", "ish", "or", "al")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t):
    w = t.split(" ")
    for _ in range(max(1, len(w) // 25)):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    if rng.random() < 0.5:  # a moved part
        i = rng.randrange(len(w))
        w = w[i:] + w[:i]
    return " ".join(w)


def brute(rows, q=5, least=0.7, most=80):
    sets = {}
    for i, t in rows:
        s = re.sub(r"\s+", " ", (t or "").lower().strip())
        if i is not None and len(s) >= most:
            sets[i] = {s[j : j + q] for j in range(len(s) - q + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)


def test_edits_and_moved_parts(spark):
    rng = random.Random(4)
    base = [text(rng, rng.randrange(20, 300)) for _ in range(150)]
    rows = list(enumerate(base + [edited(rng, t) for t in base]))
    want = brute(rows)
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(frame(spark, rows)).collect()}
    assert len(want) > 100
    assert got <= want and len(got) >= 0.99 * len(want)


def test_nulls_short_copies_and_case(spark):
    t = text(random.Random(1), 30)
    rows = [(1, t), (2, t.upper()), (3, "  " + t.replace(" ", " \n\t")), (3, t), (4, None), (5, ""), (6, "short"), (None, t), (7, "x" * 79), (8, "y" * 200_000), (9, "y" * 200_001)]
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(frame(spark, rows)).collect()} == brute(rows) == {(1, 2), (1, 3), (2, 3), (8, 9)}


def test_a_third_are_copies(spark):
    rng = random.Random(2)
    same = text(rng, 40)
    rows = [(i, same) for i in range(40)] + [(100 + i, text(rng, 40)) for i in range(80)] + [(500, edited(rng, same))]
    got = N.groups(frame(spark, rows)).collect()
    assert len(got) == 121
    big = {r.id for r in got if r.group_id == 0}
    assert big == {*range(40), 500}
    assert {r.n_links for r in got if r.id < 40} == {1}


def test_empty(spark):
    assert N.similar_pairs(frame(spark, [])).collect() == []
    assert N.groups(frame(spark, [])).collect() == []


def test_long_texts_code_the_same_in_parts(monkeypatch):
    t = [text(random.Random(9), 3000), text(random.Random(8), 50)]
    whole = [x.tolist() for x in N.codes(t, 5)]
    monkeypatch.setattr(N, "_WINDOW", 1000)
    assert [x.tolist() for x in N.codes(t, 5)] == whole


def test_codes_differ_with_similarity():
    rng = random.Random(3)
    a = text(rng, 200)
    b, c = edited(rng, a), "".join(rng.choice("abcdefghijklmnop ") for _ in range(1200))
    code = N.codes([a, b, c], 5)[2]
    apart = lambda x, y: sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(x, y))
    assert apart(code[0], code[1]) < N.budget(0.7, N.K) < apart(code[0], code[2])


def test_hot_segments_lose_no_pair_of_near_copies(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    stock = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(60):  # all share half of their text; some pairs share nearly all
        own = " ".join(rng.choice(words) for _ in range(40))
        rows += [(2 * i, f"{stock} {own}"), (2 * i + 1, f"{stock} {own} {rng.choice(words)}")]
    texts = spark.createDataFrame(rows, "rep bigint, text string")
    got = {(r.rep_a, r.rep_b) for r in N.similar_classes(texts, least=0.7, hot=8).collect()}
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    sets = [grams(t) for _, t in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert {(2 * i, 2 * i + 1) for i in range(60)} <= want
    assert got <= want and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyzäöü 😀", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))])
def test_gram_numbers_are_exact(alphabet):
    rng = random.Random(2)
    x, y = ("".join(rng.choice(alphabet) for _ in range(700)) for _ in range(2))
    y = x[100:400] + y
    s, t = N._gram_numbers(x, y, 5)
    gs, gt = ({z[i : i + 5] for i in range(len(z) - 4)} for z in (x, y))
    assert (len(s), len(t), len(set(s.tolist()) & set(t.tolist()))) == (len(gs), len(gt), len(gs & gt))


def overlapping(rows, least=0.7):
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in rows]
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j])}


def test_pairs_that_agree_in_nothing_but_one_hot_segment(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    first = [[rng.choice(words) for _ in range(19)] for _ in range(12_000)]
    second = [[*t[:6], rng.choice(words), *t[7:13], rng.choice(words), *t[14:]] for t in first]
    x, y = ([" ".join(t) for t in side] for side in (first, second))
    once = ((N.codes(x, 5)[0] == N.codes(y, 5)[0]).sum(axis=1) == 1).nonzero()[0]
    rows = [(k, t) for k, t in enumerate(t for i in once for t in (x[i], y[i]))]
    want = overlapping(rows)
    assert len(want) >= 5
    got = {(r.rep_a, r.rep_b) for r in N.similar_classes(spark.createDataFrame(rows, "rep bigint, text string"), hot=1).collect()}
    assert got == want


@pytest.mark.parametrize("block", [16, 2_048])
def test_hot_segments_are_compared_in_full(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    stock = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 25, 300)]
    rows = [(i, f"{stock[i % 3]} {' '.join(rng.choice(words) for _ in range(rng.randrange(5, 60)))}") for i in range(300)]
    want = overlapping(rows)
    assert 1_000 < len(want) < 30_000
    got = [(r.rep_a, r.rep_b) for r in N.similar_classes(spark.createDataFrame(rows, "rep bigint, text string"), hot=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
