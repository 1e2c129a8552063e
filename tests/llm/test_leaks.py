import random

import numpy as np

from marlstone.llm import leaks as L

DOC, ITEM = "doc_id long, text string, item_id string, grams string", "item_id long, passage string, text string"
VOCABULARY = [f"{a}{b}" for a in "bcdfgklmn" for b in ("aro", "imu", "ose", "uti", "ela", "ant", "ick")]


def brute_run(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=0)


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (L.MATCH if a[i] == b[j] else L.MISMATCH), h[i, j + 1] + L.GAP, h[i + 1, j] + L.GAP)
    return int(h.max())


def test_alignment_and_run_against_plain_forms():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(1, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))) for _ in range(60)]
    score, longest = L.aligned(pairs)
    assert score.tolist() == [brute_align(a, b) for a, b in pairs]
    assert longest.tolist() == [brute_run(list(a), list(b)) for a, b in pairs]


def test_windows_hold_every_passage_and_its_surroundings():
    rng = np.random.default_rng(2)
    p = np.arange(1, 31)
    t = np.concatenate([np.zeros(200, int), p, np.zeros(100, int), p[5:25], np.zeros(400, int), rng.permutation(p)])
    got = L.windows(p, t, 5)
    assert len(got) == 2 and got[0][0] <= 200 and got[0][1] >= 230 and got[1][0] <= 330 and got[1][1] >= 350 and got[1][1] < 450
    assert L.windows(p, np.zeros(50, int), 5) == []


def test_words():
    assert L.words("Ab-c3, Straße_汉字x ÉÉ") == ["ab", "c3", "strasse", "汉", "字", "x", "éé"]
    assert L.words(None) == L.words("") == []


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "", "") for i, t in docs], DOC)
    q = spark.createDataFrame([(i, p, "") for i, p in items], ITEM)
    return {(r.doc_id, r.item_id): r for r in L.leaks(d, q).collect()}


def test_copies_parts_and_edits(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    p, q = words(60), words(45)
    noise = lambda: " ".join(words(80))
    edited = [w if i % 12 else "zzz" for i, w in enumerate(p)]
    docs = [
        (1, noise() + " " + " ".join(p).upper() + " " + noise()), (2, noise() + "\n> ".join(p[10:30]) + ". " + noise()), (3, noise() + " " + " ".join(p[10:29]) + " qqq " + noise()),
        (4, noise() + " " + " ".join(edited)), (5, noise()), (6, None), (7, ""), (8, " ".join(q)), (8, " ".join(q)), (None, " ".join(q)),
    ]
    docs[1] = (2, noise() + " . " + "\n> ".join(p[10:30]) + ". " + noise())
    got = run(spark, docs, [(11, " ".join(p)), (12, " ".join(q)), (13, None), (14, "too short"), (11, " ".join(p))])
    assert {k for k, r in got.items() if r.longest_run >= 20} == {(1, 11), (2, 11), (8, 12)}
    assert got[1, 11].score == 1.0 and got[2, 11].longest_run == 20
    assert got[4, 11].longest_run < 20 and got[4, 11].score > 0.7
    assert (5, 11) not in got


def test_phrases_of_half_the_corpus_do_not_hide_a_leak(spark):
    rng = random.Random(6)
    common = " ".join(rng.choice(VOCABULARY) for _ in range(15))
    own = " ".join(rng.choice(VOCABULARY) for _ in range(10))
    docs = [(i, common + " " + " ".join(rng.choice(VOCABULARY) for _ in range(30))) for i in range(60)] + [(99, "x " + common + " " + own)]
    got = run(spark, docs, [(1, common + " " + own)])
    assert {k for k, r in got.items() if r.longest_run >= 20} == {(99, 1)}
    assert len(got) < 30


def test_empty_tables_and_blocks_of_items(spark):
    assert run(spark, [], [(1, "a b c d e f g h i j")]) == {}
    assert run(spark, [(1, "x")], []) == {}
    rng = random.Random(7)
    passages = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(30))) for i in range(6)]
    d = spark.createDataFrame([(i, p, "", "") for i, p in passages], DOC)
    q = spark.createDataFrame([(i, p, "") for i, p in passages], ITEM)
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, q, item_chars=300).collect() if r.longest_run >= 20}
    assert got == {(i, i) for i in range(6)}


def test_edited_copies_without_a_verbatim_one(spark):
    rng = random.Random(8)
    passages = {i: [rng.choice(VOCABULARY) for _ in range(60)] for i in (12, 15, 20)}
    docs = [(i, " ".join(w if j % i else "zzz" for j, w in enumerate(p))) for i, p in passages.items()]
    got = run(spark, docs, [(i, " ".join(p)) for i, p in passages.items()])
    assert set(got) == {(12, 12), (15, 15), (20, 20)}
    assert all(r.longest_run < 20 and r.score > 0.7 for r in got.values())


def test_an_edited_copy_beside_rarer_ngrams(spark):
    rng = random.Random(9)
    p = [rng.choice(VOCABULARY) for _ in range(28)]
    head, tail = " ".join(p[:12]) + " qqq", "zzz " + " ".join(p[12:])
    docs = [(i, head) for i in range(5)] + [(9, tail)]  # each n-gram of the head is in five documents, of the tail in one
    assert {d for d, _ in run(spark, docs, [(1, " ".join(p))])} == {0, 1, 2, 3, 4, 9}


def test_recall_of_edited_and_reordered_copies(spark):
    """Words replaced, left out and put in, and sentences moved: at least 0.9 of the copies come out with half the passage's score."""
    rng = random.Random(10)
    items, docs = [], []
    for i in range(40):
        p = [rng.choice(VOCABULARY) for _ in range(60)]
        items.append((i, " ".join(p)))
        c = [w for w in p if rng.random() > 0.03]
        c = [rng.choice(VOCABULARY) if rng.random() < 0.1 else w for w in c]
        for _ in range(2):
            c.insert(rng.randrange(len(c)), rng.choice(VOCABULARY))
        if i % 4 == 0:
            c = c[40:] + c[:40]
        docs.append((i, " ".join(rng.choice(VOCABULARY) for _ in range(100)) + " " + " ".join(c)))
    got = run(spark, docs, items)
    found = {k for k, r in got.items() if r.score >= 0.5}
    assert len([k for k in found if k[0] == k[1]]) >= 36
    assert all(a == b for a, b in found)
