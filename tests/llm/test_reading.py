import numpy as np
import pytest

from marlstone.llm import reading as R

EASY = "The cat sat on the mat. The dog ran to me. We had a cup of tea. " * 8
MIDDLE = "The weekly report fixed the fresh import before the lock was free, and the team agreed that the page should stay open. " * 8
HARD = "Notwithstanding the methodological reservations articulated previously, an internally consistent formalisation of hierarchical consolidation necessarily presupposes the interpretative flexibility indispensable for collaborative investigation, provided that institutional accountability mechanisms accommodate representational commensurability. " * 6
SCHEMA = "doc_id long, text string, lang string, grade string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "", "") for i, (t, lang) in enumerate(rows)], SCHEMA)


def grades(spark, texts):
    rows = [(t, "en") if not isinstance(t, tuple) else t for t in texts]
    base = [(EASY, "en"), (MIDDLE, "en"), (HARD, "en")] * 10
    ranker = R.fit_on(frame(spark, base))
    return {r.doc_id: r.grade for r in R.reading_levels(frame(spark, rows), ranker=ranker).collect()}


def test_levels_and_what_is_no_prose(spark):
    words = "institutional accountability mechanisms, representational commensurability and methodological reservations"
    noise = [f"# {words}", f"- {words}", f"1. {words}", f"2026-01-06 05:13 WARN {words}", f"```\n{words} {words}\n```", f"call `{words.replace(' ', '_')}(5398d3)` first."]
    g = grades(spark, [EASY, MIDDLE, HARD, *[EASY + "\n\n" + (n + "\n") * 40 for n in noise], HARD.replace(". ", ".\r\n\r\n- so\r\n- it is\r\n\r\n"), "> " + HARD.replace(". ", ".\n> ")])
    assert g[0] < 5 < g[1] < 13 < g[2]
    for i in range(3, 3 + len(noise)):
        assert abs(g[i] - g[0]) < 1, noise[i - 3]
    assert g[9] > 13 and g[10] > 13


def test_nulls_other_languages_and_odd_texts(spark):
    g = grades(spark, [None, "", "   \n", (HARD, "de"), (HARD, None), "# only a heading", "汉字" * 50, "word", "x" * 300_000, "> " * 50_000, "a:b " * 50_000, "```\nnever closed " + HARD, "." * 10_000])
    assert all(g[i] is None for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 11, 12))
    assert g[7] is not None


def test_empty_table_has_a_scale(spark):
    ranker = R.fit_on(frame(spark, []))
    assert R.reading_levels(frame(spark, []), ranker=ranker).collect() == []
    assert [k[1] for k in ranker.knots] == sorted(k[1] for k in ranker.knots)


def test_repeated_rows_stay(spark):
    ranker = R.fit_on(frame(spark, []))
    df = frame(spark, [(EASY, "en")])
    assert R.reading_levels(df.union(df), ranker=ranker).count() == 2


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    x, y = rng.permutation(40).astype(float), rng.normal(size=40).cumsum()
    knots = R.isotonic(x, y)
    assert [k[0] for k in knots] == sorted(k[0] for k in knots) and [k[1] for k in knots] == sorted(k[1] for k in knots)
    o = np.argsort(x)
    best = [max(min(y[o][i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]  # the max-min form of the fit
    assert {round(k[1], 9) for k in knots} == {round(b, 9) for b in best}


def test_counts_by_hand():
    got = R.counts(["He came, although it rained! Was it due to organisation? The table fell.", None, "", "no mark"])
    assert got["n_words"].tolist() == [13, 0, 0, 2] and got["n_sentences"].tolist() == [3, 0, 0, 1]
    assert (got["n_links"][0], got["n_commas"][0], got["n_nouns"][0], got["n_long"][0], got["n_six"][0]) == (1, 1, 1, 1, 2)
    assert R._word("came")[1] == 1 and R._word("table")[1] == 2 and R._word("the")[1] == 1 and R._word("organisation")[1] == 5


def test_held_out_order():
    rng = np.random.default_rng(1)
    s = rng.uniform(5, 35, 400)
    w = np.full(400, 300.0)
    c = {"n_words": w, "n_sentences": w / s, "n_letters": w * (3.5 + s / 20), "n_syllables": w * (1.1 + s / 40), "n_long": w * s / 150, "n_six": w * s / 80, "n_links": w / s, "n_nouns": w * s / 400, "n_commas": w / 15}
    r = R.fit(c)
    assert r.held_out > 0.95


@pytest.mark.parametrize("n", [1, 200])
def test_knots_are_few(n):
    assert len(R.isotonic(np.arange(n, dtype=float), np.arange(n, dtype=float))) <= 64
