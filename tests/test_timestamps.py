import random
import itertools
from datetime import UTC, datetime

import pytest

from marlstone.operators import timestamps as T


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "tz", "want"),
    [
        ("2025-01-03T16:08:46+0000", None, us(2025, 1, 3, 16, 8, 46)),
        ("20250103T170357Z", "America/New_York", us(2025, 1, 3, 17, 3, 57)),
        ("2025-01-02 19:51:22.126830", "America/New_York", us(2025, 1, 3, 0, 51, 22) + 126830),
        ("1735982644601940", "Asia/Shanghai", 1735982644601940),
        ("1735875747.3836539", None, 1735875747383653),
        ("1735992382136", None, 1735992382136000),
        ("1736375753", "UTC", 1736375753000000),
        ("02.01.2025 14:40:41", "UTC", us(2025, 1, 2, 14, 40, 41)),
        ("01/02/2025 9:51 AM", "UTC", us(2025, 1, 2, 9, 51)),
        ("01/06/2025 12:05 AM", "UTC", us(2025, 1, 6, 0, 5)),
        ("2025/1/10 03:48", "UTC", us(2025, 1, 10, 3, 48)),
        ("２０２５－０１－０３ ０９：４１", "UTC", us(2025, 1, 3, 9, 41)),
        ("  2025-01-11 15:01 ", None, us(2025, 1, 11, 15, 1)),
        ("2025年1月20日 上午1:47", "Asia/Shanghai", us(2025, 1, 19, 17, 47)),
        ("2025年1月11日 下午12:06", "UTC", us(2025, 1, 11, 12, 6)),
        ("2026年9月16日 上午12:15", "UTC", us(2026, 9, 16, 0, 15)),
        ("2025年1月10日6时40分56秒", "UTC", us(2025, 1, 10, 6, 40, 56)),
        ("2025-01-09 23:41:22 UTC+1", "Asia/Shanghai", us(2025, 1, 9, 22, 41, 22)),
        ("2025-04-08 20:28:31 GMT+05:30", None, us(2025, 4, 8, 14, 58, 31)),
        ("2025-04-05 19:04:26 CEST", None, us(2025, 4, 5, 17, 4, 26)),
        ("2025-01-31T18:22:04+08:00[Asia/Shanghai]", None, us(2025, 1, 31, 10, 22, 4)),
        ("2025-01-16T09:33:02Z[UTC]", None, us(2025, 1, 16, 9, 33, 2)),
        ("29. März 2026, 02:21 Uhr", "Europe/Berlin", us(2026, 3, 29, 1, 21)),
        ("Sun, 06 Apr 2025 10:30:35 +0800", None, us(2025, 4, 6, 2, 30, 35)),
        ("Mar 9, 2025 2:14 AM", "America/New_York", us(2025, 3, 9, 7, 14)),
        ("2025-11-02 01:24:00", "America/New_York", us(2025, 11, 2, 5, 24)),
        ("2025-01-06", "Asia/Kolkata", us(2025, 1, 5, 18, 30)),
        ("2025-01-05T15:58:08.020928999+00:00", None, us(2025, 1, 5, 15, 58, 8) + 20928),
        ("2025-01-06 10:00:00", "No/Where", us(2025, 1, 6, 10)),
    ],
)
def test_layouts(text, tz, want):
    got = [u for name, u in T.interpretations(text, tz) if name in T.DECLARED]
    assert got == [want]


@pytest.mark.parametrize("text", [None, "", "   ", "昨天", "yesterday", "null", "N/A", "—", "0000-00-00 00:00:00", "32.01.2026", "2025-02-30", "2025-13-01 10:00", "2025-01-01 25:00", "13:00", "9" * 30, "x" * 10_000])
def test_unreadable(text):
    assert T.interpretations(text, "UTC") == []


def test_ambiguous_readings_and_viterbi_by_neighbours():
    both = T.interpretations("03/04/2025 10:00", "UTC")
    assert [n for n, _ in both] == ["mdy_slash", "dmy_slash"]
    rows = [T.interpretations(t, "UTC") for t in ("25/03/2025 10:00", "03/04/2025 10:00", "05/04/2025 10:00")]
    assert [r[i][0] for r, i in zip(rows, T.viterbi(rows))] == ["dmy_slash"] * 3
    assert [r[i][0] for r, i in zip(rows, T.viterbi(rows, T.DECLARED))][1:] == ["mdy_slash"] * 2


def price(rows, path):
    return sum(T.SWITCH * (a[i][0] != b[j][0]) + T.BACK * (b[j][1] < a[i][1]) for (a, i), (b, j) in itertools.pairwise(zip(rows, path)))


def test_viterbi_is_cheapest():
    rows = [T.interpretations(t, "UTC") for t in ("03/04/2025", "04/03/2025", "2025-03-05", "06/07/2025", "07/06/2025", "09/12/2025")]
    best = min(price(rows, p) for p in itertools.product(*[range(len(r)) for r in rows]))
    assert price(rows, T.viterbi(rows)) == best


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "fact_id long, created_at string, client_tz string, layout string, key int")
    return sorted((r.key, r.text, r.created_us, r.layout) for r in T.normalise_timestamps(df, key="fact_id", text="created_at", tz="client_tz", source="client_tz", **how).collect())


def test_blocks_equal_one_piece(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    texts = [f"{1 + i % 12:02}/{1 + (5 * i) % 12:02}/2025 10:00" for i in range(23)]
    states = [T.interpretations(t, "UTC") for t in texts]
    got = run(spark, [(i, t, "UTC", "", 0) for i, t in enumerate(texts)], declared=None)
    assert len(got) == 23
    chosen = [[n for n, _ in s].index(g[3]) for s, g in zip(states, got)]
    assert price(states, chosen) == price(states, T.viterbi(states))


def test_rows(spark):
    rows = [(1, "2025-01-01", None, "", 0), (1, "2025-01-01", None, "", 0), (1, "2025-01-02", None, "", 0), (2, None, "UTC", "", 0), (3, "unknown", "UTC", "", 0), (None, "2025-01-01", "UTC", "", 0)]
    assert [(k, u) for k, _, u, _ in run(spark, rows)] == [(1, us(2025, 1, 1)), (1, us(2025, 1, 2))]
    assert run(spark, []) == []


def test_a_chain_over_many_spans_equals_the_plain_form(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "SPAN", 2)
    rng = random.Random(3)
    texts = [f"{rng.randrange(1, 13):02}/{rng.randrange(1, 13):02}/2025 {rng.randrange(24):02}:00" for _ in range(40)]
    df = spark.createDataFrame([(i, t, "UTC", "s") for i, t in enumerate(texts)], "k bigint, t string, z string, s string")
    got = {r.key: (r.layout, r.created_us) for r in T.normalise_timestamps(df, key="k", text="t", tz="z", source="s", declared=None).collect()}
    rows = [T.interpretations(t, "UTC") for t in texts]
    cost = lambda path: sum(T.SWITCH * (a[0] != b[0]) + T.BACK * (b[1] < a[1]) for a, b in zip(path, path[1:]))
    assert cost([got[i] for i in range(40)]) == cost([r[i] for r, i in zip(rows, T.viterbi(rows))])


def test_all_readings_are_states_and_the_declared_one_wins(spark):
    df = spark.createDataFrame([(1, "03/04/2025", "UTC"), (2, "13/04/2025", "UTC"), (3, " " * 300 + "2025-04-14", "UTC")], "k bigint, t string, z string")
    got = {r.key: (r.layout, r.n_readings) for r in T.normalise_timestamps(df, key="k", text="t", tz="z", source="z").collect()}
    assert got == {1: ("mdy_slash", 2), 2: ("dmy_slash", 1), 3: ("iso", 1)}
