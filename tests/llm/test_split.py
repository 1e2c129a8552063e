from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.llm import split as S

SCHEMA = "src string, item_id long, part_id long, text string, start string, piece_no string"


def run(spark, texts, **how):
    rows = [("t", i, 0, t, "", "") for i, t in enumerate(texts)]
    by = defaultdict(list)
    for r in S.pieces(spark.createDataFrame(rows, SCHEMA), **how).collect():
        by[r.item_id].append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in by.items()}


def whole(text, pieces, most, overlap):
    at = 0
    for n, p in enumerate(pieces):
        assert p.piece_no == n and p.text == text[p.start : p.stop] and 0 < len(p.text) <= most
        assert 0 <= at - p.start <= overlap and p.stop > at
        at = p.stop
    assert at == len(text)


PROSE = "".join(f"Sentence number {i} of the text says little.{' ' if i % 7 else chr(10) * 2}" for i in range(400))


def test_round_trip_and_natural_ends(spark):
    texts = [PROSE, "字" * 4000, "𝒳y " * 2000, "。".join(["汉字句子"] * 900), "a\r\n" * 3000, "x" * 20_000, PROSE[:1500], PROSE[:1501], ""]
    got = run(spark, texts)
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7]
    for i, p in got.items():
        whole(texts[i], p, 1500, 100)
    assert all(p.text.endswith("\n\n") for p in got[0][:-1])
    assert all(p.text.endswith("。") for p in got[3][:-1])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .\n!。汉😀", min_size=0, max_size=300), max_size=4))
def test_any_text(spark, texts):
    got = run(spark, texts, most=40, overlap=7, length=64)
    assert sorted(got) == [i for i, t in enumerate(texts) if len(t) > 40]
    for i, p in got.items():
        whole(texts[i], p, 40, 7)


def test_any_range_length_gives_whole_items_and_natural_ends(spark):
    for n in (1_700, 4_096, 100_000):
        p = run(spark, [PROSE], length=n)[0]
        whole(PROSE, p, 1500, 100)
        assert all(x.text.endswith(("\n\n", ". ", ".")) for x in p)
    text = "汉字😀" * 3_000  # no boundary anywhere
    whole(text, run(spark, [text], length=1_700)[0], 1500, 100)


def test_neighbours_agree_on_their_anchor():
    for most, overlap, length in ((40, 7, 64), (100, 20, 300)):
        got, total = [], len(PROSE)
        for start in range(0, total, length):
            before, own = min(start, overlap + S._EDGE), min(length, total - start)
            got += S.range_pieces(PROSE[start - before : start + own + most + S._EDGE], before, own, start, total, most=most, overlap=overlap, length=length, find=S.boundaries)
        at = 0
        for _, x, y in got:
            assert 0 <= at - x <= overlap and at < y <= x + most
            at = y
        assert at == total


def test_no_overlap_null_keys_and_bad_arguments(spark):
    assert "".join(p.text for p in run(spark, [PROSE], overlap=0)[0]) == PROSE
    rows = [("t", None, 0, PROSE, "", ""), (None, 1, 0, PROSE, "", ""), ("t", 2, 0, None, "", "")]
    assert S.pieces(spark.createDataFrame(rows, SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        S.pieces(spark.createDataFrame(rows, SCHEMA), overlap=900)


def test_files_by_byte_ranges(spark, tmp_path):
    data = (PROSE + "汉字，" * 3000 + "😀" * 2000).encode()
    f = tmp_path / "big.txt"
    f.write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    got = sorted(S.file_pieces(spark, str(tmp_path), length=4096).collect(), key=lambda r: r.piece_no)
    at = 0
    for n, p in enumerate(got):
        assert p.piece_no == n and data[p.start : p.stop].decode() == p.text and p.stop - p.start <= 1500 and 0 <= at - p.start <= 100
        at = p.stop
    assert at == len(data)
