"""Mixed timestamp formats and time zones to one UTC instant (problem 5).

Every text is read in all ways that are valid for it: an array of
interpretations (layout, instant). A Viterbi pass over each source's record
order picks one per record, where leaving the declared conventions, switching
the layout and stepping back in time cost. With conventions declared their
price outweighs what any neighbour can save, so a reading outside is taken only
where a value has no other; among several inside, and without declared
conventions among all, the neighbours decide.

The pass runs over blocks of consecutive records. A block's (min, +) matrix
from its first to its last state is all that a later block needs, so no task
holds a whole source: matrices are made per block and multiplied to those of
spans of SPAN blocks, the spans are chained, and spans and then blocks are
traced back on their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import cut

#: Prices of a path. One record's choice changes two steps, so outside is dearer than any choice can save.
SWITCH, BACK, OUTSIDE = 1.0, 1.5, 1e6
#: Record numbers in a block, blocks in a span.
BLOCK, SPAN = 4_096, 1_024

#: Month names in English and German, by their first letters.
_MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "feb": 2, "february": 2, "februar": 2, "mar": 3, "march": 3, "märz": 3, "mrz": 3, "apr": 4, "april": 4, "may": 5, "mai": 5, "jun": 6, "june": 6, "juni": 6,
    "jul": 7, "july": 7, "juli": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "dez": 12, "dezember": 12,
}
#: Hours east of UTC of zone abbreviations.
_ABBREVIATIONS = {"utc": 0, "gmt": 0, "z": 0, "cet": 1, "cest": 2, "mez": 1, "mesz": 2, "bst": 1, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "aest": 10, "aedt": 11, "ist": 5.5, "jst": 9, "msk": 3}

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{1,2}|(?:UTC|GMT)\s*[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}))?(?:\s*\[(?P<r>[A-Za-z_]+(?:/[A-Za-z_+-]+)*)\])?"
_AMPM = r"(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?))?"
#: Layouts in order of trial: name, pattern. Several may fit one text.
_LAYOUTS = [
    (name, re.compile(pattern + "$"))
    for name, pattern in [
        ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:\s*[Tt]\s*|\s+){_TIME}{_AMPM}{_ZONE})?"),
        ("compact", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt](?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?" + _ZONE),
        ("ymd_slash", rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:\s+{_TIME}{_AMPM}{_ZONE})?"),
        ("mdy_slash", rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?"),
        ("dmy_slash", rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?"),
        ("dmy_dot", rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}})(?:,?\s+{_TIME}{_AMPM}(?:\s*Uhr)?{_ZONE})?"),
        ("mdy_dot", rf"(?P<m>\d{{1,2}})\.(?P<d>\d{{1,2}})\.(?P<y>\d{{4}})(?:,?\s+{_TIME}{_AMPM}(?:\s*Uhr)?{_ZONE})?"),
        ("dmy_dash", rf"(?P<d>\d{{1,2}})-(?P<m>\d{{1,2}})-(?P<y>\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?"),
        ("cjk", r"(?P<y>\d{4})\s*年\s*(?P<m>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*[日号](?:\s*(?P<cn>上午|下午|中午|凌晨|早上|晚上))?(?:\s*(?:(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?|(?P<H2>\d{1,2})\s*[时點点]\s*(?:(?P<M2>\d{1,2})\s*分)?\s*(?:(?P<S2>\d{1,2})\s*秒)?))?" + _ZONE),
        ("day_name", rf"(?:[A-Za-z]{{2,9}},?\s+)?(?P<d>\d{{1,2}})(?:\.|\s)\s*(?P<mon>[A-Za-zä]{{3,9}})\.?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:um\s+)?{_TIME}{_AMPM}(?:\s*Uhr)?{_ZONE})?"),
        ("name_day", rf"(?:[A-Za-z]{{2,9}},\s+)?(?P<mon>[A-Za-zä]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_AMPM}{_ZONE})?"),
    ]
]
_NUMBER = re.compile(r"([+-]?)(\d+)(?:[.,](\d+))?$")
_EPOCH = datetime(1970, 1, 1)
#: What the data's description declares: slashes with the year last are month first, dots day first.
DECLARED = frozenset({"iso", "compact", "ymd_slash", "mdy_slash", "dmy_dot", "dmy_dash", "cjk", "day_name", "name_day", "epoch_s", "epoch_ms", "epoch_us"})


def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name.strip()) if name and name.strip() else None  # ZoneInfo keeps its zones
    except (KeyError, ValueError, OSError):
        return None


def _offset(z: str) -> int | None:
    """Seconds east of UTC of a written zone; None if it is none."""
    s = z.strip().lower()
    if s in _ABBREVIATIONS:
        return int(_ABBREVIATIONS[s] * 3600)
    m = re.fullmatch(r"(?:utc|gmt)?\s*([+-])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?", s)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return None
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60 + int(m[4] or 0))


def _wall(name: str, m: re.Match) -> tuple[datetime, int] | None:
    """The wall time a match names, with microseconds apart; None where there is no such time."""
    g = m.groupdict()
    month = _MONTHS.get(g["mon"].lower()) if g.get("mon") else int(g["m"])
    if month is None:
        return None
    hour, minute, second = int(g.get("H") or g.get("H2") or 0), int(g.get("M") or g.get("M2") or 0), int(g.get("S") or g.get("S2") or 0)
    half = (g.get("ap") or "").lower().replace(".", "")
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half == "pm" else 0)
    elif cn := g.get("cn"):
        if cn in ("下午", "晚上") and hour < 12:
            hour += 12
        elif cn in ("上午", "凌晨", "早上") and hour == 12:
            hour = 0
    plus = timedelta(0)
    if hour == 24 and minute == second == 0:
        hour, plus = 0, timedelta(days=1)
    try:
        return datetime(int(g["y"]), month, int(g["d"]), hour, minute, second) + plus, int(((g.get("f") or "") + "000000")[:6])
    except (ValueError, OverflowError):
        return None


def interpretations(text: str | None, client_tz: str | None) -> list[tuple[str, int]]:
    """All valid readings of a text as (layout, UTC microseconds), in the order of the layouts.

    A zone or offset in the text decides, else client_tz, else UTC (also where
    client_tz names no zone). Missing time parts are zero, digits beyond
    microseconds are cut off. A wall time that occurs twice means the first; a
    skipped one moves forward by the gap. Nulls, blanks, relative words and
    impossible dates have no reading, nor has text of over 200 characters
    without outer and doubled blanks, nor a number of over 17 digits (which would
    be microseconds beyond the year 5000).
    """
    if text is None:
        return []
    s = " ".join(unicodedata.normalize("NFKC", text).split()).replace("−", "-")
    if not s or len(s) > 200:
        return []
    if m := _NUMBER.match(s):
        if len(m[2]) > 17:
            return []
        n, frac = int(m[2]), m[3] or ""
        name, digits = ("epoch_s", 6) if n < 10**11 else ("epoch_ms", 3) if n < 10**14 else ("epoch_us", 0)
        us = n * 10**digits + int((frac + "000000")[:digits] or 0)
        return [(name, -us if m[1] == "-" else us)]
    out = []
    for name, pattern in _LAYOUTS:
        if not (m := pattern.match(s)) or not (wall := _wall(name, m)):
            continue
        when, micro = wall
        z, region = m.group("z"), _zone(m.group("r")) if m.group("r") else None
        if m.group("r") and region is None and m.group("r").upper() not in ("UTC", "GMT", "Z"):
            continue
        if z:
            off = _offset(z)
            if off is None:
                continue
            us = (when - _EPOCH) // timedelta(microseconds=1) - off * 1_000_000
        else:
            zone = region or (UTC if m.group("r") else None) or _zone(client_tz) or UTC
            off = when.replace(tzinfo=zone, fold=0).utcoffset()
            us = (when - _EPOCH - off) // timedelta(microseconds=1)
        if all(us != u for _, u in out):  # the same instant in two layouts is one reading
            out.append((name, us + micro))
    return out


def _costs(states: list, declared: frozenset | None) -> np.ndarray:
    return np.array([0.0 if not declared or name in declared else OUTSIDE for name, _ in states])


def _step(a: list, b: list) -> np.ndarray:
    """Price of going from each state of a to each of b."""
    out = np.zeros((len(a), len(b)))
    for i, (fa, ua) in enumerate(a):
        for j, (fb, ub) in enumerate(b):
            out[i, j] = SWITCH * (fa != fb) + BACK * (ub < ua)
    return out


def _forward(rows: list, declared: frozenset | None, start: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Best prices to reach every state from each start state (rows of `start`), with back pointers."""
    best, back = start, []
    every = [best]
    for a, b in zip(rows, rows[1:]):
        via = best[:, :, None] + _step(a, b)[None, :, :]
        back.append(via.argmin(1))
        best = via.min(1) + _costs(b, declared)[None, :]
        every.append(best)
    return every, back


def _trace(back: list[np.ndarray], row: int, last: int) -> list[int]:
    path = [last]
    for b in reversed(back):
        path.append(int(b[row, path[-1]]))
    return path[::-1]


def viterbi(rows: list[list[tuple[str, int]]], declared: frozenset | None = None) -> list[int]:
    """The cheapest choice of one state per row, in one piece: the plain form that the blocks must equal."""
    if not rows:
        return []
    every, back = _forward(rows, declared, _costs(rows[0], declared)[None, :])
    return _trace(back, 0, int(every[-1][0].argmin()))




def normalise_timestamps(df: DataFrame, *, key: str, text: str, tz: str, source: str, declared: frozenset | None = DECLARED) -> DataFrame:
    """(key, text, layout, created_us, n_readings) for each distinct record with a readable text.

    key BIGINT gives the record order within a source; source is cast to text
    (null is a source of its own). Repeated rows count once; a key with several
    texts gives a row for each. Unreadable and null texts give no row. Rows
    with a null key have no place in the order and are left out. `declared`:
    layouts that go before all others (None: the neighbours decide).
    """
    # Names of the input never clash with ours: everything is renamed here.
    base = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.col(tz).alias("tz"), F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("source")).where("key is not null and text is not null").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [interpretations(t, z if isinstance(z, str) else None) for t, z in zip(b["text"], b["tz"])]
            b = b.assign(layouts=[[n for n, _ in g] for g in got], instants=[[u for _, u in g] for g in got])
            yield b[[bool(g) for g in got]]

    read_rows = base.mapInPandas(read, "key bigint, text string, tz string, source string, layouts array<string>, instants array<bigint>")
    read_rows = cut(read_rows.withColumn("block", F.floor(F.col("key") / BLOCK).cast("bigint")))  # reading is the costly part: once

    def states(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list]:
        pdf = pdf.sort_values(["key", "text", "tz"], kind="stable", na_position="first")
        return pdf, [list(zip(a, (int(x) for x in u))) for a, u in zip(pdf["layouts"], pdf["instants"])]

    blocks = ["source", "block"]
    kinds = "source string, block bigint, key bigint, text string, layout string, created_us bigint, n_readings int"

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        first, rows = pdf[blocks].iloc[0], states(pdf)[1]
        start = np.where(np.eye(len(rows[0])) > 0, _costs(rows[0], declared)[None, :], np.inf)
        end = _forward(rows, declared, start)[0][-1]
        return pd.DataFrame([{**first, "head_l": [n for n, _ in rows[0]], "head_u": [u for _, u in rows[0]], "tail_l": [n for n, _ in rows[-1]], "tail_u": [u for _, u in rows[-1]], "cost": end.ravel().tolist()}])

    def links(pdf: pd.DataFrame) -> list[tuple[list, list, np.ndarray]]:
        out = []
        for r in pdf.itertuples():
            head, tail = list(zip(r.head_l, r.head_u)), list(zip(r.tail_l, r.tail_u))
            out.append((head, tail, np.array(r.cost).reshape(len(head), len(tail))))
        return out

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        """The matrices of one span's blocks as one."""
        pdf = pdf.sort_values("block")
        parts = links(pdf)
        head, tail, m = parts[0]
        for h, t, n in parts[1:]:
            m = (m[:, :, None] + _step(tail, h)[None]).min(1)
            m, tail = (m[:, :, None] + n[None]).min(1), t
        return pd.DataFrame([{"source": pdf["source"].iloc[0], "block": pdf["span"].iloc[0], "head_l": [n for n, _ in head], "head_u": [u for _, u in head], "tail_l": [n for n, _ in tail], "tail_u": [u for _, u in tail], "cost": m.ravel().tolist()}])

    def chain(pdf: pd.DataFrame, enter: int | None = None, leave: int | None = None) -> pd.DataFrame:
        """For each matrix of a run, the state to enter and to leave by: a Viterbi pass over matrices, between given ends if there are any."""
        pdf = pdf.sort_values("block")
        ends, picks = None, []
        for head, tail, m in links(pdf):
            first = np.zeros(len(head)) if enter is None else np.where(np.arange(len(head)) == enter, 0.0, np.inf)
            into = first[None, :] if ends is None else ends[0][:, None] + _step(ends[1], head)
            src, cost_in = into.argmin(0), into.min(0)
            via = cost_in[:, None] + m
            picks.append((src, via.argmin(0)))
            ends = (via.min(0), tail)
        out, last = [], int(ends[0].argmin()) if leave is None else leave
        for (src, heads), b in zip(reversed(picks), reversed(pdf["block"].tolist())):
            head = int(heads[last])
            out.append((pdf["source"].iloc[0], b, head, last))
            last = int(src[head])
        return pd.DataFrame(out, columns=["source", "block", "head", "tail"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        return chain(pdf)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return chain(pdf, int(pdf["head"].iloc[0]), int(pdf["tail"].iloc[0]))

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        head, tail = int(pdf["head"].iloc[0]), int(pdf["tail"].iloc[0])
        pdf, rows = states(pdf)
        start = np.full((1, len(rows[0])), np.inf)
        start[0, head] = 0.0
        path = _trace(_forward(rows, declared, start)[1], 0, tail)
        chosen = [r[i] for r, i in zip(rows, path)]
        return pd.DataFrame({"source": pdf["source"], "block": pdf["block"], "key": pdf["key"], "text": pdf["text"], "layout": [n for n, _ in chosen], "created_us": [u for _, u in chosen], "n_readings": [len(r) for r in rows]})

    ends = "head_l array<string>, head_u array<bigint>, tail_l array<string>, tail_u array<bigint>, cost array<double>"
    picked = "source string, block bigint, head int, tail int"
    matrices = cut(read_rows.groupBy(*blocks).applyInPandas(matrix, "source string, block bigint, " + ends).withColumn("span", F.floor(F.col("block") / SPAN).cast("bigint")))
    spans = matrices.groupBy("source", "span").applyInPandas(product, "source string, block bigint, " + ends).groupBy("source").applyInPandas(across, picked)
    picks = matrices.join(spans.withColumnRenamed("block", "span"), ["source", "span"]).groupBy("source", "span").applyInPandas(inside, picked)
    chosen = read_rows.join(picks, blocks).groupBy(*blocks).applyInPandas(trace, kinds)
    return chosen.select(F.col("key"), "text", "layout", "created_us", "n_readings")
