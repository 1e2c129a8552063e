"""Splitting oversized items at natural boundaries (problem 4).

An item is never handled in one piece. It is cut into ranges with halos, and
each range, on its own, lists the natural boundaries inside it. Where one range
begins a piece ends in any case: at the best boundary of the range's first
characters, its anchor. The range before sees the same characters in its halo
and so finds the same anchor, which stitches their boundary tables without a
pass over the item; a range chooses the cuts between its anchor and the next and
emits its pieces by offset. The numbers of pieces summed up over the ranges
before give each piece its number. Ranges come from rows of a table or, by byte
offsets, from files of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.runtime import cut, shuffled

#: Characters (bytes of a file) a range owns; its halos are an overlap and a piece longer, and _EDGE for separators.
RANGE, FILE_RANGE = 65_536, 1 << 20
_EDGE = 8
#: Ranges that are numbered together.
SPAN = 4_096
#: Paragraph ends, line ends, sentence ends (CJK ones need no blank after them), words' ends.
_BOUNDARIES = [
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),
    re.compile(r"\r\n|\r|\n| | |\x85"),
    re.compile(r"[。！？；…]+[」』”’）)]*|[.!?;]+[\"'”’)\]]*(?:\s+)"),
    re.compile(r"\s+|[，、,]"),
]


def boundaries(text: str, before: int, own: int) -> tuple[list[int], list[int]]:
    """(offsets, ranks) of boundaries with before < offset <= before + own; an offset is where the next piece may begin, rank 0 the best kind."""
    best: dict[int, int] = {}
    for rank, pattern in enumerate(_BOUNDARIES):
        for m in pattern.finditer(text):
            if before < m.end() <= before + own:
                best.setdefault(m.end(), rank)
    at = sorted(best)
    return at, [best[i] for i in at]


def resume(marks: list[tuple[int, int]], end: int, floor: int, overlap: int) -> int:
    """Where the piece after one that ends at `end` begins: it repeats whole sentences or words where a boundary allows, from `floor` on."""
    ranked = [x for x in marks if floor <= x[0] < end] if overlap else []
    if not ranked:
        return floor if overlap else end
    best = min(rank for _, rank in ranked)
    return min(at for at, rank in ranked if rank == best)


class Cutter:
    """Chooses cuts while boundaries arrive in order; its state is one open piece."""

    def __init__(self, most: int, overlap: int, start: int = 0):
        self.most, self.overlap = most, overlap
        self.start, self.number = start, 0
        self.open: list[tuple[int, int]] = []  # boundaries after start

    def _cut(self) -> tuple[int, int, int]:
        """Close the open piece: the best kind of boundary in its second half, the last of that kind; else the last of any kind; else its full length."""
        end = self.start + self.most
        fit = [(at, rank) for at, rank in self.open if self.start + self.overlap < at <= end]
        late = [x for x in fit if x[0] > self.start + self.most // 2] or fit
        if late:
            best = min(rank for _, rank in late)
            end = max(at for at, rank in late if rank == best)
        piece = (self.number, self.start, end)
        self.start = resume(self.open, end, max(self.start + 1, end - self.overlap), self.overlap)
        self.number += 1
        self.open = [x for x in self.open if x[0] > self.start]
        return piece

    def feed(self, at: list[int], rank: list[int], seen: int) -> Iterator[tuple[int, int, int]]:
        """Take the boundaries up to offset `seen`; give the pieces that are certain."""
        self.open += zip(at, rank)
        while seen - self.start > self.most:
            yield self._cut()

    def close(self, total: int) -> Iterator[tuple[int, int, int]]:
        while total - self.start > self.most:
            yield self._cut()
        yield (self.number, self.start, total)


_KEYS = ["src", "item_id", "part_id"]
_KEY_TYPES = "src string, item_id bigint, part_id bigint"


def anchor(window, before: int, find) -> int:
    """The offset, in the range that a window around a range's beginning belongs to, where a piece ends: the first of the best boundaries; 0 where there is none."""
    at, rank = find(window, before, len(window) - before - _EDGE)
    return next((a - before for a, r in zip(at, rank) if r == min(rank)), 0)


def range_pieces(data, before: int, own: int, start: int, total: int, *, most: int, overlap: int, length: int, find) -> list[tuple[int, int, int]]:
    """(number, start, stop) of the pieces of one range, by offsets of the item; data is the range with its halos, find lists boundaries."""
    zero = start - before  # the offset of data's first character
    reach = most + _EDGE

    def at_beginning(of: int) -> int:
        left = min(of, overlap + _EDGE)
        return of + anchor(data[of - left - zero : min(of + reach, total) - zero], left, find)

    first = 0 if start == 0 else at_beginning(start)
    last = total if start + own >= total else at_beginning(start + own)
    places, ranks = find(data, 0, len(data))
    marks = [(p + zero, r) for p, r in zip(places, ranks) if p + zero < last]
    begin = first if start == 0 else resume(marks, first, first - overlap, overlap)
    cutter = Cutter(most, overlap, begin)
    return [*cutter.feed([p for p, _ in marks if p > begin], [r for p, r in marks if p > begin], last), *cutter.close(last)]


_KEYS = ["src", "item_id", "part_id"]
_KEY_TYPES = "src string, item_id bigint, part_id bigint"
_PIECES = ", range_no bigint, local_no bigint, start bigint, stop bigint, text string"


def table_ranges(items: DataFrame, *, most: int, overlap: int, length: int = RANGE) -> DataFrame:
    """Ranges of items (src, item_id, part_id, text) longer than `most` characters: range_no, before, own, total, text with halos."""
    n = F.char_length("text")
    long = items.where("text is not null and src is not null and item_id is not null and part_id is not null").where(n > most).select(*_KEYS, "text", n.cast("bigint").alias("total"))
    cut_up = long.select(*_KEYS, "total", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / length))).alias("range_no"))
    start = F.col("range_no") * length
    before = F.least(F.lit(overlap + _EDGE), start)
    own = F.least(F.lit(length), F.col("total") - start)
    return cut_up.select(*_KEYS, "range_no", "total", before.cast("int").alias("before"), own.cast("int").alias("own"), F.substring("text", (start - before + 1).cast("int"), (before + own + most + _EDGE).cast("int")).alias("data"))


def _cut_ranges(most: int, overlap: int, length: int, find, as_text):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                start = r.range_no * length
                for no, x, y in range_pieces(r.data, r.before, r.own, start, r.total, most=most, overlap=overlap, length=length, find=find):
                    out.append((r.src, r.item_id, r.part_id, r.range_no, no, x, y, as_text(r.data[x - start + r.before : y - start + r.before])))
            yield pd.DataFrame(out, columns=[*_KEYS, "range_no", "local_no", "start", "stop", "text"])

    return run


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with piece_no: the number in their range after those of all ranges before, summed up by spans of ranges."""
    pieces = cut(pieces)
    span = F.floor(F.col("range_no") / SPAN).alias("span")
    counts = pieces.groupBy(*_KEYS, "range_no").agg(F.count(F.lit(1)).alias("n")).select("*", span)
    w = Window.partitionBy(*_KEYS).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy(*_KEYS, "span").agg(F.sum("n").alias("m")).withColumn("m", F.coalesce(F.sum("m").over(w), F.lit(0)))
    w = Window.partitionBy(*_KEYS, "span").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("k", F.coalesce(F.sum("n").over(w), F.lit(0))).join(shuffled(spans), [*_KEYS, "span"]).select(*_KEYS, "range_no", (F.col("m") + F.col("k")).alias("first"))
    return pieces.join(shuffled(first), [*_KEYS, "range_no"]).withColumn("piece_no", F.col("first") + F.col("local_no"))


def pieces(items: DataFrame, *, most: int = 1_500, overlap: int = 100, length: int = RANGE, number: bool = True) -> DataFrame:
    """(src, item_id, part_id, piece_no, start, stop, text): the items longer than `most` characters, in pieces of at most `most`.

    items: src, item_id, part_id (unique together), text; other columns are
    ignored. Characters are Unicode code points. A piece ends at a paragraph,
    line or sentence end, else between words, else at its full length, and
    repeats at most `overlap` characters of the one before. Pieces without
    their repeated beginnings give the text again. Nulls, empty texts and
    texts of at most `most` characters give no rows, nor do rows with a null
    key. number=False leaves piece_no out, and the shuffle it takes.
    """
    if not 0 <= overlap < most // 2 or most + overlap > length:
        raise ValueError("overlap must be under half of most, and most under a range's length")
    got = table_ranges(items, most=most, overlap=overlap, length=length).mapInPandas(_cut_ranges(most, overlap, length, boundaries, str), _KEY_TYPES + _PIECES)
    return numbered(got).select(*_KEYS, "piece_no", "start", "stop", "text") if number else got.select(*_KEYS, "start", "stop", "text")


def byte_boundaries(raw: bytes, before: int, own: int) -> tuple[list[int], list[int]]:
    """As `boundaries`, with byte offsets; characters cut in two at the edges are left out."""
    lead = 0
    while lead < min(4, len(raw)) and raw[lead] & 0xC0 == 0x80:
        lead += 1
    text = raw[lead:].decode("utf-8", "ignore")
    at, rank = boundaries(text, 0, len(text))
    sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (sizes >= 0x80) + (sizes >= 0x800) + (sizes >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)]) + lead
    marks = dict.fromkeys(range(16, len(text), 16), len(_BOUNDARIES)) | dict(zip(at, rank))  # and, as the last kind, every 16th character: no piece begins inside one
    keep = [(int(byte[a]), marks[a]) for a in sorted(marks) if before < byte[a] <= before + own]
    return [a for a, _ in keep], [r for _, r in keep]


def file_ranges(spark: SparkSession, path: str, *, most: int, overlap: int, length: int = FILE_RANGE) -> DataFrame:
    """Ranges of the UTF-8 files under a path, as table_ranges with bytes for characters.

    Spark lists the files and their sizes and makes the ranges; each task then
    opens a file at its own range and reads that much and the halos. The path is
    of any file system that both Spark and pyarrow.fs know.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("src"), "length")  # without `content` no file is read
    jobs = files.select("src", F.col("length").alias("total"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / length))).alias("range_no"))
    jobs = jobs.repartition(F.col("src"), F.col("range_no"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for src, total, no in zip(b["src"], b["total"], b["range_no"]):
                system, where = fs.FileSystem.from_uri(src if "://" in src else src.replace(":/", ":///", 1))
                start = int(no) * length
                before = min(overlap + _EDGE, start)
                own = min(length, int(total) - start)
                with system.open_input_file(where) as f:
                    raw = f.read_at(min(before + own + most + _EDGE, int(total) - start + before), start - before)
                yield pd.DataFrame([{"src": src, "item_id": 0, "part_id": 0, "range_no": no, "total": total, "before": before, "own": own, "data": raw}])

    return jobs.mapInPandas(read, _KEY_TYPES + ", range_no bigint, total bigint, before int, own int, data binary")


def file_pieces(spark: SparkSession, path: str, *, most: int = 1_500, overlap: int = 100, length: int = FILE_RANGE, number: bool = True) -> DataFrame:
    """(src, piece_no, start, stop, text) of the UTF-8 files under a path, with sizes and offsets in bytes; no task reads a whole file. Short files are one piece; empty ones give no rows."""
    got = file_ranges(spark, path, most=most, overlap=overlap, length=length).mapInPandas(_cut_ranges(most, overlap, length, byte_boundaries, lambda x: x.decode("utf-8", "replace")), _KEY_TYPES + _PIECES)
    return numbered(got).select("src", "piece_no", "start", "stop", "text") if number else got.select("src", "start", "stop", "text")


def reassembled(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, n_pieces, longest, most_repeated): items put together again from their pieces; of items that fit a row."""
    w = Window.partitionBy(*keys).orderBy("piece_no")
    p = pieces.withColumn("again", F.greatest(F.lag("stop").over(w) - F.col("start"), F.lit(0)))
    gap = p.withColumn("gap", F.coalesce(F.lag("stop").over(w) < F.col("start"), F.lit(False)))
    parts = gap.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(text, int(coalesce(again, 0)) + 1)").alias("t")))).alias("p"), F.count(F.lit(1)).alias("n_pieces"), F.max(F.char_length("text")).alias("longest"), F.coalesce(F.max("again"), F.lit(0)).alias("most_repeated"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), "n_pieces", "longest", "most_repeated")
