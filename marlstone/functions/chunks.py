"""Small texts cut in the JVM by folds over their paragraphs or characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows(text: Column, size: int, overlap: int) -> Column:
    """Character windows of `size` that step by size - overlap; the last may be shorter. A text without characters has none."""
    step = size - overlap
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def merged(parts: Column, least: int) -> Column:
    """Neighbouring parts joined by a blank line until each has `least` characters; a short last one joins the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        full = F.char_length(joined) >= least
        return F.struct(F.when(full, F.array_append(acc["done"], joined)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        tail = F.array(F.concat(F.element_at(acc["done"], -1), F.lit("\n\n"), acc["open"]))
        return F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(F.concat(F.slice(acc["done"], F.lit(1), n - 1), tail))

    return F.aggregate(parts, start, step, finish)


def sections(text: Column) -> Column:
    """A text cut before each Markdown heading; the part before the first heading comes first if there is any."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^(?=#{1,6} )")
    return F.filter(parts, lambda p: F.trim(p) != "")


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+([^\r\n]+?)[ \t]*\r?$"), F.lit(1))
