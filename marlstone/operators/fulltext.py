"""Full-text search over grams: inverted tables, BM25, query rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Where a query is cut before grams are taken.
CUTS = r"[\s,，。；;、/（）()？?！!：:+【】\[\]「」『』\-—·…]+"
#: Grams a query is looked up by at most; characters of a hit's text that are shown.
MOST, SHOWN = 12, 120


def gram_array(text: Column, n: int) -> Column:
    """All n-character grams of the lower-cased text, in one pass over it."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))


def postings(docs: DataFrame, n: int) -> DataFrame:
    """(id, gram, tf, dl): the inverted table of docs (id, content); kept as a table by gram, a query reads its few grams alone."""
    grams = docs.select("id", F.greatest(F.char_length(F.lower("content")) - (n - 1), F.lit(0)).alias("dl"), F.explode(gram_array(F.col("content"), n)).alias("gram"))
    return grams.groupBy("id", "gram", "dl").agg(F.count(F.lit(1)).alias("tf"))


def even_sample(items: Column, k: int) -> Column:
    """k elements of an array spread evenly over it, both ends included; halves go to even places. Arrays of at most k stay as they are."""
    n = F.size(items)
    place = lambda i: F.bround(i * (n - 1) / F.lit(k - 1), 0).cast("int")
    return F.when(n <= k, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(items, place(i))))


def query_grams(query: Column, n: int = 3, most: int = MOST) -> Column:
    """The grams a query is looked up by: of every part between cuts each step-th and the last, thinned evenly to `most`.

    A part's step is the number of its grams divided by `most`, so its end is
    covered as well as its beginning. Parts under n characters, null and blank
    queries give none.
    """
    def of_part(p: Column) -> Column:
        total = F.char_length(p) - (n - 1)
        step = F.greatest(F.lit(1), F.floor(total / most).cast("int"))
        places = F.array_union(F.sequence(F.lit(0), total - 1, step), F.array(total - 1))
        return F.transform(places, lambda i: F.substring(p, i + 1, F.lit(n)))

    parts = F.filter(F.split(query, CUTS), lambda p: F.char_length(p) >= n)
    return even_sample(F.coalesce(F.flatten(F.transform(parts, of_part)), F.array().cast("array<string>")), most)


def _times(text: Column, gram: str) -> Column:
    """How often a gram stands in a text, overlaps counted. Where it cannot overlap itself that is what taking it out makes shorter."""
    if any(gram.endswith(gram[:k]) for k in range(1, len(gram))):
        return F.regexp_count(text, F.lit(f"(?={re.escape(gram)})"))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(gram), F.lit("")))) / len(gram.encode())


def _scored(docs: DataFrame, grams: list[str], n: int) -> DataFrame:
    """(id, content, score) of docs that hold a gram, in two scans without a shuffle: one for the counts, one row, and one for the scores."""
    d = docs.select("id", "content", F.explode(F.array(F.lower("content"))).alias("c"))  # explode keeps the lower case from being put into every expression that uses it
    size = F.greatest(F.char_length("c") - (n - 1), F.lit(0))
    held = [F.col("c").contains(g) for g in grams]
    whole = d.agg(F.count("c").alias("n_docs"), F.avg(size).alias("mean_len"), F.array(*[F.count_if(h) for h in held]).alias("df"))
    some, score = F.lit(False), F.lit(0.0)
    for i, (g, h) in enumerate(zip(grams, held)):
        tf, df = _times(F.col("c"), g), F.col("df")[i]
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(h, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean_len")))).otherwise(0.0)
        some = some | h
    return d.where(some).select("id", "content", "c", size.alias("dl")).join(F.broadcast(whole)).select("id", "content", score.alias("score"))


def bm25(docs: DataFrame, grams: list[str], n: int) -> DataFrame:
    """(id, score): BM25 of docs (id, content) for the n-character grams of a query.

    Each text is read once a gram, in linear time; null texts count for
    nothing. No grams give no rows.
    """
    grams = list(dict.fromkeys(g.lower() for g in grams))
    return _scored(docs, grams, n).select("id", "score") if grams else docs.select("id", F.lit(0.0).alias("score")).limit(0)


def bm25_stored(index: DataFrame, n_docs: int, mean_len: float, grams: list[str]) -> DataFrame:
    """As bm25, from a stored table of `postings`: the filter on gram reaches its scan."""
    hits = index.where(F.col("gram").isin(*[g.lower() for g in grams]) if grams else F.lit(False))
    df = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_len))
    return hits.join(F.broadcast(df), "gram").groupBy("id").agg(F.sum(idf * weight).alias("score"))


def how(query: str) -> str:
    """'empty', 'grams' (over 8 characters without a quotation mark), 'phrase' (3 to 8) or 'like'."""
    q = (query or "").strip()
    return "empty" if not q else "like" if '"' in q or len(q) < 3 else "grams" if len(q) > 8 else "phrase"


def search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score, how, shown) best first: grams for long queries, the phrase for middle ones, LIKE for short ones and where there is no gram.

    In LIKE the query's % and _ stay wildcards; its hits have no score and come
    by id. An empty query gives no rows.
    """
    q, way = (query or "").strip().lower(), how(query)
    if way == "grams":
        one = docs.sparkSession.range(1).select(query_grams(F.lit(q)).alias("g")).first()
        if one["g"]:
            best = _scored(docs, list(dict.fromkeys(one["g"])), 3).select("id", "score", F.substring("content", 1, SHOWN).alias("shown"))
            return best.orderBy(F.desc("score"), "id").limit(limit).select("id", "score", F.lit("grams").alias("how"), "shown")
        way = "like"
    d = docs.select("id", F.col("content").alias("text"), F.explode(F.array(F.lower("content"))).alias("c"))
    if way == "phrase":
        times = (F.char_length("c") - F.char_length(F.replace(F.col("c"), F.lit(q), F.lit("")))) / len(q)
        found = d.where(F.col("c").contains(q)).withColumn("score", times)
    else:
        found = d.where(F.col("c").like("%" + q.replace("\\", "\\\\") + "%") if way == "like" else F.lit(False)).withColumn("score", F.lit(0.0))
    return found.orderBy(F.desc("score"), "id").limit(limit).select("id", "score", F.lit(way).alias("how"), F.substring("text", 1, SHOWN).alias("shown"))


def search_with_status(docs: DataFrame | None, query: str, limit: int) -> tuple[DataFrame | None, str]:
    """The hits and 'ok', 'empty' (nothing was asked) or 'degraded' (there is no text table)."""
    if how(query) == "empty":
        return None if docs is None else search(docs, query, limit), "empty"
    return (None, "degraded") if docs is None else (search(docs, query, limit), "ok")


def quoted(gram: Column) -> Column:
    """A gram as a literal: in quotation marks, inner ones doubled."""
    return F.concat(F.lit('"'), F.replace(gram, F.lit('"'), F.lit('""')), F.lit('"'))
