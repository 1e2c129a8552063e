"""Evaluation passages inside training texts (problem 7).

One pass over the corpus finds every n-gram of words that also occurs in a
passage. How many documents hold each is counted over the whole corpus, and of
every stretch of a passage the rarest n-grams that any document holds become
seeds, and so do all that few documents hold: any shared run of `run` words
holds a seed, so exact copies are never missed, and an edited copy needs one
n-gram that few documents share, while phrases that half the corpus uses lead
to few comparisons. Documents joined to items by seeds
are aligned by Smith-Waterman over words, around the n-grams both hold, which
scores edited copies; the longest run they share is measured beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.runtime import cut, shuffled

#: The ranges of the Han script.
_HAN = "⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎\U00020000-\U000323af"
_WORD = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
#: Characters of passages that go to the workers at once; a larger set is taken in blocks of that size.
ITEM_CHARS = 4_000_000
#: How much longer than the passage an aligned stretch is at each side, in parts of it; cells of a row of alignments at once.
SLACK, CELLS = 0.5, 65_536
_BASE = 0x9E3779B97F4A7C15
MATCH, MISMATCH, GAP = 2, -1, -1
#: An n-gram is a seed if it is in at most so many times the documents of the rarest one of a run that holds it: edited copies lack some.
RARE = 2
#: An n-gram in at most so many documents is a seed whatever the others of its run are.
FEW = 24


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, each Han character by itself, without case."""
    return _WORD.findall(text.casefold()) if text else []


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word numbers; 0 where one of them is 0 (unknown)."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h, known = np.zeros(m, np.uint64), np.ones(m, bool)
    with np.errstate(over="ignore"):
        for i in range(n):
            part = ids[i : i + m]
            known &= part > 0
            h = (h + part.astype(np.uint64)) * np.uint64(_BASE)
            h ^= h >> np.uint64(31)
    return np.where(known, h.view(np.int64) | np.int64(1), 0)


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman score with linear gaps, words in the longest shared stretch) of each pair of word numbers, all pairs a row at a time.

    0 stands for a word the other side lacks and equals nothing.
    """
    n, rows, width = len(pairs), max(len(p) for p, _ in pairs), max(len(t) for _, t in pairs)
    p, t = np.full((n, rows), -1, np.int32), np.full((n, width), -2, np.int32)
    for i, (a, b) in enumerate(pairs):
        p[i, : len(a)], t[i, : len(b)] = np.where(a == 0, -1, a), b
    steps = (-GAP * np.arange(width + 1)).astype(np.int32)
    score, run = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    best, longest = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(rows):
        same = t == p[:, i, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        new = np.maximum(score + GAP, 0)
        np.maximum(new[:, 1:], score[:, :-1] + np.where(same, MATCH, MISMATCH), out=new[:, 1:])
        score = np.maximum.accumulate(new + steps, axis=1) - steps  # gaps along the text: the best earlier cell, less its distance
        np.maximum(best, score.max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def _find(shared, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, known = shared.value
        get = vocabulary.get
        for b in batches:
            docs, texts, found = [], [], []
            for doc, text in zip(b["doc_id"], b["text"]):
                w = words(text)
                if len(w) < n:
                    continue
                ids = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
                g = grams(ids, n)
                g = g[g != 0]
                if len(g):
                    at = np.searchsorted(known, g)
                    hit = np.unique(g[known[np.minimum(at, len(known) - 1)] == g])
                    if len(hit):
                        docs.append(doc)
                        texts.append(ids.astype(np.int32))
                        found.append(hit)
            if docs:
                yield pd.DataFrame({"doc_id": docs, "ids": texts, "grams": found})

    return run


def windows(p: np.ndarray, t: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches of t that a passage p can lie in: around every n-gram both hold, as long as p on its diagonal and SLACK of p's length more at each side; overlapping ones are one."""
    gp, gt = grams(p, n), grams(t, n)
    at = np.flatnonzero(np.isin(gt, gp[gp != 0]) & (gt != 0))
    if not len(at):
        return []
    slack = int(len(p) * SLACK) + n
    order = np.argsort(gp, kind="stable")
    lo, hi = np.searchsorted(gp[order], gt[at], "left"), np.searchsorted(gp[order], gt[at], "right")
    places = np.repeat(at, hi - lo) - order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])]  # where the passage's first word would be
    out: list[tuple[int, int]] = []
    for first in np.unique(places):
        a, b = max(0, int(first) - slack), min(len(t), int(first) + len(p) + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _score(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [np.asarray(x, np.int64) for x in b["passage"]]
            jobs = [(i, p[i], np.asarray(t, np.int64)[a:z]) for i, t in enumerate(b["ids"]) for a, z in windows(p[i], np.asarray(t, np.int64), n)]
            jobs.sort(key=lambda j: (len(j[2]), len(j[1])))
            score, longest = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            i = 0
            while i < len(jobs):
                size = max(1, min(256, CELLS // (len(jobs[min(i + 255, len(jobs) - 1)][2]) + 1)))
                part = jobs[i : i + size]
                s, r = aligned([(x, y) for _, x, y in part])
                at = np.array([j for j, _, _ in part])
                np.maximum.at(score, at, s)
                np.maximum.at(longest, at, r)
                i += size
            yield pd.DataFrame({"doc_id": b["doc_id"], "item_id": b["item_id"], "n_words": [len(x) for x in p], "longest_run": longest, "score": [s / (MATCH * len(x)) for s, x in zip(score, p)]})

    return run


def _item_blocks(items: DataFrame, most: int) -> Iterator[list]:
    """The passages in blocks of at most about `most` characters."""
    total = items.agg(F.sum(F.char_length("passage"))).first()[0] or 0
    n = -(-total // most)
    for i in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()


def leaks(documents: DataFrame, items: DataFrame, *, n: int = 5, run: int = 20, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, longest_run, score) for documents and items joined by a seed.

    documents: doc_id, text. items: item_id, passage. Other columns are
    ignored. score: Smith-Waterman score over the passage's own (1: the whole
    passage is there), around the n-grams both hold. longest_run: words in the
    longest stretch both share; complete for stretches of `run` or more. Null
    and empty texts, and passages under n words, share nothing. Repeated rows
    give one row a pair.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("text is not null and doc_id is not null")
    its = items.select("item_id", "passage").where("passage is not null and item_id is not null")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # alignment is work by pairs, not by bytes
    out = None
    for block in _item_blocks(its, item_chars):
        vocabulary: dict[str, int] = {}
        passages = {r["item_id"]: np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(r["passage"])], np.int64) for r in sorted(block, key=lambda r: (len(r["passage"]), r["passage"]))}  # of several passages of an item, the longest
        each = {i: grams(p, n) for i, p in passages.items() if len(p) >= n}
        if not each:
            continue
        known = np.unique(np.concatenate(list(each.values())))
        places = spark.createDataFrame(pd.DataFrame({"item_id": np.repeat(list(each), [len(g) for g in each.values()]), "pos": np.concatenate([np.arange(len(g)) for g in each.values()]), "gram": np.concatenate(list(each.values()))}))
        text = spark.createDataFrame(pd.DataFrame({"item_id": list(each), "passage": [passages[i].tolist() for i in each]}), "item_id bigint, passage array<int>")
        shared = spark.sparkContext.broadcast((vocabulary, known))
        hits = cut(docs.mapInPandas(_find(shared, n), "doc_id bigint, ids array<int>, grams array<bigint>"))
        in_docs = hits.select("doc_id", F.explode("grams").alias("gram"))
        counted = places.join(in_docs.groupBy("gram").agg(F.count_distinct("doc_id").alias("n_docs")), "gram", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        order = Window.partitionBy("item_id").orderBy("pos")  # one passage
        ahead, behind = order.rowsBetween(0, run - n), order.rowsBetween(n - run, 0)  # the n-grams of one run of words from here, and the runs that hold this n-gram
        last = F.max("pos").over(Window.partitionBy("item_id"))
        whole = (F.col("pos") + run - n <= F.col("last")) | (F.col("pos") == 0)
        rarest = counted.withColumn("last", last).withColumn("least", F.when(whole, F.min(F.when(F.col("n_docs") > 0, F.col("n_docs"))).over(ahead)))  # n-grams that no document holds say nothing of those that one does
        seeds = rarest.withColumn("bar", F.max("least").over(behind)).where((F.col("n_docs") > 0) & ((F.col("n_docs") <= FEW) | (F.col("n_docs") <= RARE * F.col("bar")))).select("item_id", "gram").distinct()
        pairs = in_docs.join(seeds, "gram").select("doc_id", "item_id").distinct()
        held = hits.select("doc_id", "ids").dropDuplicates(["doc_id"])
        scored = pairs.join(shuffled(held), "doc_id").join(text, "item_id")
        got = scored.select("doc_id", "item_id", "ids", "passage").repartition(spread, "doc_id", "item_id").mapInPandas(_score(n), "doc_id bigint, item_id bigint, n_words int, longest_run int, score double")
        out = got if out is None else out.union(got)
    return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_words int, longest_run int, score double") if out is None else out
