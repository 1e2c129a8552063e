"""Reading level of each document (problem 9).

A linear ranker over features of syntax and vocabulary learns, from pairs of
graded documents, which of two asks for more schooling; isotonic regression then
turns its scores into years. The grades of the fitting sample are the median of
five published readability formulas. Texts go through Python in batches: what
is known of a word is kept, so that a text costs one pass for its words and a
look-up for each different one. (The same counts as patterns in the JVM took
ten times the CPU, since every pattern walks the text again.)
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the fitting sample at most, and pairs drawn from it.
FIT_DOCS, FIT_PAIRS = 4_000, 20_000
#: Lines that are no prose. Headings, list items, table rows, rules, log lines, lines with code in them, JSON, assignments, statements, indented code.
_NO_PROSE = re.compile(r"[ \t]*(?:#{1,6}[ \t]|[-*+•][ \t]|\(?\d{1,3}[.)][ \t]|\||={3,}|-{3,}|\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d|[{}\[\]<])| {4}|\t")
_CODE = re.compile(r"`[^`]+`")
_ASSIGNMENT = re.compile(r"[ \t]*\S{1,200}[ \t]*[=:]=?[ \t]*\S{1,200}[;,]?$")
_STATEMENT = re.compile(r"[ \t]*(?:def|class|import|from|return|if|for|while|SELECT|INSERT)\b")
_WORD = re.compile(r"[A-Za-z][A-Za-z'’]*")
_SENTENCE = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|\Z)")
_VOWELS = re.compile(r"[aeiouy]+")
_NOUN = re.compile(r"(?:tion|sion|ment|ness|ity|ance|ence|ism|ship|ology)s?$")
#: Words that begin clauses.
_LINKS = frozenset("that which who whom whose because although though while whereas if unless until since insofar notwithstanding provided assuming thereby particularly".split())


def prose(text: str) -> str:
    """Running prose: the text without fenced code and without lines that are headings, list items, logs or code; marks of quoted lines are taken off."""
    out, fence = [], None
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.lstrip(" \t")
        if fence:
            fence = None if s.startswith(fence) else fence
        elif s.startswith(("```", "~~~")):
            fence = s[:3]
        elif s and not (_NO_PROSE.match(line) or ("`" in line and _CODE.search(line)) or (line[-1] in ":;)" and _STATEMENT.match(line)) or (("=" in line or ":" in line) and _ASSIGNMENT.match(line))):
            out.append(s.lstrip("> \t") if s[0] == ">" else s)
    return "\n".join(out)


def _word(word: str) -> tuple[int, ...]:
    """Letters, syllables, whether a word is long (three syllables), has seven letters, begins a clause, is an abstract noun; and 1."""
    w = word.lower().replace("’", "'")
    letters = len(w) - w.count("'")
    syllables = len(_VOWELS.findall(w))
    if syllables > 1 and w[-1] == "e" and w[-2] not in "aeiouyl":
        syllables -= 1
    syllables = max(1, syllables)
    return letters, syllables, int(syllables >= 3), int(letters >= 7), int(w in _LINKS), int(bool(_NOUN.search(w))), 1


def counts(texts: Iterable[str | None]) -> dict[str, np.ndarray]:
    """Countable parts of the English prose of each text; zeros where there is none. A run of over 60 letters is no word."""
    known: dict[str, int] = {}
    table: list[tuple] = [(0,) * 7]
    ids: list[int] = []
    times: list[int] = []
    owner = np.zeros(len(texts), int)
    rows = np.zeros((len(_COUNTS), len(texts)))
    for i, text in enumerate(texts):
        if not text:
            continue
        p = prose(text)
        found = Counter(_WORD.findall(p))
        for word in found:
            if word not in known:
                known[word] = len(table)
                table.append(_word(word) if len(word) <= 60 else (0,) * 7)
        ids += [known[w] for w in found]
        times += found.values()
        owner[i] = len(found)
        # what is left over after the last mark counts as a sentence where there is no other
        rows[1, i] = max(1, len(_SENTENCE.findall(p)))
        rows[8, i] = p.count(",") + p.count(";") + p.count(":")
    at = np.repeat(np.arange(len(texts)), owner)
    each = np.array(table)[ids] * np.array(times, int)[:, None] if ids else np.zeros((0, 7))
    for j, row in enumerate((2, 3, 4, 5, 6, 7, 0)):
        rows[row] = np.bincount(at, each[:, j], minlength=len(texts))
    rows[:, rows[0] == 0] = 0
    return dict(zip(_COUNTS, rows))


_COUNTS = ["n_words", "n_sentences", "n_letters", "n_syllables", "n_long", "n_six", "n_links", "n_nouns", "n_commas"]
FEATURES = ["log_sentence", "sentence", "syllables", "letters", "long", "six", "links", "nouns", "commas"]


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Features (documents x FEATURES) per word or sentence, from counts."""
    words, sentences = np.maximum(c["n_words"], 1.0), np.maximum(c["n_sentences"], 1.0)
    return np.stack(
        [
            np.log1p(words / sentences), words / sentences / 10, c["n_syllables"] / words, c["n_letters"] / words / 3,
            c["n_long"] / words * 3, c["n_six"] / words * 3, c["n_links"] / sentences, c["n_nouns"] / words * 5, c["n_commas"] / sentences,
        ], 1,
    )


def formula_grades(c: dict) -> np.ndarray:
    """Years of schooling: the median of five published formulas (Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau, automated readability index)."""
    w, s = np.maximum(c["n_words"], 1), c["n_sentences"]
    every = [
        0.39 * w / s + 11.8 * c["n_syllables"] / w - 15.59,
        0.4 * (w / s + 100 * c["n_long"] / w),
        1.0430 * np.sqrt(c["n_long"] * 30 / s) + 3.1291,
        0.0588 * (100 * c["n_letters"] / w) - 0.296 * (100 * s / w) - 15.8,
        4.71 * c["n_letters"] / w + 0.5 * w / s - 21.43,
    ]
    return np.median(np.stack(every), 0)


@dataclass
class Ranker:
    """Weights of the linear ranker and the calibration's knots (score, grade), both rising."""

    weights: np.ndarray
    knots: list[tuple[float, float]]
    held_out: float

    def score(self, c: dict[str, np.ndarray]) -> np.ndarray:
        return features(c) @ self.weights

    def grade(self, score: np.ndarray) -> np.ndarray:
        """Linear between knots, level beyond the ends."""
        return np.interp(score, [k[0] for k in self.knots], [k[1] for k in self.knots])


def isotonic(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Pool-adjacent-violators fit of y on x, as at most 64 rising knots."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean grade, weight, sum of scores
    for i in order:
        blocks.append([float(y[i]), 1.0, float(x[i])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    knots = [(b[2] / b[1], b[0]) for b in blocks]
    if len(knots) > 64:
        knots = [knots[i] for i in np.unique(np.linspace(0, len(knots) - 1, 64).astype(int))]
    out = [knots[0]]
    for k in knots[1:]:
        if k[0] > out[-1][0]:
            out.append(k)
    return out


def fit(c: dict[str, np.ndarray], *, pairs: int = FIT_PAIRS, seed: int = 5) -> Ranker:
    """Ranker from counts of graded documents: logistic loss on differences of pairs at least half a grade apart.

    A fifth of the documents is held out; held_out is the share of their pairs
    that the ranker puts in the right order.
    """
    rng = np.random.default_rng(seed)
    x = features(c)
    y = formula_grades(c)
    test = rng.random(len(y)) < 0.2

    def draw(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = (rng.choice(at, n) for _ in range(2))
        ok = y[i] > y[j] + 0.5
        return x[i[ok]] - x[j[ok]], ok

    d, _ = draw(np.flatnonzero(~test) if (~test).any() else np.arange(len(y)), 2 * pairs)
    w = np.zeros(x.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30))) if len(d) else np.zeros(0)
        w += 0.5 * ((d.T @ p) / max(1, len(d)) - 0.001 * w)
        w = np.maximum(w, 0)  # every feature makes a text harder, never easier
    t, _ = draw(np.flatnonzero(test) if test.sum() > 1 else np.arange(len(y)), pairs)
    return Ranker(w, isotonic(x @ w, y), float((t @ w > 0).mean()) if len(t) else float("nan"))


#: Graded texts that are always in the fitting sample, so that the scale spans all levels: (words a sentence, syllables, letters, long words, ... a word).
_LADDER = [(5 + 1.3 * g, 1.05 + 0.055 * g, 3.4 + 0.12 * g, 0.012 * g) for g in range(1, 24)]


def ladder() -> dict[str, np.ndarray]:
    """Counts of made-up texts of 200 words that climb evenly from the first year to the last."""
    rows = np.array(_LADDER)
    words = np.full(len(rows), 200.0)
    sentences = words / rows[:, 0]
    long = words * rows[:, 3]
    return {"n_words": words, "n_sentences": sentences, "n_letters": words * rows[:, 2], "n_syllables": words * rows[:, 1], "n_long": long, "n_six": long * 1.5, "n_links": sentences * rows[:, 0] / 20, "n_nouns": long / 3, "n_commas": sentences * rows[:, 0] / 15}


def fit_on(documents: DataFrame, *, fit_docs: int = FIT_DOCS) -> Ranker:
    """Ranker fitted on at most fit_docs documents, chosen by a hash of doc_id, and on the ladder."""
    n = documents.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, fit_docs / max(n, 1))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(counts(b["text"].tolist()))

    got = documents.where(share).select("text").mapInPandas(read, ", ".join(f"{k} double" for k in _COUNTS)).where("n_words >= 20").limit(2 * fit_docs).toPandas()
    rungs = ladder()
    return fit({k: np.concatenate([got[k].to_numpy(float), rungs[k]]) for k in _COUNTS})


def reading_levels(documents: DataFrame, *, ranker: Ranker | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, lang, n_words, score, grade) for every document.

    documents: doc_id, text, lang; other columns are ignored. grade: years of
    schooling (US grades) that the running prose asks for, by its English
    features; null for texts in other languages (lang not 'en') and for texts
    without a word of prose, null texts included. Repeated rows stay repeated.
    """
    english = documents.where((F.col("lang") == "en") & F.col("text").isNotNull())
    ranker = fit_on(english, fit_docs=fit_docs) if ranker is None else ranker

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = counts(b["text"].tolist())
            some = c["n_words"] > 0
            score = ranker.score(c)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "n_words": c["n_words"].astype(int), "score": pd.Series(score).where(some).astype("Float64"), "grade": pd.Series(ranker.grade(score)).where(some).astype("Float64")})

    english_text = F.when(F.col("lang") == "en", F.col("text")).alias("text")  # other texts need not travel
    return documents.select("doc_id", "lang", english_text).mapInPandas(judge, "doc_id bigint, lang string, n_words bigint, score double, grade double")
