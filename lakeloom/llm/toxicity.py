"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are lower-cased, homoglyphs and digit substitutions are folded to letters, zero-width
characters are removed, and the words (runs of letters) are joined by single spaces. Lexicon entries
are whole words and word beginnings, weighted by their log-odds; one automaton finds all of them.
A hit inside an exception phrase does not count. The weights of the hits, as a sum and per 100
words, give the score through a logistic curve.

Lexicon, exceptions and curve are learned from labelled rows whose crc32(doc_id) mod 3 is not 1, at
most ``FIT_ROWS`` of them (those with the smallest hash of doc_id): two thirds of them give lexicon
and exceptions, the rest the curve. Scoring covers all rows and whole texts. Only text is an input.

Defined results. Null, empty and wordless texts have no hits and get the score of a text without
hits. Without a label of both kinds, every score is 0. Repeated rows are scored alike; a null
doc_id is not held out. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, shipped, stored, unmasked

#: Bound of the labelled rows that are fitted on.
FIT_ROWS = 24_000
MIN_DOCS = 3
PRECISION = 0.85
PREFIXES = range(4, 9)
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and digits used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v",
    "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ⅼ": "l", "ɡ": "g", "ſ": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | dict.fromkeys(ZERO_WIDTH, ""))
_WORD = re.compile(r"[^\W\d_]+")


def folded_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower().translate(_FOLD))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Matcher:
    """Aho-Corasick over lexicon entries and exception phrases. An entry that starts with a blank
    and ends without one is a word beginning."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, float]:
        """Start of each hit word in the joined text -> its greatest weight."""
        if not (self.any and words):
            return {}
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is not None:
                found[start] = max(weight, found.get(start, 0.0))
            else:
                while free and free[-1][0] >= start:
                    free.pop()  # the phrase found last starts before these and ends after them
                if not free or free[-1][1] < end:
                    free.append((start, end))
        if not free:
            return found
        # starts and ends of what is left both rise: the last phrase that starts at or before a hit ends last
        starts = [a for a, _ in free]
        return {at: w for at, w in found.items() if not ((k := bisect_right(starts, at)) and at < free[k - 1][1])}

    def features(self, text: str | None) -> tuple[float, float, float]:
        words = folded_words(text)
        total = sum(self.hits(words).values())
        return float(total > 0), math.log1p(total), math.log1p(100 * total / max(len(words), 1))


def fit_rows(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most ``bound`` labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # the documented bound of the fit
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(3)).cast("int"))


def _document_counts(rows: DataFrame, entries) -> DataFrame:
    """(entry, toxic, n): number of documents of each kind that hold an entry."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                counts.update((e, int(toxic)) for e in entries(folded_words(text)))
            if len(counts) > 500_000:
                yield pd.DataFrame([(e, t, n) for (e, t), n in counts.items()], columns=["entry", "toxic", "n"])
                counts.clear()
        yield pd.DataFrame([(e, t, n) for (e, t), n in counts.items()], columns=["entry", "toxic", "n"])

    found = shipped(rows).select("text", "toxic").mapInPandas(batches, "entry string, toxic int, n bigint")
    return found.groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("f"))


def _word_entries(words: list[str]) -> set[str]:
    distinct = set(words)
    return {f" {w} " for w in distinct} | {f" {w[:k]}" for w in distinct for k in PREFIXES if len(w) >= k}


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entry -> weight, of every entry that the rows of the fit bear out."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    if not (n_toxic and n_other):
        return {}
    counted = _document_counts(rows, _word_entries).where((F.col("t") >= MIN_DOCS) & (F.col("t") >= PRECISION * (F.col("t") + F.col("f"))))
    best = counted.orderBy("entry").collect()  # entries of the rows of the fit, which are bounded
    return {r["entry"]: math.log((r["t"] + 0.5) / (n_toxic + 1)) - math.log((r["f"] + 0.5) / (n_other + 1)) for r in best}


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """Two-word phrases around a lexicon word that are mostly found in rows that are not toxic."""
    matcher = Matcher(lexicon)

    def phrases(words: list[str]) -> set[str]:
        hits = matcher.hits(words)
        found, at = set(), 0
        for k, w in enumerate(words):
            if at in hits:
                if k:
                    found.add(f" {words[k - 1]} {w} ")
                if k + 1 < len(words):
                    found.add(f" {w} {words[k + 1]} ")
            at += len(w) + 1
        return found

    counted = _document_counts(rows, phrases).where((F.col("f") >= MIN_DOCS) & (F.col("t") <= 0.2 * (F.col("t") + F.col("f"))))
    return [r["entry"] for r in counted.orderBy("entry").collect()]  # as bounded as the rows of the fit


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps; intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


class Model:
    def __init__(self, lexicon: dict[str, float], exceptions: list[str], curve: list[float] | None):
        self.lexicon, self.exceptions, self.curve = lexicon, exceptions, curve

    def scorer(self):
        matcher, curve = Matcher(self.lexicon, self.exceptions), self.curve

        def score(text: str | None) -> float:
            if curve is None:
                return 0.0
            z = curve[0] + sum(c * v for c, v in zip(curve[1:], matcher.features(text), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    rows = stored(fit_rows(docs, labels, bound))
    learn, rest = rows.where("fold > 0"), rows.where("fold = 0")
    lexicon = learn_lexicon(learn)
    if not lexicon:
        return Model({}, [], None)
    exceptions = learn_exceptions(learn, lexicon)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon, exceptions)
        for frame in frames:
            found = pd.DataFrame([matcher.features(t) for t in frame["text"]], columns=["a", "b", "c"])
            yield found.assign(toxic=frame["toxic"].to_numpy())

    seen = shipped(rest).select("text", "toxic").mapInPandas(batches, "a double, b double, c double, toxic int").toPandas()  # within the bound
    if seen["toxic"].nunique() < 2:
        return Model({}, [], None)
    seen = seen.sort_values(["a", "b", "c", "toxic"])
    return Model(lexicon, exceptions, fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy(float)))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [score(t) for t in frame["text"]]})

    rows = masked(shipped(docs).select("doc_id", "text"), "doc_id")
    found = rows.mapInPandas(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return unmasked(found, "doc_id", docs.schema["doc_id"].dataType)
