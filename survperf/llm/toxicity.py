"""Toxicity from a weighted lexicon matched by Aho-Corasick on folded texts.

Folding lower-cases, maps look-alike letters of other scripts and digits written for letters,
so that disguised words match. A lexicon entry is a whole word ("=word") or a stem that starts
words; an exception phrase that covers a match cancels it. A text's score is a logistic
function of the sum of the matched weights, normalised by its length in two ways: over a slowly
growing function of the words, and for each hundred words.

``fit`` starts from a short public list and learns weights (log-odds of an entry among the words of
toxic and of other texts) of words and stems of at most ``sample`` labelled documents of each
class. Entries may occur in other texts by chance: what counts is how much is matched. Counting is
done where the rows are; what reaches the driver is the entries that pass the bounds, which that many
documents can support.

Defined cases: a null or empty text has no match and the score of none; without labels of both
classes the list's own weights hold. ``with_toxicity`` keeps all columns and replaces its own names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survperf.llm.common import cut, small_batches
from survperf.llm.quality import labelled_sample

SAMPLE = 4000
STEM = range(4, 11)
#: Least log-odds of a learned entry, and the least log likelihood ratio of the split of its documents
#: against chance, above the log of the entries tried.
ODDS, SURPRISE = 2.5, 16.0
#: Occurrences added on either side, so that few of them weigh little; the largest weight.
ADDED, HEAVIEST = (1.0, 3.0), 6.0
#: A longer entry stays beside a stem that starts it if it weighs so much more.
HEAVIER = 0.7
#: Words a match counts against.
PER_WORDS = 400.0

#: Common English insults and phrases in which they are none.
LEXICON = {w: 2.0 for w in ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "bitch", "asshole", "jerk", "retard", "freak", "vermin", "filth", "dimwit", "crap", "shit", "fuck", "slut", "whore", "cretin", "halfwit")}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "class clown", "circus clown", "good loser", "pond scum", "soap scum", "stupid question", "control freak")

#: Letters of other scripts that look like Latin ones.
_LOOKS = dict(zip("аеорсухіјѕԁһкмтвнβαοερκντιυ", "aeopcyxijsdhkmtbhbaoepkvtiu", strict=True))
_LOOKS |= {"ı": "i", "ℓ": "l", "ɑ": "a", "ɡ": "g"}
_OTHER = re.compile("[" + "".join(_LOOKS) + "℀-⅏＀-￯\U0001d400-\U0001d7ff​-‍­]")
_HIDDEN = re.compile("[​-‍­]")
_TABLE = str.maketrans(_LOOKS)
#: Digits and marks written for letters.
_DIGITS = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"[013457@$]+(?=[^\W\d_])")
_ENDING = re.compile(r"(?<=[^\W\d_])[013457@$]+(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """``text`` in lower case, without look-alikes and digits before letters; those at a word's end stay."""
    low = text.lower()
    if not low.isascii() and _OTHER.search(low):
        low = _HIDDEN.sub("", unicodedata.normalize("NFKC", low)).lower().translate(_TABLE)
    return _MIXED.sub(lambda m: m[0].translate(_DIGITS), low)


def fold_endings(low: str) -> str:
    """Folded text with the digits at the ends of words read as letters too; of the same length."""
    return _ENDING.sub(lambda m: m[0].translate(_DIGITS), low)


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=lambda: {"=" + w: x for w, x in LEXICON.items()})
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 0.5)

    def score(self, strengths: list[tuple[float, float]]) -> np.ndarray:
        b, x = self.coefficients, np.array(strengths, float).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(b[0] + x @ np.array(b[1:]), -60, 60)))

    def automaton(self) -> ahocorasick.Automaton:
        """Each word with what it stands for: a stem, a whole word, an exception, or several of them."""
        held: dict[str, list[tuple[int, float | None, bool]]] = {}
        for entry, weight in self.entries.items():
            word = entry.lstrip("=")
            held.setdefault(word, []).append((len(word), weight, entry[0] == "="))
        for phrase in self.exceptions:
            held.setdefault(phrase, []).append((len(phrase), None, True))
        auto = ahocorasick.Automaton()
        for word, meant in held.items():
            auto.add_word(word, meant)
        auto.make_automaton()
        return auto


def matches(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the longest entry at each word start of folded ``text``, the heavier of equal ones, less exceptions.

    Digits at a word's end are read both as they are and as letters.
    """
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    ended = fold_endings(text)
    for read in (text,) if ended == text else (text, ended):
        for last, (n, weight, whole) in ((last, m) for last, meant in auto.iter(read) for m in meant):
            start, end = last - n + 1, last + 1
            if start and read[start - 1].isalpha() or whole and end < len(read) and read[end].isalpha():
                continue
            if weight is None:
                spared.append((start, end))
            elif start not in found or found[start] < (end, weight):
                found[start] = (end, weight)
    spared.sort()
    ends = list(accumulate((y for _, y in spared), max))
    covered = lambda a, b: bool(spared) and (i := bisect_right(spared, (a, len(text)))) > 0 and ends[i - 1] >= b
    return [(a, b, w) for a, (b, w) in sorted(found.items()) if not covered(a, b)]


def strength(text: str, auto: ahocorasick.Automaton) -> tuple[float, float, int]:
    """Matched weight by a slowly growing function of the words, the log of that for each hundred words, and the matches."""
    low = fold(text or "")
    hits = matches(low, auto)
    if not hits:
        return 0.0, 0.0, 0
    words, total = 1 + low.count(" ") + low.count("\n"), sum(w for _, _, w in hits)
    return total / (1 + math.log1p(words / PER_WORDS)), math.log1p(100 * total / (words + 20)), len(hits)


def entry_counts(text: str) -> Counter[str]:
    """How often each entry that a text supports starts, or is, one of its folded words; '' counts all words."""
    words = Counter(_WORD.findall(fold(text or "")))
    names: Counter[str] = Counter()
    for w, n in words.items():
        names[""] += n
        names["=" + w] += n
        for k in STEM:
            if k <= len(w):
                names[w[:k]] += n
    return names


def prune(entries: dict[str, float]) -> dict[str, float]:
    """Without entries that a stem in the lexicon starts, unless they weigh more."""
    kept: dict[str, float] = {}
    for e in sorted(entries, key=lambda e: (len(e.lstrip("=")), e[0] == "=")):
        word = e.lstrip("=")
        above = [kept[word[:k]] for k in range(1, len(word) + (e[0] == "=")) if word[:k] in kept]
        if not above or entries[e] > max(above) + HEAVIER:
            kept[e] = entries[e]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes by ridge Newton steps; slopes are not negative."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-3, *[1e-2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge
        b = b + np.linalg.solve(h, a.T @ (y - p) - ridge @ b)
        b = np.clip(b, -60, 60)
    if (b[1:] < 0).any() and x.shape[1] > 1:
        keep = np.flatnonzero(b[1:] >= 0)
        part = _logistic(x[:, keep[:1] if len(keep) else [0]], y)
        out = np.zeros(a.shape[1])
        out[0], out[1 + (keep[0] if len(keep) else 0)] = part
        return tuple(out.tolist())
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A lexicon with weights from a bounded sample of ``labels``."""
    small_batches(docs.sparkSession)
    rows = cut(labelled_sample(docs, labels, label_col, sample, id_col, text_col).select("id", "label", "text"))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model()
    toxic, clean = totals[1], totals[0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs_of, seen_of = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
        for b in batches:
            for label, text in zip(b["label"], b["text"], strict=True):
                found = entry_counts(text)
                docs_of[label].update(found.keys())
                seen_of[label].update(found)
        names = list(docs_of[1].keys() | docs_of[0].keys())
        yield pd.DataFrame({"entry": pd.Series(names, dtype=object), **{k: [c[n] for n in names] for k, c in (("t", docs_of[1]), ("c", docs_of[0]), ("to", seen_of[1]), ("co", seen_of[0]))}})

    counts = rows.mapInPandas(count, "entry string, t long, c long, to long, co long").groupBy("entry").agg(*[F.sum(k).alias(k) for k in ("t", "c", "to", "co")])
    counts = cut(counts.filter("t > 3 or entry = ''"))
    every = counts.filter("entry = ''").first()
    if every is None:
        return Model()
    share = toxic / (toxic + clean)
    own = F.col("t") / (F.col("t") + F.col("c"))
    surprise = F.col("t") * F.log(own / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - own) / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("to") + ADDED[0]) / every.to) - F.log((F.col("co") + ADDED[1]) / every.co)
    scored = counts.filter("entry <> ''").withColumn("w", F.least(odds, F.lit(HEAVIEST)))
    good = scored.filter((own > share) & (surprise >= SURPRISE) & (F.col("w") >= ODDS))
    learned = {r.entry: r.w for r in good.collect()}
    model = Model()
    poor = {r.entry for r in scored.filter(F.col("entry").isin(*model.entries) & (F.col("w") < ODDS)).collect()}
    model.entries = prune({e: w for e, w in model.entries.items() if e not in poor} | learned)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = model.automaton()
        for b in batches:
            got = [strength(t, auto) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["label"], "x": [g[0] for g in got], "z": [g[1] for g in got]})

    got = rows.mapInPandas(measure, "id string, y int, x double, z double").toPandas().sort_values("id", kind="stable")
    model.coefficients = _logistic(got[["x", "z"]].to_numpy(float), got["y"].to_numpy(float))
    return model


def with_toxicity(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", hits_col: str = "n_matches") -> DataFrame:
    """``df`` with the toxicity of its texts, 0 to 1, and the number of matches."""
    small_batches(df.sparkSession)

    @F.pandas_udf("score double, n int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = model.automaton()
        for texts in batches:
            got = [strength(t, auto) for t in texts]
            yield pd.DataFrame({"score": model.score([g[:2] for g in got]), "n": [g[2] for g in got]})

    # the input's columns stay inside a struct, so that none has a name of ours
    kept = [c for c in df.columns if c not in (out_col, hits_col)]
    rows = df.select(F.struct(*kept).alias("row"), score(F.col(text_col)).alias("found"))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], F.col("found.score").alias(out_col), F.col("found.n").alias(hits_col))
