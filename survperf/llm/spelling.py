"""Groups of spelling variants: words one edit apart, each pointing to the far more frequent one.

``word_counts`` counts the words of whole texts, ``variants`` links the words of a vocabulary.

Defined cases: a null or empty text has no words, and an empty table gives an empty result; a null id counts as '';
repeated rows count again; ties of a word's best neighbour go to the smallest word in code-point order; only the named
columns are read, so others cannot clash.

Plan: one Python pass counts the runs of each text and adds up those of many texts before they are shuffled. Words are
numbered by falling count and rising code points in a range shuffle, so that the smaller of two numbers is the better word and rows
carry numbers only. A word of L letters is shuffled under 2 L + 1 keys at most: its L wildcard keys (everything but
the letter at a position), its distinct deletions, and itself. Words under one wildcard key differ by a replacement,
and such a group, no larger than the alphabet, gives each member its size less one and the better of its top two. A
word that is another one's deletion meets it under its own key. No pair is made of two words in a group. Keys are 124
bits of polynomial sums modulo four primes, worked out for whole batches in time proportional to their letters, so a very long word costs
no more than its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survperf.llm.common import cut, small_batches, take_worker

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Code points of a word, and its occurrences, at least.
LETTERS, TIMES = 5, 3
#: A form has so many times the occurrences of its variant, at least.
RATIO = 2
#: Code points of a text that are split at a time, and of counted words that a task holds.
PIECE, HELD = 1 << 20, 1 << 22
#: Primes and the multipliers of their sums, any numbers below them.
PRIMES = ((2147483647, 1103515245), (2147483629, 1220703125), (2147483587, 1664525005), (2147483579, 1812433253))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces that cut no run."""
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + size)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


def lowered_runs(text: str) -> Counter:
    """How often a text has each run, A-Z in lower case."""
    raw: Counter = Counter()
    for piece in pieces(text):
        raw.update(RUN.findall(piece))
    out: Counter = Counter()
    for run, n in raw.items():
        out[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    return out


def table_of(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": np.array([*counts, None], object)[:-1], "n": np.fromiter(counts.values(), np.int64, len(counts))})


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int | None = None, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n) of all words with so many letters and occurrences.

    With ``misspell``, a run loses a letter wherever it divides h, the crc32 of '<id>:<run>': the one at place h modulo its length.
    """
    small_batches(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("spelling")
        held: Counter = Counter()
        size = 0
        for b in batches:
            for doc, text in zip(b["id"], b["text"], strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in lowered_runs(text).items():
                    if misspell and (h := zlib.crc32(word.encode(), seed)) % misspell == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= letters:
                        size += 0 if word in held else len(word)
                        held[word] += n
                if size > HELD:
                    yield table_of(held)
                    held.clear()
                    size = 0
        yield table_of(held)

    rows = df.filter(F.length(text_col) > 0).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo ``prime``."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * pow(base, len(out), prime) % prime))
    return out[:n]


def edit_keys(numbers: np.ndarray, words: list[str]) -> pd.DataFrame:
    """(kind, hi, lo, at) of the words: kind 0 are wildcards; kind 1 distinct deletions, and the word itself, with its number's complement."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    own = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - first[own]
    whole, blank, less = [], [], []
    for prime, base in PRIMES:
        term = code * powers(base, prime, int(size.max(initial=1)))[place] % prime
        upto = np.concatenate(([0], np.cumsum(term)))
        total = (upto[first + size] - upto[first]) % prime
        before = (upto[:-1] - upto[first[own]]) % prime
        rest = (total[own] - before - term) % prime
        whole.append(total)
        blank.append((total[own] - term) % prime)
        less.append((before + rest * pow(base, -1, prime)) % prime)
    # a run of one letter has one deletion
    new = np.concatenate(([True], code[1:] != code[:-1])) | (place == 0) if len(code) else np.zeros(0, bool)
    join = lambda parts, which: (parts[0][which] << 31 | parts[1][which], parts[2][which] << 31 | parts[3][which])
    every = slice(None)
    blocks = [(0, *join(blank, every), numbers[own]), (1, *join(less, new), numbers[own[new]]), (1, *join(whole, every), ~numbers)]
    return pd.DataFrame({"kind": np.concatenate([np.full(len(b[1]), b[0], np.int32) for b in blocks]), **{c: np.concatenate([b[i] for b in blocks]) for i, c in ((1, "hi"), (2, "lo"), (3, "at"))}})


def neighbours(words: DataFrame) -> DataFrame:
    """(at, n_near, best) of the numbered ``words`` (at, word) that have a word one edit away: how many, and the smallest of their numbers."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("spelling")
        for b in batches:
            yield edit_keys(b["at"].to_numpy(np.int64), b["word"].tolist())

    keyed = words.select("at", "word").mapInPandas(keys, "kind int, hi long, lo long, at long")
    groups = keyed.groupBy("kind", "hi", "lo").agg(F.sort_array(F.collect_list("at")).alias("m")).filter(F.size("m") > 1)
    m, k = F.col("m"), F.size("m").cast("long") - 1
    row = lambda at, near, best: F.struct(at.alias("at"), near.alias("near"), best.alias("best"))
    replaced = F.transform(m, lambda x: row(x, k, F.when(x == m[0], m[1]).otherwise(m[0])))
    longer = F.slice(m, F.lit(2), F.size(m) - 1)
    changed = F.concat(F.array(row(F.bitwise_not(m[0]), k, m[1])), F.transform(longer, lambda x: row(x, F.lit(1).cast("long"), F.bitwise_not(m[0]))))
    each = groups.select(F.explode(F.when(F.col("kind") == 0, replaced).when(m[0] < 0, changed)).alias("x")).select("x.*")
    return each.groupBy("at").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(at, root) of ``links`` (at, up): where the links from ``at`` end. Each round doubles the reach."""
    now = cut(links.select("at", F.col("up").alias("root"), F.lit(True).alias("moved")))
    while not now.filter("moved").isEmpty():
        up = now.select(F.col("at").alias("via"), F.col("root").alias("next"))
        now = cut(now.join(up, F.col("root") == F.col("via"), "left").select("at", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("at", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counts`` (word, n), whose words are distinct."""
    order = [F.desc("n"), F.asc("word")]
    words = cut(cut(counts).repartitionByRange(*order).sortWithinPartitions(*order).select("word", "n", F.monotonically_increasing_id().alias("at")))
    near = neighbours(words)
    best = words.select(F.col("at").alias("best"), F.col("n").alias("best_n"))
    linked = words.select("at", "n").join(near, "at").join(best, "best")
    linked = cut(linked.select("at", "n_near", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("up")))
    ends = roots(linked.filter("up is not null").select("at", "up"))
    form = words.select(F.col("at").alias("up"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = words.select(F.col("at").alias("root_at"), F.col("word").alias("root"))
    named = linked.join(form, "up", "left").join(ends.withColumnRenamed("root", "root_at"), "at", "left").join(last, "root_at", "left").select("at", "n_near", "form", "form_n", "root")
    return words.join(named, "at", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
