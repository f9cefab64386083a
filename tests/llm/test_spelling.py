"""Spelling variants against all pairs of words, with the odd cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from survperf.llm import queries as Q
from survperf.llm import spelling

DOC = "doc_id long, text string"


def counts_of(rows, misspell=97):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if misspell and h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert plain(Q.op12_spelling(spark, sf)) == brute(counts_of(rows))


def test_variants_of_a_dense_vocabulary(spark):
    r = random.Random(3)
    counts = {}
    while len(counts) < 900:
        counts["".join(r.choice("aabé") for _ in range(r.choice([5, 6, 6, 7])))] = r.choice([3, 3, 4, 6, 8, 16, 40, 200])
    for w in ("aaaaa" + "x" * 3000, "aaaaa" + "x" * 2999, "aaaaa" + "x" * 2999 + "y"):
        counts[w] = 3 if w[-1] == "y" else 9
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert plain(spelling.variants(df)) == brute(counts)


def test_chains_of_forms(spark):
    words = ["abcdefgh"[: 5 + i] for i in range(4)]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    got = plain(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and {t[2] for t in got} == {"abcdefgh"}


def test_odd_texts(spark):
    long = "Zwölftausend " * 30_000 + "x" * 70_000
    rows = [(1, None), (2, ""), (None, "Hello hello HELLO École École École école"), (3, "hallo, hallo; hallo"), (3, "hallo, hallo; hallo"), (4, long), (5, "××××× " * 3), (6, "no word 1 2 3"), (7, "\U0001f600abcde\U0001f600abcde abcde")]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("word", "n", "at", "form", "root", "hi", "lo", "id")})
    assert plain(spelling.variants(spelling.word_counts(df, misspell=97))) == brute(counts_of(rows))
    assert plain(spelling.variants(spelling.word_counts(df.limit(0)))) == []


def test_pieces_cut_no_run():
    text = "abc, déf ghi" * 40 + "z" * 50
    for size in (1, 2, 7, 64):
        assert "".join(spelling.pieces(text, size)) == text
        assert Counter(w for p in spelling.pieces(text, size) for w in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(text))


def test_keys_of_a_word():
    keys = spelling.edit_keys(np.array([5, 9]), ["aabca", "abca"])
    both = keys[keys["kind"] == 1].groupby(["hi", "lo"])["at"].apply(set)
    assert {5, ~9} in list(both) and len(keys[keys["kind"] == 0]) == 9 and sum(keys["at"] < 0) == 2
