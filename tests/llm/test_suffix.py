"""Repeated passages against all strings of all texts, and the merge against a sort."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from survperf.llm import queries as Q
from survperf.llm import suffix

DOC = "doc_id long, text string"


def brute(rows, n=suffix.LENGTH):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), sum(g and not p for p, g in zip(bytes([0, *gone[:-1]])[: len(gone)], gone, strict=True)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def found(df):
    return plain(suffix.remove(df, digest=True))


def planted(seed, many=60):
    """Random texts that share passages of many lengths, also inside one text, with edits and copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    pool = [prose(120)[: r.randint(190, 500)] for _ in range(12)]
    rows = []
    for i in range(many):
        parts = [prose(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, max(0, len(p) - 150))
            parts += [p[a : r.randint(a, len(p) + 50)], prose(r.randint(0, 8))]
        rows.append((i, " ".join(parts)))
    for i in range(many, many + 25):
        words = rows[r.randrange(20)][1].split(" ")
        words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(many + 25, rows[3][1]), (many + 26, "ab" * 700), (many + 27, "x" * 450), (many + 28, "y" * 200), (many + 29, "z" * 201)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, seed):
    rows = planted(seed)
    assert found(spark.createDataFrame(rows, DOC).repartition(5)) == brute(rows)


def test_many_small_runs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix, "RUN", 40)
    rows = planted(4)
    assert found(spark.createDataFrame(rows, DOC).repartition(7)) == brute(rows)


def test_one_passage_everywhere(spark):
    """A passage of just over a string's length in different surroundings, which only the bytes around a core tell apart."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(215))
    rows = [(i, "".join(r.choice("xyz") for _ in range(80)) + passage[r.randrange(12) : 215 - r.randrange(12)] + "".join(r.choice("uvw") for _ in range(80))) for i in range(150)]
    assert found(spark.createDataFrame(rows, DOC)) == brute(rows)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert plain(Q.op11_suffix(spark, sf)) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(5)
    long = "".join(r.choice("abc ") for _ in range(300_000))
    rows = [(1, None), (2, ""), (3, "short"), (None, "n" * 300), (None, "n" * 300), (4, "same " * 50), (4, "same " * 50), (5, long + "tail"), (6, "\0" * 260), (7, "é" * 150), (8, long[5:400]), (9, "w" * 100_000)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("id", "data", "k1", "h", "spans", "copies", "kept", "n_bytes", "part")})
    got = found(df)
    want = [w for w in brute([(i, t if i != 5 else long[:500]) for i, t in rows]) if w[0] != 5]
    assert [g for g in got if g[0] != 5] == want and (8, 395, 395) in [w[:3] for w in want]
    (big,) = [g for g in got if g[0] == 5]
    assert big[1:4] == (300_004, 395, 1)
    assert found(df.limit(0)) == []


def test_removal_gives_the_bytes(spark):
    r = random.Random(6)
    a, b, p = ("".join(r.choice("abcdef") for _ in range(300)) for _ in range(3))
    got = {x.id: bytes(x.kept) for x in suffix.remove(spark.createDataFrame([(1, a + p), (2, p + b)], DOC)).collect()}
    assert got == {1: a.encode(), 2: b.encode()}


def test_merge_equals_a_sort():
    r = random.Random(8)
    for many in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(r.choice(b"ab") if i > 4 else r.choice(b"a") for i in range(12)).ljust(suffix.WIDTH, b"c") for _ in range(r.randint(0, 30))) for _ in range(many)]
        coded = [[(s, suffix.common(s, run[i - 1], 0) if i else 0) for i, s in enumerate(run)] for run in runs]
        got = list(suffix.merge([iter(c) for c in coded]))
        assert [g[0] for g in got] == sorted(s for run in runs for s in run)
        assert [g[1] for g in got[1:]] == [suffix.common(x[0], y[0], 0) for x, y in zip(got, got[1:], strict=False)]


def test_anchors_of_pieces(monkeypatch):
    """Every string has one anchor, at a place that depends on nothing but the string."""
    r = random.Random(2)
    data = "".join(r.choice("abc") for _ in range(1500)).encode() + b"q" * 300
    whole = [x for a in suffix.anchors(data) for x in zip(*map(list, a), strict=True)]
    monkeypatch.setattr(suffix, "PIECE", 64)
    pieces = [x for a in suffix.anchors(data) for x in zip(*map(list, a), strict=True)]
    each = lambda found: {p: (h, at) for h, at, lo, hi in found for p in range(lo, hi + 1)}
    assert each(whole) == each(pieces) and sorted(each(whole)) == list(range(len(data) - suffix.LENGTH + 1))
    assert all(0 <= at - p <= suffix.LENGTH - suffix.GRAM for p, (_, at) in each(whole).items())


def test_front_coding_round_trip():
    run = suffix.Run()
    rows = np.random.default_rng(1).integers(97, 99, (50, suffix.WIDTH), dtype=np.uint8)
    rows[:, :200] = rows[:1, :200]
    run.add(1, 2, False, rows, np.arange(50), np.zeros(50, int), np.full(50, 63))
    block, _ = run.blocks([])
    assert [s for s, _ in suffix.front_coded(block["shared"][0], block["rest"][0])] == sorted(r.tobytes() for r in rows)
