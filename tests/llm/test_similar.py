"""Near copies by exact similarity, against brute force over all pairs."""

import itertools
from collections import Counter

import pytest

from survperf.llm import similar, simhash
from tests.llm.test_operators import ODD, brute_fp
from tests.llm.test_operators import odd  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(texts):
    """The smallest id of each group of texts that are linked by a similarity of 0.8 or more."""
    sets = {k: brute_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    far = 0
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
            continue
        both = len(x & y)
        if 5 * both >= 4 * (len(x) + len(y) - both):
            far += (brute_fp(texts[a]) ^ brute_fp(texts[b])).bit_count() > 3
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {find(k) for k in texts}, far


def test_stage_removes_every_near_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, far = brute_kept(texts)
    got = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == want and got.columns == docs.columns
    assert far >= 5  # pairs that three bits of a fingerprint do not link


def test_edited_copies_and_the_threshold(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    edits = {1: [], 2: [50], 3: [20, 80], 4: [20, 50, 80]}  # a changed word changes five shingles
    texts = {k: " ".join("x" if i in at else w for i, w in enumerate(base)) for k, at in edits.items()}
    texts |= {5: " ".join(base[:84]), 6: " ".join(f"v{i}" for i in range(104)), 7: " ".join(f"v{i}" for i in range(83)), 8: "short text", 9: "Short  text"}
    assert brute_kept({k: texts[k] for k in (1, 5)})[0] == {1} and brute_kept({k: texts[k] for k in (6, 7)})[0] == {6, 7}
    got = similar.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == brute_kept(texts)[0] >= {1, 6, 7, 8}


def test_common_shingles_change_no_result(spark, monkeypatch):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts |= {10**6 + k: " ".join(t.split()[:-1]) for k, t in texts.items() if t}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(similar, "SAMPLE", 1)
    assert len(similar.common_shingles(df, "text", 5))
    assert {r.doc_id for r in similar.keep_one(df).collect()} == brute_kept(texts)[0]


def test_odd_cases(spark, odd):  # noqa: F811
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and similar.keep_one(odd.limit(0)).count() == 0
    assert Counter((r.doc_id, (r.text or "")[:3]) for r in kept.collect()) == Counter([(1, ""), (3, "one"), (None, "two"), (4, "AB "), (5, "The"), (6, "ééé")])
    assert len(ODD) == similar.grouped(odd).count() == simhash.grouped(odd, "doc_id", "text").count()
