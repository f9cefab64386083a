"""The trie of conversations against brute force, with the odd cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from survperf.llm import queries as Q
from survperf.llm import trie

CONV = "conv_id long, turn int, role string, text string"


def brute(rows, lend=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if lend else 0
        rebuilt[c] = own.get(c - c % 20, [])[:h] + ts[h:] if lend else ts
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: (t[0], t[1]))


def rebuilt(df):
    conv = F.col("conv")
    turns, convs = trie.borrowed(trie.ordered(df), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return turns, convs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk", [2, 4096])
def test_trie_against_brute_force(spark, seed, chunk):
    r = random.Random(seed)
    rows = []
    for c in range(0, 90):
        if r.random() < 0.9:
            for t in range(r.choice([1, 2, 3, 4, 9])):
                rows.append((c, r.choice([t, t, None]), r.choice(["u", "a", None]), r.choice(["hi  there", "", None, "x"])))
    rows += [(None, 1, "u", "lost"), (7, 3, "u", "tie"), (7, 3, "u", "tie"), (7, 3, "a", "tie"), (-21, 0, "u", "below"), (-40, 0, "u", "base")]
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("x") for c in ("conv", "j", "d", "k1", "path", "chunk", "n", "len", "words", "x1")})
    turns, convs = rebuilt(df)
    # the remainder of a negative id has its sign, here as in SQL
    rows = [row for row in rows if row[0] is None or row[0] >= 0]
    assert plain(trie.prefix_trie(*rebuilt(df.filter("conv_id is null or conv_id >= 0")), chunk)) == brute(rows)
    assert convs.count() == len({row[0] for row in rows if row[0] is not None}) + 2 and turns.count() > 0


def test_trie_of_deep_and_branching_paths(spark):
    """A long chain, copies of it that stop early, and branches at every depth."""
    rows = [(c, t, "u", f"same {t}") for c in (1, 2) for t in range(60)] + [(3, t, "u", f"same {t}") for t in range(25)]
    for c in range(10, 40):
        rows += [(c, t, "u", f"same {t}") for t in range(c - 5)] + [(c, 100, "u", f"own {c // 2}"), (c, 101, "u", "end")]
    df = spark.createDataFrame(rows, CONV)
    turns = trie.ordered(df)
    none, convs = trie.borrowed(turns, F.col("conv"), F.lit(0), 3)
    assert plain(trie.prefix_trie(none, convs, 7)) == brute(rows, lend=False)


def test_empty_table(spark):
    assert trie.prefix_trie(*rebuilt(spark.createDataFrame([], CONV))).count() == 0


def test_only_turnless_conversations(spark):
    """A conversation whose lender is absent and whose own turns are all replaced is a member of the root alone."""
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b")]
    assert plain(trie.prefix_trie(*rebuilt(spark.createDataFrame(rows, CONV)))) == brute(rows)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(Q.op13_trie(spark, sf)) == brute(rows)
