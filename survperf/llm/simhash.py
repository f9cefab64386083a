"""SimHash near-duplicate groups by pigeonhole blocks.

``near_duplicates`` gives each row a 64-bit fingerprint of its word shingles and the
smallest id that can be reached over links of at most ``distance`` differing bits.

Defined cases: a null or empty text has no shingles and the fingerprint zero, linked like
any other; fewer words than a shingle make one shingle of all words; repeated rows share a
fingerprint and hence a component; a row whose id is null is linked like others but names a
component only if no other row of it has an id (then null). An empty table gives an empty
result. Other columns of the input are dropped, so their names cannot clash.

Plan: one Python pass hashes shingles (xxhash) and votes bits (numpy); rows are reduced to
distinct fingerprints before any block is made, so copies never multiply. With d bits of
slack the 64 bits are cut into d + 2 blocks: a linked pair agrees on at least two of them, and
is found under one of the C(d + 2, 2) block pairs. Blocks with more than ``hot`` members are cut
further: the other bits are cut into d + 1 parts, one of which a linked pair shares too.
Each member is tried with a few hubs of its block first, and then only members of different components in blocks that hold
several, so a family of near copies makes about as many links as it has members. Components come from alternating large and
small stars over edges written as a table in each round. Fingerprints of more than one row in ``OFTEN`` are fewer than ``OFTEN``: their rows meet
them by a broadcast, so no task holds all rows of one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survperf.llm.common import bit_set, cut, in_bits, small_batches, take_worker, written

WORDS = 3
DISTANCE = 3
#: Members beyond which a block is cut further.
HOT = 256
#: Members of a block that all others in it are tried with first.
HUBS = 3
#: Fingerprints of a larger share of the rows than one in so many are joined by a broadcast.
OFTEN = 1000
#: What names a block.
BLOCK = ["t", "key", "part", "sub"]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The bytes of each shingle's hash, a row for each shingle of a text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in spans])
    return np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def votes_of(rows: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of hashes, the bytes of one in each row: the bits that over half of them have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        votes += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(rows)).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    return votes_of(shingle_hashes(text, words))


def with_fingerprint(df: DataFrame, text_col: str, words: int = WORDS) -> Column:
    """Signed 64-bit fingerprint column of ``text_col``."""
    small_batches(df.sparkSession)

    @F.pandas_udf(T.LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_worker("simhash")
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return fp(F.col(text_col))


def _cuts(bits: int, parts: int) -> list[int]:
    return [bits * i // parts for i in range(parts + 1)]


def _bits(fp: Column, lo: int, hi: int) -> Column:
    """Bits ``lo`` to ``hi`` of ``fp``."""
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _spread(fp: Column, free: list[tuple[int, int]], parts: int) -> list[Column]:
    """The bits of the ranges ``free``, cut into ``parts`` keys of about equal width."""
    at = [b for lo, hi in free for b in range(lo, hi)]
    cuts = _cuts(len(at), parts)
    keys = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own, mask = at[a:b], 0
        for bit in own:
            mask |= 1 << bit
        keys.append(fp.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))))
    return keys


def in_blocks(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(fp, t, key, part, sub): the distinct fingerprints in ``prints.fp`` in each of their blocks; a linked pair shares one."""
    blocks = distance + 2
    cuts = _cuts(64, blocks)
    ranges = list(zip(cuts, cuts[1:], strict=False))
    fp = F.col("fp")
    keys, rests = [], []
    for i, j in combinations(range(blocks), 2):
        a, b = _bits(fp, *ranges[i]), _bits(fp, *ranges[j])
        keys.append(F.shiftleft(a, ranges[j][1] - ranges[j][0]).bitwiseOR(b))
        free = [r for n, r in enumerate(ranges) if n not in (i, j)]
        rests.append(F.array(*_spread(fp, free, distance + 1)))
    rows = prints.select("fp", F.posexplode(F.array(*keys)).alias("t", "key"))
    sizes = cut(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("t", "key"))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub")))
    if sizes.isEmpty():
        return rows.select("fp", "t", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"))
    rest = F.element_at(F.array(*rests), F.col("t") + 1)
    parts = F.transform(rest, lambda x, i: F.struct(i.alias("part"), x.alias("sub")))
    marked = rows.join(sizes.withColumn("is_hot", F.lit(True)), ["t", "key"], "left")
    return marked.select("fp", "t", "key", F.explode(F.when(F.col("is_hot"), parts).otherwise(whole)).alias("x")).select("fp", "t", "key", "x.part", "x.sub")


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _met(keyed: DataFrame, distance: int, *also: Column) -> DataFrame:
    """Pairs (a, b), a < b, of one block of ``keyed`` that are linked."""
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in BLOCK]
    pairs = a.join(b, [*same, *also, F.col("a.fp") < F.col("b.fp"), _near(F.col("a.fp"), F.col("b.fp"), distance)])
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in ``prints.fp`` that are linked: all of them."""
    return _met(in_blocks(prints, distance, hot), distance)


def hub_links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT, hubs: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``links`` one of which is a hub of a block that holds both, and (fp, block, hubs) of all blocks of several."""
    keyed = in_blocks(prints, distance, hot)
    fp = F.col("fp")
    chosen = [F.min(F.struct(F.xxhash64(F.lit(i), fp).alias("o"), fp))["fp"] for i in range(hubs)]
    groups = keyed.groupBy(*BLOCK).agg(F.min(fp).alias("lo"), F.max(fp).alias("hi"), F.array(*chosen).alias("hubs")).filter("lo < hi").drop("lo", "hi")
    crowded = cut(keyed.join(groups, BLOCK))
    tried = crowded.select("fp", F.explode("hubs").alias("hub")).filter((fp != F.col("hub")) & _near(fp, F.col("hub"), distance))
    return cut(tried.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()), crowded


def star_links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT, hubs: int = HUBS) -> DataFrame:
    """As many of the pairs of ``links`` as join all that it joins: links to hubs, then links across what these leave apart."""
    found, crowded = hub_links(prints, distance, hot, hubs)
    fp = F.col("fp")
    roots = components(found)
    rooted = cut(crowded.drop("hubs").join(roots, fp == F.col("node"), "left").select("fp", *BLOCK, F.coalesce("root", "fp").alias("root")))
    apart = rooted.groupBy(*BLOCK).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(*BLOCK)
    return found.unionAll(_met(rooted.join(apart, BLOCK, "left_semi"), distance, F.col("a.root") != F.col("b.root")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with a link other than roots.

    ``edges`` has bigint columns a, b. Large stars hang each node's larger neighbours on its
    smallest one, small stars its smaller ones; a fixed point is a forest of stars. What is
    planned in a round does not grow with the rounds before it.
    """
    now, folder = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select("u", "v", "m")
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now, folder = written(hung.select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), folder)
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(id, fp, root, component_id) for every row of ``df``; root is the component's smallest fingerprint."""
    rows = cut(df.select(F.col(id_col).alias("id"), with_fingerprint(df, text_col, words).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = components(star_links(prints.select("fp"), distance, hot))
    joined = cut(
        prints.join(roots, prints.fp == roots.node, "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    )
    least = cut(joined.groupBy("root").agg(F.min("rep").alias("component_id")))
    total = prints.agg(F.sum("n").alias("n")).first().n or 0
    named = cut(joined.join(least, "root").select("fp", "root", "component_id", (F.col("n") * OFTEN > total).alias("often")))
    often, seldom = F.broadcast(named.filter("often").drop("often")), named.filter("not often").drop("often")
    both = rows.join(often, "fp").unionByName(rows.join(often.select("fp"), "fp", "left_anti").join(seldom, "fp"))
    return both.select("id", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(id, fp bigint, component_id) for every row of ``df``."""
    return grouped(df, id_col, text_col, **options).select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``df`` less near copies: of each component the row with the smallest id stays.

    Rows without an id come last in that order; rows that share an id are told apart by their
    fingerprint, and of rows equal in both one stays.
    """
    return one_of_each(df, grouped(df, id_col, text_col, **options), with_fingerprint(df, text_col, options.get("words", WORDS)), id_col)


def one_of_each(df: DataFrame, groups: DataFrame, fp: Column, id_col: str) -> DataFrame:
    """The first row of each root of ``groups`` (id, fp, root); ``fp`` is the column of ``df`` that tells rows of one id apart."""
    found = cut(groups)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp"))
    kept = cut(found.groupBy("root").agg(first.alias("k")).select("k.id", "k.fp"))
    repeats = cut(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select("id"))
    settled = kept.join(repeats, kept.id.eqNullSafe(repeats.id), "left_anti").select("id")
    # all other ids are in a set of bits; only rows that it may hold are shuffled to be told apart
    other = cut(found.select("id").distinct().join(settled, "id", "left_anti"))
    count = other.count()
    if not count:
        return df
    bits = bit_set(other.select(F.xxhash64("id").alias("h")), count).scalar()
    unsure = in_bits(bits, F.xxhash64("own"))
    # the input's columns stay inside a struct, so that none has a name of ours
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("own"))
    once = rows.filter(~unsure).unionByName(rows.filter(unsure).join(settled, F.col("own") == F.col("id"), "left_semi")).select("row.*")
    if repeats.isEmpty():
        return once
    rest = df.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), fp.alias("own_fp")).join(repeats, F.col("own").eqNullSafe(F.col("id")), "left_semi")
    rest = rest.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_fp") == F.col("fp")), "left_semi")
    return once.unionByName(rest.dropDuplicates(["own", "own_fp"]).select("row.*"))
