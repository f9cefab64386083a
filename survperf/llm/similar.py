"""Exact near-copy groups by the Jaccard similarity of word shingles.

Two texts are near copies if their sets of ``WORDS``-word shingles have a Jaccard similarity of
``SIMILAR`` (a fraction) or more. Candidates come from SimHash fingerprints of the sets, under the blocks and the distance of ``simhash``. Similar sets
whose fingerprints differ in more bits are found too, so nothing depends on a chance of
meeting: shingles have one global order, and two sets that similar share one of the first
n - ceil(SIMILAR n) + 1 shingles of each (prefix filter), which is asked for sets that the fingerprints have not joined. Candidates are verified by their whole sets.

Defined cases: a null or empty text has no shingles, and such texts are copies of each other; fewer
words than a shingle make one shingle of all words; rows without an id or with repeated ids are told
apart by their sets.

Plan: one Python pass hashes shingles; rows are reduced to distinct sets before pairs are made, so
copies never multiply. The order puts shingles that a sample of the texts often holds last, so that
prefixes hold rare ones: the sample decides the number of candidates, never the result. One shuffle of
the prefixes finds the sets that share one. A set's parity bits, at least twice as many as it has shingles, tell
of each hash class whether it holds an odd number: two sets differ in at least as many shingles as in bits, so
candidates too far apart go without their sets. Each set is verified with a few that share a shingle first, and then only pairs that this has not linked yet: a family of copies takes about as many comparisons as members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survperf.llm.common import bit_set, cut, in_bits, let, small_batches, take_worker
from survperf.llm.simhash import components, hub_links, one_of_each, shingle_hashes, votes_of

WORDS = 5
#: Least similarity, as numerator and denominator.
SIMILAR = (4, 5)
#: One text in ``SAMPLE`` tells which shingles are common: those that ``COMMON`` of them hold.
SAMPLE, COMMON = 16, 2
#: Sets of each shared shingle that all others with it are tried with first.
HUBS = 3
#: Least bits that bound the difference of two sets, a power of two.
PARITY = 512
#: Common shingles that are sent to the tasks; others count as rare.
MOST_COMMON = 500_000
#: Candidates' texts whose hashes are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_SET = "key long, n int, prefix array<long>, bits array<long>, fp long"


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(text, words).view(">u8").ravel().astype(np.uint64).view(np.int64))


def set_print(hashes: np.ndarray) -> int:
    """Signed SimHash fingerprint of a set."""
    fp = votes_of(hashes.astype(">i8").view(np.uint8).reshape(-1, 8))
    return fp - (1 << 64) if fp >> 63 else fp


def set_key(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else 0


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each class of hashes whether it holds an odd number, 64 classes a number."""
    classes = max(PARITY, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else PARITY
    odd = np.bincount(hashes & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def bits_apart(a: Column, b: Column) -> Column:
    """In how many classes two sets differ, by the fewer classes of the two."""

    def halved(x: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.transform(F.slice(x, F.lit(1), half), lambda v, i: v.bitwiseXOR(F.get(x, i + half)))

    same = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.zip_with(F.when(F.size(s["a"]) > F.size(s["b"]), halved(s["a"])).otherwise(s["a"]), F.when(F.size(s["b"]) > F.size(s["a"]), halved(s["b"])).otherwise(s["b"]), lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def _sets(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_worker("similar")
        for texts in batches:
            yield pd.Series([shingle_set(t, words) for t in texts], dtype=object)

    return sets(text)


def common_shingles(df: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Shingles that many texts hold, the least common first."""
    some = df.select(text_col).filter(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).distinct()
    counts = some.select(F.explode(_sets(F.col(text_col), words)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= COMMON)
    rows = counts.orderBy(F.desc("k"), "h").limit(MOST_COMMON).toPandas()
    return rows["h"].to_numpy(np.int64)[::-1]


def with_set(text: Column, common: np.ndarray, words: int = WORDS) -> Column:
    """(key, n, prefix, bits, fp) of a text: its set's name and size, the set's first shingles in the global order, its parities and its fingerprint."""
    at = np.argsort(common)
    known = common[at]

    @F.pandas_udf(_SET)
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        take_worker("similar")
        for texts in batches:
            out = []
            for t in texts:
                h = shingle_set(t, words)
                place = np.searchsorted(known, h)
                often = known[np.minimum(place, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                order = np.concatenate((h[~often], common[np.sort(at[place[often]])]))
                least = -(-SIMILAR[0] * len(h) // SIMILAR[1])
                out.append((set_key(h), len(h), order[: len(h) - least + 1], parity(h), set_print(h)))
            yield pd.DataFrame(out, columns=["key", "n", "prefix", "bits", "fp"])

    return sets(text)


def distinct_sets(sets: DataFrame) -> DataFrame:
    """The rows of ``sets``, one of each key. Only those whose key may be repeated, by a set of bits without misses, are shuffled."""
    repeated = cut(sets.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"))
    count = repeated.count()
    if not count:
        return sets
    marked = sets.crossJoin(F.broadcast(bit_set(repeated, count).withColumnRenamed("bits", "known"))).withColumn("again", let(F.col("known"), lambda b: in_bits(b, F.col("key")))).drop("known")
    return marked.filter("not again").unionByName(marked.filter("again").dropDuplicates(["key"])).drop("again")


def print_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``sets`` whose fingerprints are linked: one of each fingerprint for links to hubs, and each with the first of its own fingerprint."""
    named = sets.filter("n > 0").select("key", "fp")
    prints = cut(named.groupBy("fp").agg(F.min("key").alias("key"), F.max("key").alias("last")))
    own = prints.select(F.col("fp").alias("p"), F.col("key").alias("first"), "last")
    twins = own.filter("first < last").drop("last")
    twins = F.broadcast(twins) if twins.count() <= MOST_BROADCAST else twins
    same = named.join(twins, F.col("fp") == F.col("p")).filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    of = lambda c: own.select(F.col("p").alias(c), F.col("first").alias(f"k{c}"))
    near = hub_links(prints.select("fp"))[0].join(of("a"), "a").join(of("b"), "b")
    return same.unionAll(near.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))).distinct()


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(key, h, n, at, hubs): the prefix shingles of the distinct ``sets`` that several hold, and ``HUBS`` of their keys, by as many orders."""
    # the set's size and the shingle's place in one number: most of what is shuffled here are these rows
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("p")
    rows = sets.filter("n > 0").select("key", "n", F.posexplode("prefix").alias("at", "h")).select("key", "h", packed)
    all_of = Window.partitionBy("h")
    hubs = [F.min(F.struct(F.xxhash64(F.lit(i), "key").alias("o"), "key")).over(all_of)["key"] for i in range(HUBS)]
    held = rows.withColumns({"k": F.count(F.lit(1)).over(all_of), "hubs": F.array(*hubs)}).filter("k > 1")
    return cut(held.select("key", "h", F.shiftright("p", 32).alias("n"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"), "hubs"))


def across(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that share a prefix shingle, may be similar by size and place, and have different roots."""
    num, den = SIMILAR
    rooted = cut(shared.drop("hubs").join(roots, F.col("key") == F.col("node"), "left").select("key", "h", "n", "at", F.coalesce("root", "key").alias("root")))
    a, b = rooted.alias("a"), rooted.alias("b")
    size = F.col("a.n") + F.col("b.n")
    # the first shared shingle leaves room for an overlap that large
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) * (num + den) >= size * num
    close = (F.col("a.n") * den >= F.col("b.n") * num) & (F.col("b.n") * den >= F.col("a.n") * num)
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & close & room)
    return met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def near_by_bits(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits do not tell apart; ``marks`` is (key, n, bits)."""
    num, den = SIMILAR
    named = lambda c: marks.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    most = (F.col("na") + F.col("nb")) * (den - num)
    close = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return cut(both.filter(close & (bits_apart(F.col("ba"), F.col("bb")) * (num + den) <= most)).select("a", "b"))


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Only their texts are read; each set of a ``b`` is shuffled to its ``a``."""
    num, den = SIMILAR
    # one row that has each set, told by its text's hash and id
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    of = sets.groupBy("key").agg(first.alias("r")).select("key", F.col("r.id").alias("own"), F.col("r.th").alias("own_th"))

    def read(wanted: DataFrame) -> DataFrame:
        """``wanted`` (key, more) with the key's set."""
        slim = cut(of.join(wanted, "key"))
        slim = F.broadcast(slim) if slim.count() <= MOST_BROADCAST else slim
        chosen = texts.join(slim, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own")))
        return chosen.select("key", "more", _sets(F.col("text"), words).alias("s"))

    hubs = read(pairs.select(F.col("a").alias("key"), F.lit(None).cast("array<bigint>").alias("more")).distinct()).select(F.col("key").alias("a"), F.col("s").alias("sa"))
    members = read(pairs.groupBy(F.col("b").alias("key")).agg(F.collect_list("a").alias("more"))).select(F.col("key").alias("b"), F.explode("more").alias("a"), F.col("s").alias("sb"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    return members.join(hubs, "a").filter(overlap * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b")


def links(sets: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Links (a, b) of the keys in ``sets`` (id, th, key, n, prefix, bits, fp) that join all similar sets; ``texts`` is (id, th, text).

    First sets whose fingerprints are linked are verified. What fingerprints leave apart is met by the prefix filter: each set is tried with a few that hold a shingle of its
    prefix. Sets that this joins need no other link, so a family of copies makes no pairs beyond these. Then all pairs across families are tried.
    """
    single = distinct_sets(sets)
    shared = shared_shingles(single)
    marks = cut(single.join(shared.select("key").distinct(), "key", "left_semi").select("key", "n", "bits"))
    near = cut(verified(near_by_bits(print_pairs(single), marks), sets, texts, words))
    roots = components(near)
    hubs = shared.select("key", F.explode("hubs").alias("hub")).filter("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = hubs.join(named("a"), "a", "left").join(named("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    near = near.unionAll(cut(verified(near_by_bits(apart, marks), sets, texts, words)))
    families = components(near)
    pairs = near_by_bits(across(shared, families), marks)
    return near if pairs.isEmpty() else near.unionAll(verified(pairs, sets, texts, words))


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, root) for every row of ``df``: the name of its set and the smallest one of its group."""
    small_batches(df.sparkSession)
    th = F.xxhash64(text_col).alias("th")
    made = with_set(F.col(text_col), common_shingles(df, text_col, words), words)
    rows = cut(df.select(F.col(id_col).alias("id"), th, made.alias("s")).select("id", "th", "s.*"))
    roots = components(links(rows, df.select(F.col(id_col).alias("id"), th, F.col(text_col).alias("text")), words))
    found = rows.join(roots, rows.key == roots.node, "left")
    return found.select("id", F.col("key").alias("fp"), F.coalesce("root", "key").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``df`` less near copies: of each group of linked rows the one with the smallest id stays, in the order of ``simhash.keep_one``."""
    key = with_set(F.col(text_col), np.zeros(0, np.int64), words)["key"]
    return one_of_each(df, grouped(df, id_col, text_col, words), key, id_col)
