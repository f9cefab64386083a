"""Prefix trie of conversations, its subtree totals by leaf peeling.

``prefix_trie`` gives one row for each distinct sequence of first turns: which conversations start with it, its children, the
leaves and the repeated words below it, and a digest of the conversations that end at it.

Defined cases: rows without a conversation's id belong to none and are left out; turns are ordered by number (null
first), then role, then text, so ties and repeated rows are turns of their own in one order; a null role or text is
empty; a conversation that borrows may end up without turns and then is a member of the root alone; an empty table
gives an empty result, without a root. Only the named columns are read, so others cannot clash.

Plan: turns are ordered by a range shuffle, which may split a long conversation over many tasks; a turn's place is its
place in the task and the number of earlier turns in earlier tasks. A node is named by the xor of 128-bit hashes of (place,
turn), a running value that is taken in chunks of ``CHUNK`` places, so that no task reads a whole long conversation; one
aggregate over all prefixes makes the nodes. A node of one member needs no message: its subtree is a path. The
others are contracted to paths that follow the longest member (it is the same from a node down to the end
of its path), and paths are peeled: each holds a counter of the paths that hang on it, a path whose counter is zero
sends its totals to the one it hangs on, until only the root's path is left. Rounds are as many as paths between the
root and a leaf, whatever the depth. What nodes received is then summed along each path once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.session import written
from survperf.llm.common import cut

#: Places of one conversation or path that a task reads together.
CHUNK = 4096
#: What separates words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["d", "k1", "k2"]


def ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, j, n, c1, c2, words): every turn with its place from 1, the conversation's number of turns, hashes of role and text, and the words of its text."""
    rows = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.select("conv", "at", F.shiftright("at", 33).alias("task"), F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(7), "text", "role").alias("c2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    runs = placed.groupBy("conv", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    earlier = F.sum("k").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv", "task", (F.coalesce(earlier, F.lit(0)) + 1 - F.col("first")).alias("shift"), F.sum("k").over(Window.partitionBy("conv")).alias("n"))
    return cut(placed.join(runs, ["conv", "task"]).select("conv", (F.col("at") + F.col("shift")).alias("j"), "n", "c1", "c2", "words"))


def borrowed(turns: DataFrame, lender: Column, many: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of another one, in place of as many of their own.

    ``lender`` names it and ``many`` (up to ``most``) is the number of its first turns, both columns of ``conv``. Returns the
    turns (conv, d, len, c1, c2, words) and the conversations (conv, len).
    """
    own = turns.filter("j = 1").select("conv", "n")
    lent = own.select(F.col("conv").alias("lender"), F.col("n").alias("lent"))
    named = own.select("conv", "n", lender.alias("lender"), many.cast("long").alias("h")).join(lent, "lender", "left")
    took = F.least("h", F.coalesce("lent", F.lit(0)))
    convs = cut(named.select("conv", "lender", "h", took.alias("took"), (took + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    heads = turns.filter(F.col("j") <= most).select(F.col("conv").alias("lender"), "j", "c1", "c2", "words")
    first = convs.join(heads, "lender").filter("j <= took").select("conv", F.col("j").alias("d"), "len", "c1", "c2", "words")
    rest = turns.join(convs.drop("lender"), "conv").filter("j > h").select("conv", (F.col("j") - F.col("h") + F.col("took")).alias("d"), "len", "c1", "c2", "words")
    return first.unionByName(rest), convs.select("conv", "len")


def running(df: DataFrame, key: str, place: str, values: dict[str, Column], fold, chunk: int, descending: bool = False) -> DataFrame:
    """``df`` with each of ``values`` folded over the rows of its key up to its place; chunks of places are folded apart and then set on what came before."""
    rows = df.withColumn("chunk", F.floor(F.col(place) / chunk) * (-1 if descending else 1))
    order = F.desc(place) if descending else F.asc(place)
    inside = Window.partitionBy(key, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(key, "chunk").agg(*[fold(v).alias(c) for c, v in values.items()])
    bases = tops.select(key, "chunk", *[fold(F.col(c)).over(before).alias(f"{c}_base") for c in values]).filter(" and ".join(f"{c}_base is not null" for c in values))
    done = rows.withColumns({f"{c}_in": fold(v).over(inside) for c, v in values.items()}).join(bases, [key, "chunk"], "left")
    both = {c: fold_two(fold, F.col(f"{c}_in"), F.coalesce(f"{c}_base", F.lit(0).cast("long"))) for c in values}
    return done.withColumns(both).drop("chunk", *[f"{c}_{x}" for c in values for x in ("in", "base")])


def fold_two(fold, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if fold is F.bit_xor else a + b


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, d, len, words, k1, k2, p1, p2): the hash of each prefix and of the one a turn shorter."""
    rows = turns.withColumns({"x1": F.xxhash64("d", "c1"), "x2": F.xxhash64(F.lit(7), "d", "c2")})
    rows = running(rows, "conv", "d", {"k1": F.col("x1"), "k2": F.col("x2")}, F.bit_xor, chunk)
    return rows.select("conv", "d", "len", "words", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))


def digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(d, k1, k2, ends): SHA-256 of the ascending, comma-joined ids of the conversations that end at a node.

    The ids are sorted and joined by many tasks; one reads the joined parts of a node in order, a part at a time, as the digest asks for.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*key, int(g["conv"].iloc[0]), ",".join(map(str, g["conv"]))) for key, g in b.groupby(KEY, sort=False)], columns=[*KEY, "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for b in batches:
            out = []
            for *key, ids in b[[*KEY, "ids"]].itertuples(index=False):
                if key == at:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends"])
        if sha:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=[*KEY, "ends"])

    names = "d long, k1 long, k2 long"
    parts = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInPandas(join, f"{names}, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(digest, f"{names}, ends string")


def peeled(paths: DataFrame) -> DataFrame:
    """(path, up, at, leaves, saved) of all paths with their totals; ``paths`` has each with its own sums and the path ``up`` it hangs on, null for the root's."""
    below = paths.filter("up is not null").groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("left"))
    state, done = written(paths.join(below, "path", "left").withColumn("left", F.coalesce("left", F.lit(0)))), []
    while not state.isEmpty():
        ready = state.filter("left = 0")
        done.append(ready.drop("left"))
        sent = ready.filter("up is not null").groupBy(F.col("up").alias("to")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        waiting = state.filter("left > 0").join(sent, F.col("path") == F.col("to"), "left")
        got = lambda c: F.coalesce(c, F.lit(0))
        state = written(waiting.select("path", "up", "at", (F.col("leaves") + got("l")).alias("leaves"), (F.col("saved") + got("s")).alias("saved"), (F.col("left") - got("n")).alias("left")))
    return reduce(DataFrame.unionByName, done) if done else paths


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` has (conv, d, len, c1, c2, words), d from 1 to len without gaps, and ``convs`` every (conv, len).
    """
    zero, long = F.lit(0).cast("long"), F.struct(F.col("len"), F.bitwise_not("conv").alias("own"))
    rows = cut(prefixes(turns, chunk))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max(long).alias("m")).filter("n > 0")
    root = root.select(*[zero.alias(c) for c in KEY], "conv", "n", zero.alias("words"), "m", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    found = rows.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max(long).alias("m"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = cut(found.unionByName(root).select(*KEY, "conv", "n", "words", F.bitwise_not(F.col("m.own")).alias("path"), F.col("m.len").alias("deep"), "p1", "p2"))
    above = nodes.filter("n > 1 or d = 0").select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up_conv"), F.col("path").alias("up_path"))
    # a node of one member under another one has its name
    linked = cut(nodes.join(above, ["d", "p1", "p2"], "left").withColumn("parent", F.when(F.col("d") > 0, F.coalesce("up_conv", "conv"))))
    kids = linked.filter("up_path is not null").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("kids"), F.sum((F.col("n") == 1).cast("long")).alias("lone"))
    many = linked.filter("n > 1 or d = 0").join(kids, KEY, "left").withColumns({"kids": F.coalesce("kids", zero), "lone": F.coalesce("lone", zero)})
    many = cut(many.withColumns({"leaves": F.when(F.col("kids") == 0, 1).otherwise(F.col("lone")), "saved": (F.col("n") - 1) * F.col("words")}))

    top = F.min_by(F.struct("up_path", "d"), "d")
    paths = many.groupBy("path").agg(top.alias("t"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    done = peeled(paths.select("path", F.col("t.up_path").alias("up"), (F.col("t.d") - 1).alias("at"), "leaves", "saved"))
    got = done.filter("up is not null").groupBy(F.col("up").alias("path"), F.col("at").alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    summed = many.join(got, ["path", "d"], "left")
    summed = running(summed, "path", "d", {"all_leaves": F.col("leaves") + F.coalesce("l", zero), "all_saved": F.col("saved") + F.coalesce("s", zero)}, F.sum, chunk, descending=True)

    ends = rows.filter("d = len").select(*KEY, "conv").unionByName(convs.filter("len = 0").select(*[zero.alias(c) for c in KEY], "conv"))
    shared = summed.select(*KEY)
    ended = digests(ends.join(shared, KEY, "left_semi"), chunk)
    none = F.sha2(F.lit(""), 256)
    big = summed.join(ended, KEY, "left").select("conv", "d", "parent", "n", "kids", F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved"), F.coalesce("ends", none).alias("ends"))
    last = F.col("d") == F.col("deep")
    small = linked.filter("n = 1 and d > 0").select("conv", "d", "parent", "n", F.when(last, 0).otherwise(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), zero.alias("saved"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(none).alias("ends"))
    names = dict(zip(("conv", "d", "parent", "n", "kids", "leaves", "saved", "ends"), ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), strict=True))
    return big.unionByName(small).select(*[F.col(k).alias(v) for k, v in names.items()])
