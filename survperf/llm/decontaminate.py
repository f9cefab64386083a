"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. The
hashes of all windows of ``WINDOW`` consecutive item words, and of whole shorter items, are the
test side. Two bit sets made of it, of 1 MB at most whatever its size, reach every task: one of the
hashes of the windows' first two words (one, if an item has but one), one of the windows' whole hashes.
Each document's windows are looked up in them inside its row, so the work is in proportion to its
words; only the windows that pass both leave it, with their hash and words. They are joined with the test
side by hash and verified word by word. The test side is broadcast there while it has at most
``MOST_BROADCAST`` windows and shuffled beyond that; larger benchmarks let more false candidates
through the bit sets, which the join removes, and change no result.

Defined cases: a null or empty text has no words; an item without words has no window; items
without an id taint documents but are not counted or named; repeated rows each get their result;
an empty table on either side gives no hits. Columns other than the id and text are dropped by
``scan`` and kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.llm.common import ascii_lower, at_most, bit_set, cut, in_bits, let

WINDOW = 10
#: Windows of about 100 bytes each, so at most some 100 MB.
MOST_BROADCAST = 1_000_000
HIT = "array<struct<at:int,n:int,h:bigint,gram:string>>"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of word characters, upper case included.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def head(words: Column, at: Column, width: int) -> Column:
    """Hash of the first ``width`` words, one or two, from place ``at``, counted from 1."""
    first = F.get(words, at - 1)
    return F.xxhash64(first) if width == 1 else F.xxhash64(first, F.get(words, at))


def test_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, n, gram, item): distinct windows of the items."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(window)))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))
    out = items.select("item", "n", F.explode(cut).alias("g"))
    return out.select(F.xxhash64("g").alias("h"), "n", F.array_join("g", " ").alias("gram"), "item").distinct()


def candidates(words: Column, starts: Column, whole: Column, lengths: list[int], width: int) -> Column:
    """(n_words, hits): the number of words, and (at, n, h, gram) of the windows that both bit sets let through."""

    def windows(w: Column, places: Column, bits: Column) -> Column:
        of = lambda n: F.transform(F.filter(places, lambda i: i + (n - 1) <= F.size(w)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.slice(w, i, n)).alias("h")))
        every = F.filter(F.concat(*[of(n) for n in lengths]), lambda x: in_bits(bits, x["h"]))
        return F.transform(every, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["h"].alias("h"), F.array_join(F.slice(w, x["at"], x["n"]), " ").alias("gram")))

    def some(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (width - 1))
        places = let(starts, lambda bits: F.filter(at, lambda i: in_bits(bits, head(w, i, width))))
        hits = F.when(F.size(w) >= width, let(whole, lambda bits: let(places, lambda p: windows(w, p, bits)))).otherwise(F.array().cast(HIT))
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    return let(words, some)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, n_words, copies, spans, items): distinct rows of ``docs`` with their verified hits.

    spans are (first word from 1, number of words) of hit windows; items the ids of items with
    occurring windows.
    """
    test = cut(test_windows(benchmark, window=window))
    lengths = sorted(r[0] for r in test.select("n").distinct().collect())  # at most `window` numbers
    count, width = test.count(), 1 if 1 in lengths else 2
    keys = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]
    words = words_of(F.col(text_col))
    if lengths:
        first = F.slice(F.split("gram", " "), 1, width)
        sets = {"starts": bit_set(test.select(head(first, F.lit(1), width).alias("s")), count).scalar(), "whole": bit_set(test.select("h"), count).scalar()}
        # each used once, so that the sets stay constants and are no columns of rows
        rows = docs.select(*keys, words.alias("w"), *[v.alias(k) for k, v in sets.items()]).select("id", "text_hash", candidates(F.col("w"), F.col("starts"), F.col("whole"), lengths, width).alias("f"))
        rows = cut(rows.select("id", "text_hash", "f.n_words", "f.hits"))
    else:
        rows = cut(docs.select(*keys, F.size(words).cast("long").alias("n_words"), F.array().cast(HIT).alias("hits")))
    known = test.select("h", F.col("n").alias("tn"), F.col("gram").alias("tgram"), "item")
    tried = rows.select("id", "text_hash", F.explode("hits").alias("x")).select("id", "text_hash", "x.*")
    same = (tried.h == known.h) & (tried.n == known.tn) & (tried.gram == known.tgram)
    hits = tried.join(F.broadcast(known) if count <= MOST_BROADCAST else known, same)
    span = F.struct(F.col("at").alias("first"), "n")
    hits = hits.groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("item").alias("items"))
    texts = rows.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    both = texts.join(hits, texts.id.eqNullSafe(hits.hit_id) & (texts.text_hash == hits.hit_hash), "left")
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return both.select("id", "text_hash", "n_words", "copies", none("spans"), none("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted ``spans``."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["first"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["first"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"]).cast("long")


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without tainted documents, or with the hit words cut out of their texts (``what="spans"``).

    Between the cuts texts are unchanged. An id that is null is a value like any other.
    """
    found = scan(docs, benchmark, id_col, text_col, window).filter(F.size("spans") > 0).select("id", "text_hash", "spans")
    # the input's columns stay inside a struct, so that none has a name of ours
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"))
    key = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))
    if what == "documents":
        return rows.join(found, key, "left_anti").select("row.*")
    own = F.col("row")[text_col]
    words, gaps = F.regexp_extract_all(own, F.lit(RAW_WORD), F.lit(0)), F.split(own, RAW_WORD, -1)
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))))

    def kept(w: Column, hit: Column) -> Column:
        is_hit = lambda i: F.coalesce(F.get(hit, at_most(hit, i + 1) - 1) == i + 1, F.lit(False))
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(is_hit(i), F.lit("")).otherwise(F.coalesce(F.get(w, i), F.lit(""))))), "")

    text = F.when(F.col("spans").isNull(), own).otherwise(let(words, lambda w: let(numbers, lambda hit: kept(w, hit))))
    return rows.join(found, key, "left").select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
