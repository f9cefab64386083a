"""Best-fit packing of token sequences by exact-complement hashing.

``tokenize_pieces`` turns each row into its tokens' pieces of at most ``capacity`` ids;
``pack`` assigns every row of any table with a length column a sequence and a place in it.

The plan is made on the histogram of lengths, which has at most ``capacity`` rows whatever the
input: for each length from the longest down, its complement is looked up in an index of single
lengths, sums of pairs and sums of triples, and combinations that fill the gap exactly are consumed in
bulk while their lengths are available; what is left is packed best-fit. The n-th piece of a
length then takes the n-th slot of that length: pieces are numbered by a prefix sum over
(length, salt) groups, where the salts of a length grow with its count, so that a length that
holds a third of all rows is numbered by many tasks.

Defined cases: a null text is empty; an empty text is the end id alone; a longer text than
``capacity`` is cut into full pieces and a rest; equal rows get different slots; an empty table
gives an empty result. ``pack`` replaces input columns named sequence_id and offset.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survperf.llm.common import cut, small_batches, take_worker

CAPACITY = 2048
END_ID = 0
SEED = 20_241
#: Pieces numbered by one group, and the most groups of a length.
RANK_ROWS, MOST_SALTS = 256, 4096
#: Words whose ids a worker remembers before it starts anew (about 80 MB), and words encoded as one text.
REMEMBERED, JOINED = 2_000_000, 20_000
#: Bytes of text worked on at once.
GATHERED = 4 << 20
#: A run of letters with plain marks after it: the tokenizer splits between the two.
LETTERS_MARKS = re.compile(r"([^\W\d_]+)([.,;:!?]+)\Z")

Pattern = tuple[list[tuple[int, int]], int]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _closing(path: str) -> np.ndarray:
    """Whether each id closes a word."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=False)
    closes = np.zeros(max(_tokenizer(path).get_vocab().values()) + 1, bool)
    closes[[i for name, i in vocab.items() if name.endswith("</w>")]] = True
    return closes


class Memory:
    """Ids of words, in arrays: about 40 bytes a word. Words are known by 128-bit hashes."""

    def __init__(self) -> None:
        self.high = self.low = np.zeros(0, np.uint64)  # the hashes, in the order of ``high``
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in the pool, -1 if unknown, and the number of ids of each word."""
        if not len(self.high):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int32)
        order = np.argsort(hashes[:, 0])  # neighbours in memory one after the other
        row = np.empty(len(hashes), np.int64)
        row[order] = np.minimum(np.searchsorted(self.high, hashes[order, 0]), len(self.high) - 1)
        known = (self.high[row] == hashes[:, 0]) & (self.low[row] == hashes[:, 1])
        return np.where(known, self.at[row], -1), np.where(known, self.size[row], 0)

    def put(self, hashes: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Keep words that are not known yet; their places in the pool."""
        data = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        at = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        while self.used + len(data) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool) // 2, "<u4")))
        self.pool[self.used : self.used + len(data)] = data
        self.used += len(data)
        first = np.unique(hashes[:, 0], return_index=True)[1]  # sorted
        row = np.searchsorted(self.high, hashes[first, 0])
        new = first[(row == len(self.high)) | (self.high[np.minimum(row, max(0, len(self.high) - 1))] != hashes[first, 0])] if len(self.high) else first
        row = np.searchsorted(self.high, hashes[new, 0])
        self.high, self.low = np.insert(self.high, row, hashes[new, 0]), np.insert(self.low, row, hashes[new, 1])
        self.at, self.size = np.insert(self.at, row, at[new]), np.insert(self.size, row, sizes[new])
        return at


@lru_cache(maxsize=2)
def _memory(path: str) -> list[Memory]:
    return [Memory()]


def forget() -> None:
    """Drop the words and the tokenizer that a worker holds."""
    for held in (_memory, _closing, _tokenizer):
        held.cache_clear()
    pa.default_memory_pool().release_unused()


def _hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _word_ids(words: list[str], path: str) -> list[bytes]:
    """The ids of each of some words of letters alone.

    Such a word is one unit of the tokenizer, whose last id closes a word: many are encoded as
    one text and told apart by that.
    """
    tok, closes, out = _tokenizer(path), _closing(path), []
    for at in range(0, len(words), JOINED):
        some = words[at : at + JOINED]
        ids = np.asarray(tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(closes[ids]) + 1
        if len(ends) == len(some):
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        else:  # a letter that the tokenizer changes into others
            out += [_packed(e.ids) for e in tok.encode_batch_fast(some, add_special_tokens=False)]
    return out


def _encoded(words: list[str], path: str) -> dict[str, bytes]:
    """The ids of words; those of letters with marks after them come from the two halves."""
    halves = {w: m.groups() for w in words if (m := LETTERS_MARKS.match(w))}
    names = list(dict.fromkeys([w for w in words if w not in halves] + [p for pair in halves.values() for p in pair]))
    plain = [n for n in names if n.isalpha()]
    ids = dict(zip(plain, _word_ids(plain, path), strict=True))
    other = [n for n in names if not n.isalpha()]
    for name, enc in zip(other, _tokenizer(path).encode_batch_fast(other, add_special_tokens=False), strict=True):
        ids[name] = _packed(enc.ids)
    return ids | {w: ids[a] + ids[b] for w, (a, b) in halves.items()}


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case, as the tokenizer makes them, where Unicode leaves no doubt how."""
    doubtful = pc.or_(pc.match_substring_regex(texts, r"[^\x{0}-\x{FF}]"), pc.match_substring(texts, "<|"))
    return pc.if_else(doubtful, texts, pc.utf8_lower(texts))


def token_bytes(texts: pa.Array | list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, without special tokens.

    The tokenizer drops white space and never joins across it, so that the ids of a text are those
    of its words; each worker encodes a word once and looks up each word of a batch once.
    """
    texts = pc.fill_null(pa.array(texts, pa.string()), "")
    if not len(texts):
        return []
    held = _memory(path)
    if len(held[0].high) > REMEMBERED:
        held[0] = Memory()
    memory = held[0]
    split = pc.utf8_split_whitespace(_lowered(texts))
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = _hashes(distinct)
    places, sizes = memory.find(hashes)
    missing = np.flatnonzero(places < 0)
    if len(missing):
        new = [distinct[i] for i in missing.tolist()]
        ids = _encoded(new, path)
        each = [ids[w] for w in new]
        places[missing] = memory.put(hashes[missing], each)
        sizes[missing] = np.fromiter(map(len, each), np.int32, len(each)) // 4
    at = coded.indices.to_numpy(zero_copy_only=False)
    counts = sizes.astype(np.int64)[at]
    ends = np.concatenate(([0], np.cumsum(counts)))
    ids = memory.pool[np.repeat(places[at] - ends[:-1], counts) + np.arange(ends[-1])]
    cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
    out = [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
    for row in np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)).tolist():
        out[row] = _packed(_tokenizer(path).encode(texts[row].as_py(), add_special_tokens=False).ids)  # the tokenizer does not split there
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold ``GATHERED`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if rest := pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        yield rest[0]


def tokenize_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids): the pieces of each row's tokens, ``end_id`` last; ids are little-endian uint32."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end, width = _packed([end_id]), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packing", forget)
        for batch in gathered(batches):
            owners, pieces, ids = [], [], []
            for row, data in enumerate(token_bytes(batch.column(1), path)):
                data += end
                for n, at in enumerate(range(0, len(data), width)):
                    owners.append(row)
                    pieces.append(n)
                    ids.append(data[at : at + width])
            number = pa.array(pieces, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), number, pa.array([n * capacity for n in pieces], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[id_col, "piece", "start", "length", "ids"],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)


class SumIndex:
    """The sums of one, two and three lengths that occur, each with the combinations that make it."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.single = np.zeros(capacity + 1, bool)
        self.single[lengths] = True
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        fits = (a >= b) & (a + b <= capacity)
        a, b = a[fits], b[fits]
        order = np.lexsort((-a, a + b))
        self.first, self.second = a[order], b[order]
        self.start = np.searchsorted((a + b)[order], np.arange(capacity + 2))
        self.pair = self.start[1:] > self.start[:-1]  # whether a sum of two lengths
        # triples are named by their largest length and the pair that fills the rest
        self.triple = [np.zeros(0, np.int64)] * (capacity + 1)
        for total in range(3, capacity + 1):
            rest = total - lengths
            self.triple[total] = lengths[(rest >= 2) & self.pair[np.maximum(rest, 0)]]

    def pairs(self, total: int, left: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (larger, smaller) with that sum whose lengths are ``left``, the most unequal first."""
        own = slice(self.start[total], self.start[total + 1])
        a, b = self.first[own], self.second[own]
        known = (left[a] > 0) & (left[b] > 0)
        return list(zip(a[known].tolist(), b[known].tolist(), strict=True))

    def triples(self, total: int, left: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Triples with that sum whose lengths are ``left``, by their largest."""
        have = left[:total] > 0
        pair = np.convolve(have, have)[:total] > 0  # sums of two that are left
        for a in self.triple[total].tolist():
            if have[a] and pair[total - a]:
                for b, c in self.pairs(total - a, left):
                    if b <= a:
                        yield a, b, c


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ([(length, copies), ...], how often) that use up ``counts`` of each length.

    For each length from the longest down, the sum index gives the single lengths, pairs and triples that fill its
    gap exactly; each is consumed as often as its lengths are available.
    """
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] = n
    patterns: list[Pattern] = []

    def consume(*lengths: int) -> bool:
        need = Counter(lengths)
        times = min(int(c[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                c[x] -= k * times
            patterns.append((sorted(need.items(), reverse=True), times))
        return times > 0

    index = SumIndex(np.flatnonzero(c), capacity)
    if c[capacity]:
        consume(capacity)
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if not c[length]:
            continue
        if index.single[gap]:
            consume(length, gap)
        for find in (index.pairs, index.triples):
            for combination in find(gap, c) if c[length] else ():
                if all(c[x] for x in combination):
                    consume(length, *combination)
                if not c[length]:
                    break
    open_bins: dict[int, list[list]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(c[length])
        while left:
            gap = next((g for g in range(length, capacity) if open_bins.get(g)), None)
            if gap is None:
                each = min(capacity // length, left)
                bins, items = left // each, []
                gap = capacity
            else:
                bins, items = open_bins[gap].pop()
                each = min(gap // length, left)
                if (use := min(bins, left // each)) < bins:
                    open_bins[gap].append([bins - use, items])
                bins = use
            left -= bins * each
            open_bins[gap - each * length].append([bins, [*items, (length, each)]])
    patterns += [(items, n) for bins in open_bins.values() for n, items in bins]
    return patterns


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Of each length, rows (first slot, copies, first sequence, offset) in slot order."""
    out, base, used = defaultdict(list), 0, defaultdict(int)
    for items, times in patterns:
        offset = 0
        for length, copies in items:
            out[length].append((used[length], copies, base, offset))
            used[length] += times * copies
            offset += length * copies
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(df: DataFrame, order_by: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``df`` with sequence_id and offset. Its lengths are 1 to ``capacity``; ``order_by`` tells rows apart."""
    small_batches(df.sparkSession)
    df = df.drop("sequence_id", "offset")
    # the input's columns stay inside a struct, so that none has a name of ours
    rows = cut(df.select(F.struct("*").alias("row"), F.col(length_col).cast("long").alias("length")))
    counts = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    by_length = slots(plan(counts, capacity))
    salts = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        salts[length] = min(MOST_SALTS, -(-n // RANK_ROWS))
    many = F.element_at(F.array(*map(F.lit, salts.tolist())), F.col("length").cast("int") + 1)
    # seeded draws over the stored rows: equal rows too get different salts, and a task that is repeated draws the same
    keyed = cut(rows.withColumn("salt", F.floor(F.rand(SEED) * many)))
    sizes = keyed.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    own = Window.partitionBy("length", "salt").orderBy(*[F.col("row")[c] for c in order_by])
    ranked = keyed.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, off = np.zeros_like(n), np.zeros_like(n)
        for x in np.unique(n):
            at = n == x
            runs = by_length[int(x)]
            first, copies, base, offset = runs[np.searchsorted(runs[:, 0], r[at], "right") - 1].T
            seq[at] = base + (r[at] - first) // copies
            off[at] = offset + (r[at] - first) % copies * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.select("row", place(F.col("length"), F.col("rank") + F.col("base")).alias("place"))
    return placed.select("row.*", "place.sequence_id", "place.offset")
