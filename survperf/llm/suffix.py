"""Repeated passages by a distributed merge sort of sampled suffixes.

``repeats`` finds every byte of a text that lies in a string of ``LENGTH`` bytes that also starts anywhere else, in the same
text or another; ``remove`` takes these bytes out.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` has no such string; copies of a text and repeated
rows are texts of their own, so such a text goes whole if it is long enough; an id may be null or repeated; bytes that belong
to one character may be judged apart; an empty table gives an empty result. Only the named columns are read, so others
cannot clash.

Plan. Where to look: every string of ``LENGTH`` bytes has an anchor, the leftmost of its ``GRAM``-byte grams with the least hash, at
the same offset wherever the string occurs. Anchors that occur once in the corpus end the search for all strings that
have them, about one number for 85 bytes. What is left is sorted as suffixes at places on a grid of
``GRID`` bytes before each anchor: a string starts at most ``GRID`` - 1 bytes before such a place, and holds the ``CORE`` bytes after it.

The sort: each task sorts the suffixes of its texts into runs (equal ones once), cuts them by splitters of a bounded sample and
sends front-coded blocks: of each suffix the length it shares with the one before and the rest. A task of the next
stage merges the blocks of its range with a tree of losers that keeps, for each run, how much its next suffix shares
with the last one put out; suffixes are compared from there on, and only if these lengths are equal. Neighbours in
that order that share ``CORE`` bytes are a group; inside it strings are equal if the few bytes around the core are. A group holds what differs around one
core in memory, equal suffixes are told as they pass. Places go back to their texts as spans.

A text is known by 128 bits of hashes; it is shuffled by them twice, to meet its anchors and its spans.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.llm.common import cut, small_batches, take_worker

LENGTH, GRAM, GRID = 200, 32, 64
CORE, AROUND = LENGTH - GRID + 1, GRID - 1
#: Bytes of a suffix: the string at its place, and what stands before it.
WIDTH = LENGTH + AROUND
#: Strings of a text that are worked on together; below 2^24, as places are kept in so many bits.
PIECE = 1 << 21
#: Suffixes in a run, at most, and bytes of front-coded suffixes in a range, about.
RUN, RANGE = 1 << 16, 16 << 20
#: Texts in the sample for splitters, about, and suffixes of each, at most.
SAMPLE_TEXTS, SAMPLE_EACH = 512, 64
KEY = ["k1", "k2"]
BLOCK = "part int, n int, shared binary, rest binary, k1 binary, k2 binary, place binary, first binary, last binary, flags binary"
SPAN = "k1 long, k2 long, start long, stop long"
TWIN, KNOWN = 1, 2


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, data, k1, k2): each row's text as bytes, and the hashes that name it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.cast("binary").alias("data"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first, last) of the anchors of a piece of ``data`` after another: the strings that start at ``first`` to ``last`` have it."""
    every = np.frombuffer(data, np.uint8)
    for at in range(0, len(every) - LENGTH + 1, PIECE):
        h = every[at : at + PIECE + LENGTH - 1].astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        k = 1
        while k < GRAM:
            h = h[:-k] * np.uint64(0xBF58476D1CE4E5B9) + h[k:]
            h ^= h >> np.uint64(31)
            k *= 2
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 24) - 1)
        least, wide, w = (h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1, 1
        while 2 * w <= wide:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if w < wide:
            least = np.minimum(least[: len(least) - (wide - w)], least[wide - w :])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        place = place[first]
        yield h[place].view(np.int64), place + at, first + at, last + at


def with_anchors(rows: DataFrame) -> DataFrame:
    """(k1, k2, id, copies, h, again) of the distinct texts of ``rows`` that are long enough: their anchors' hashes, and whether the text has each more than once."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("suffix")
        for b in batches:
            out = []
            for data in b["data"]:
                h, n = np.unique(np.concatenate([a[0] for a in anchors(data)]), return_counts=True)
                out.append((h, n > 1))
            yield pd.DataFrame({"id": b["id"], "k1": b["k1"], "k2": b["k2"], "h": [o[0] for o in out], "again": [o[1] for o in out]})

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.filter(F.octet_length("data") >= LENGTH).mapInPandas(find, f"id {kind}, k1 long, k2 long, h array<long>, again array<boolean>")
    return found.groupBy(*KEY).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("h").alias("h"), F.first("again").alias("again"))


def wanted(texts: DataFrame) -> DataFrame:
    """(k1, k2, id, copies, h): the texts that have anchors in common with another text or with themselves, and these anchors."""
    each = texts.select(*KEY, F.inline(F.arrays_zip("h", "again")))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("h")
    held = each.join(common, "h").groupBy(*KEY).agg(F.collect_list("h").alias("h"))
    return texts.select(*KEY, "id", "copies").join(held, KEY)


def suffixes(data: bytes, held: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, place, first, last): the suffixes of ``data`` at the grid places of the anchors ``held``.

    A row has the ``LENGTH`` bytes from its place on and the ``AROUND`` bytes before it. The strings that start ``first`` to
    ``last`` bytes before the place are those to tell about.
    """
    padded = np.concatenate((np.zeros(AROUND, np.uint8), np.frombuffer(data, np.uint8), np.zeros(AROUND + 1, np.uint8)))
    columns = np.concatenate((np.arange(AROUND, AROUND + LENGTH), np.arange(AROUND)))
    for h, anchor, lo, hi in anchors(data):
        own = np.isin(h, held)
        anchor, near, far = anchor[own], (anchor - hi)[own], (anchor - lo)[own]
        steps = far // GRID - near // GRID + 1
        of = np.repeat(np.arange(len(anchor)), steps)
        cell = near[of] // GRID + np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
        place = anchor[of] - GRID * cell
        first = np.maximum(near[of] - GRID * cell, 0)
        last = np.minimum(far[of] - GRID * cell, GRID - 1)
        if most:
            place = place[:most]
        for at in range(0, len(place), 1 << 14):
            p = place[at : at + (1 << 14)]
            yield padded[p[:, None] + columns], p, first[at : at + (1 << 14)], last[at : at + (1 << 14)]


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal ones."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[new], np.concatenate((reach[new[1:] - 1], reach[-1:]))


class Run:
    """Suffixes of many texts, equal ones once; ``spans`` gets what is known to repeat already."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.meta: list[list[int]] = []  # k1, k2, place, first, last, flags

    def add(self, k1: int, k2: int, whole: bool, rows: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Spans of suffixes of this text that were seen before, also in it."""
        found, data, seen, meta = [], rows.tobytes(), self.seen, self.meta
        flags = KNOWN if whole else 0
        for i, (p, a, b) in enumerate(zip(place.tolist(), first.tolist(), last.tolist(), strict=True)):
            key = data[i * WIDTH : (i + 1) * WIDTH] + bytes((a, b))
            at = seen.setdefault(key, len(meta))
            if at == len(meta):
                meta.append([k1, k2, p, a, b, flags])
            else:
                meta[at][5] |= TWIN
                if not whole:
                    found.append((p - b, p - a + LENGTH))
        return found

    def blocks(self, splitters: list[bytes]) -> tuple[pd.DataFrame, list[tuple[int, int, int, int]]]:
        """The sorted run, front-coded and cut by ``splitters``, and the spans of its own suffixes that came again."""
        order = sorted(self.seen.items())
        keys = [k for k, _ in order]
        meta = np.array([self.meta[i] for _, i in order], np.int64).reshape(-1, 6)
        twin = (meta[:, 5] & TWIN > 0) & (meta[:, 5] & KNOWN == 0)
        spans = [(*m[:2], m[2] - m[4], m[2] - m[3] + LENGTH) for m in meta[twin].tolist()]
        rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, WIDTH + 2)[:, :WIDTH]
        shared = np.zeros(len(rows), np.uint16)
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), WIDTH)
        part = np.array([bisect_right(splitters, k[:CORE]) for k in keys], np.int64)
        out = []
        for at in np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []:
            end = int(np.searchsorted(part, part[at], "right"))
            own, m = shared[at:end].copy(), meta[at:end]
            own[0] = 0
            rest = rows[at:end][np.arange(WIDTH) >= own[:, None]]
            out.append((int(part[at]), end - at, own.tobytes(), rest.tobytes(), *[m[:, c].tobytes() for c in range(3)], *[m[:, c].astype(np.uint8).tobytes() for c in (3, 4, 5)]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")]), spans


def coded(run: DataFrame, row: list[tuple[int, int, int, int]], parts: int) -> DataFrame:
    """Spans as rows of the blocks' schema: part is the complement of where they go."""
    if not row:
        return run
    a = np.array(row, np.int64).reshape(-1, 4)
    extra = (~int(a[0, 0] % parts), len(a), a[:, 0].tobytes(), a[:, 1].tobytes(), a[:, 2].tobytes(), a[:, 3].tobytes(), b"", b"", b"", b"")
    return pd.concat([run, pd.DataFrame([extra], columns=[c.split()[0] for c in BLOCK.split(", ")])])


def front_coded(shared: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a block, each with what it shares with the one before."""
    last, at = b"", 0
    for n in np.frombuffer(shared, np.uint16).tolist():
        end = at + WIDTH - n
        last = last[:n] + rest[at:end]
        at = end
        yield last, n


def common(a: bytes, b: bytes, known: int) -> int:
    """How many first bytes two suffixes share; they share ``known``."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return WIDTH - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(suffix, shared, run) of sorted ``runs`` in one order: a tree of losers that never compares known prefixes again.

    ``known[i]`` is what the next suffix of run i shares with the last one put out. Of two such suffixes the one that
    shares more is the smaller one; only at equal lengths are bytes compared, those after it.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    head: list[bytes | None] = [next(r, (None, 0))[0] for r in runs] + [None] * (size - len(runs))
    known, loser = [0] * size, [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser of two runs."""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(head[a], head[b], known[a])
        if n == WIDTH or head[a][n] < head[b][n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        winners = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        for i, (_, lost) in enumerate(winners):
            loser[level + i] = lost
        winners = [w for w, _ in winners]
    best = winners[0]
    while head[best] is not None:
        yield head[best], known[best], best
        head[best], known[best] = next(runs[best], (None, 0))
        node = (size + best) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


def told(group: list[tuple[bytes, int, tuple[int, ...]]]) -> list[tuple[int, int, int, int]]:
    """Spans of a group's suffixes, which share the core; each is (suffix, how often, (k1, k2, place, first, last, flags))."""
    spans: list[tuple[int, int, int, int]] = []
    hits: list[list[int]] = [[] for _ in group]
    if len(group) == 2:
        (x, _, m), (y, _, o) = group
        left = int.from_bytes(x[LENGTH:]) ^ int.from_bytes(y[LENGTH:])
        before = AROUND if not left else ((left & -left).bit_length() - 1) // 8
        ahead = min(common(x, y, CORE), LENGTH)
        both = range(max(LENGTH - ahead, m[3], o[3]), min(before, m[4], o[4]) + 1)
        hits = [list(both), list(both)]
    elif len(group) > 2:
        for t in range(GRID):
            own = [i for i, (_, _, m) in enumerate(group) if m[3] <= t <= m[4]]
            around = [group[i][0][CORE : LENGTH - t] + group[i][0][WIDTH - t :] for i in own]
            n = Counter(around)
            for i, text in zip(own, around, strict=True):
                if n[text] > 1:
                    hits[i].append(t)
    for (_, _, m), ts in zip(group, hits, strict=True):
        if m[5] or not ts:
            continue
        cuts = [0, *[i for i in range(1, len(ts)) if ts[i] != ts[i - 1] + 1], len(ts)]
        spans += [(m[0], m[1], m[2] - ts[b - 1], m[2] - ts[a] + LENGTH) for a, b in zip(cuts, cuts[1:], strict=False)]
    return spans


def resolve(blocks: list[tuple]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Spans of one range's suffixes; ``blocks`` are its runs."""
    metas = [[np.frombuffer(b[c], np.int64).tolist() for c in (4, 5, 6)] + [list(b[c]) for c in (7, 8, 9)] for b in blocks]
    at = [0] * len(blocks)
    spans: list[tuple[int, int, int, int]] = []
    group: list[list] = []
    for suffix, shared, run in merge([front_coded(b[2], b[3]) for b in blocks]):
        m = [column[at[run]] for column in metas[run]]
        at[run] += 1
        if shared < CORE:
            if len(group) > 1:
                spans += told(group)
            group = []
            if len(spans) >= 1 << 14:
                yield spans
                spans = []
        elif shared == WIDTH and group[-1][2][3:5] == m[3:5]:
            # an equal one: both repeat, and one of them stays for the others
            twin = group[-1][2]
            spans += [(x[0], x[1], x[2] - x[4], x[2] - x[3] + LENGTH) for x in (twin, m) if not x[5]]
            twin[5] |= TWIN
            continue
        group.append([suffix, 1, m])
    if len(group) > 1:
        spans += told(group)
    yield spans


def splitters_of(rows: DataFrame, texts: DataFrame, many: int, parts: int) -> list[bytes]:
    """Cores that cut the suffixes into ``parts`` ranges of about one size, which divide no group, from a sample of the ``many`` texts."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r[:CORE].tobytes() for data, h in zip(b["data"], b["h"], strict=True) for group in suffixes(data, np.asarray(h, np.int64), SAMPLE_EACH) for r in group[0][:SAMPLE_EACH]]
            yield pd.DataFrame({"s": np.array([*found, None], object)[:-1]})

    step = max(1, many // SAMPLE_TEXTS)
    chosen = texts.filter(F.pmod(F.xxhash64(*KEY), F.lit(step)) == 0).limit(4 * SAMPLE_TEXTS)
    sample = met(rows, F.broadcast(chosen)).dropDuplicates(KEY).select("data", "h").mapInPandas(some, "s binary").orderBy(F.rand(1)).limit(SAMPLE_TEXTS * SAMPLE_EACH)
    found = sorted(bytes(r.s) for r in sample.collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def met(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` (k1, k2, id, ...) with their bytes, read from the row that has the id too."""
    on = [F.col(f"r.{c}") == F.col(f"t.{c}") for c in KEY] + [F.col("r.id").eqNullSafe(F.col("t.id"))]
    return rows.alias("r").join(texts.alias("t"), on).select("r.data", *[F.col(f"t.{c}") for c in texts.columns])


def spans_of(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(k1, k2, start, stop): spans that cover all repeated strings of ``texts``, which is the result of ``wanted``."""
    many, held = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("h")), F.lit(0))).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(held) * WIDTH * 2 // RANGE)
    splitters = splitters_of(rows, texts, many, parts)
    names = [c.split()[0] for c in SPAN.split(", ")]

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("suffix")
        run, spans = Run(), []
        for b in batches:
            for data, k1, k2, copies, h in zip(b["data"], b["k1"].tolist(), b["k2"].tolist(), b["copies"].tolist(), b["h"], strict=True):
                own = []
                for piece in suffixes(data, np.asarray(h, np.int64)):
                    own += run.add(k1, k2, copies > 1, *piece)
                    if len(run.meta) >= RUN:
                        block, more = run.blocks(splitters)
                        yield coded(block, more, parts)
                        run = Run()
                if own:
                    start, stop = merged(*np.array(own, np.int64).T)
                    spans += [(k1, k2, a, z) for a, z in zip(start.tolist(), stop.tolist(), strict=True)]
            if len(spans) >= 1 << 16:
                yield coded(pd.DataFrame(columns=[c.split()[0] for c in BLOCK.split(", ")]), spans, parts)
                spans = []
        block, more = run.blocks(splitters)
        yield coded(block, spans + more, parts)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("suffix")
        ranges: dict[int, list[tuple]] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                if row.part < 0:
                    yield pd.DataFrame({c: np.frombuffer(row[2 + i], np.int64) for i, c in enumerate(names)})
                else:
                    ranges.setdefault(row.part, []).append(tuple(row))
        for blocks in ranges.values():
            for spans in resolve(blocks):
                yield pd.DataFrame(np.array(spans, np.int64).reshape(-1, 4), columns=names)

    runs = met(rows, texts).select("data", *KEY, "copies", "h").mapInPandas(sort, BLOCK)
    to = F.when(F.col("part") < 0, F.bitwise_not("part")).otherwise(F.col("part"))
    return runs.repartitionById(parts, to).mapInPandas(join, SPAN)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, copies, spans) of the distinct texts with repeated bytes: maximal spans [start, stop), null if it goes whole."""
    small_batches(df.sparkSession)
    rows = keyed(df, id_col, text_col)
    texts = cut(with_anchors(rows))
    some = cut(wanted(texts))
    found = spans_of(rows, some).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    parts = some.filter("copies = 1").select(*KEY, "id", "copies").join(found, KEY)
    whole = texts.filter("copies > 1").select(*KEY, "id", "copies", F.lit(None).cast(parts.schema["spans"].dataType).alias("spans"))
    return parts.unionByName(whole)


def kept_of(data: Column, spans: Column) -> Column:
    """(kept, n_removed, n_spans): the bytes outside ``spans`` joined, how many go, and in how many maximal spans."""

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for datas, lists in batches:
            out = []
            for b, own in zip(datas, lists, strict=True):
                start, stop = merged(np.array([s["start"] for s in own], np.int64), np.array([s["stop"] for s in own], np.int64))
                ends = [0, *stop.tolist()]
                out.append((b"".join(b[a:z] for a, z in zip(ends, [*start.tolist(), len(b)], strict=True)), int((stop - start).sum()), len(start)))
            yield pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    return keep(data, spans)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row of ``df``; ``kept`` is the rest of the text's bytes, or their SHA-256 with ``digest``."""
    shown = (lambda c: F.sha2(c, 256)) if digest else (lambda c: c)
    found = cut(repeats(df, id_col, text_col))
    rows = keyed(df, id_col, text_col)
    part = met(rows, found.filter("copies = 1")).select(*KEY, kept_of(F.col("data"), F.col("spans")).alias("x")).select(*KEY, shown(F.col("x.kept")).alias("some"), F.col("x.n_removed").alias("r"), F.col("x.n_spans").alias("s"))
    none = shown(F.lit(b""))
    done = part.unionByName(found.filter("copies > 1").select(*KEY, none.alias("some"), F.lit(None).cast("long").alias("r"), F.lit(1).cast("long").alias("s")))
    n = F.octet_length("data").cast("long")
    every = rows.select("id", *KEY, n.alias("n_bytes"), shown(F.col("data")).alias("all"))
    zero = F.lit(0).cast("long")
    gone = F.when(F.col("s").isNull(), zero).otherwise(F.coalesce("r", "n_bytes"))
    return every.join(done, KEY, "left").select("id", "n_bytes", gone.alias("n_removed"), F.coalesce("s", zero).alias("n_spans"), F.coalesce("some", "all").alias("kept"))
