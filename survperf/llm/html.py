"""Main text of web pages: structure, and suffix arrays over each host's pages.

Pages are cut into blocks. Blocks of menus, headers, footers, sidebars, notices, adverts, forms
and comments go. If the page marks its article (article, main), its blocks are the text, less what the host
puts at the ends of its articles. Where a page marks none, boilerplate is what the host repeats: runs of at least
``RUN`` tokens, and whole shorter blocks, that occur on two or more distinct pages of the host are cut out, and
the unique runs of a block stay.

Articles quote and repeat each other, and most of what they repeat is content: where it stands and how many hold it decides.
Furniture is what nearly all articles of a host begin or end with. At an end where ``SHARE`` of the host's different articles,
``FEWEST`` or more, have a block that begins with the same run of ``RUN`` tokens, blocks go from that end inwards as far as they
are tiled by runs that so many of the articles hold in blocks that begin alike. Articles that such runs make up to more than a half stay whole: they
are versions of one story. No shorter block goes, and no heading: one ends the way inwards.

For that, each task builds suffix arrays over the token streams of the outermost blocks of the articles that it reads, about
``GROUP_BYTES`` of text at a time, host by host; they give the runs that begin a block and how many articles hold them, and a shuffle
adds these up. Only hosts whose articles share an end so far have more counted likewise: the runs that begin any block of their
different articles, and the tiles of the blocks whose first run is common. Whole texts are not shuffled.

On pages without an article runs are sought among the blocks of all pages of the host that lie outside a marked article. The pages of
a host are dealt to tasks in groups of about ``GROUP_BYTES`` of text; in each a suffix array over the
concatenated token streams finds the distinct runs of ``RUN`` tokens with the smallest and largest page that
holds them, and the groups' runs are merged by a shuffle. So no result depends on how a host is dealt.
Hosts whose pages all mark an article take no part in that.

Defined cases: null html is empty and has no text; a null url is the host ''; repeated rows each
get their text, and equal pages do not count as two for repetition, nor do equal articles; unclosed tags end with the
page; an empty table gives an empty result. Output columns are the id, url and text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survperf.llm.common import cut, small_batches, written

#: Tokens of a run.
RUN = 8
#: Share of a host's different articles that have a block at one end if it is furniture, and how many articles the host has at least.
SHARE, FEWEST = 0.75, 4
#: Text of the pages that one task works on.
GROUP_BYTES = 1 << 21
#: Hosts, or runs of hosts, that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: Elements whose content is no text.
_RAW = re.compile(r"<(script|style|template|noscript|svg|iframe|select|textarea|object|canvas)\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile("[\"'>]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_BLOCK = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILER = frozenset("nav header footer aside form menu dialog button head".split())
_MAIN = frozenset(("article", "main"))
_BOILER_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|site-?header|page-?header|comments?|disqus|respond|share|social|related|recommend\w*|widget|login|search)(?:$|[\s_-])", re.I)
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: A slash that closes a tag; one that ends a value without quotes does not.
_CLOSES = re.compile(r"""(?:\A|[\s"'])/\s*\Z""")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    boiler: bool
    main: bool
    #: Inside an article that a telling class or id marks, on it or around it.
    marked: bool = False
    heading: bool = False


class _Ends:
    """Where tags end: at the first '>' outside quotes. All answers are worked out together from the page's end, when first asked for."""

    def __init__(self, html: str) -> None:
        self.html, self.places, self.ends = html, None, []

    def after(self, at: int) -> int:
        """The end of a tag whose names begin at ``at``; -1 if it has none."""
        if self.places is None:
            self.places = [m.start() for m in _MARKS.finditer(self.html)]
            self.ends = [-1] * (len(self.places) + 1)
            nearest: dict[str, int] = {}
            for i in range(len(self.places) - 1, -1, -1):
                mark = self.html[self.places[i]]
                self.ends[i] = self.places[i] if mark == ">" else self.ends[nearest[mark] + 1] if mark in nearest else -1
                nearest[mark] = i
        return self.ends[bisect_left(self.places, at)]


def pieces_of(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) of the page's pieces: "text", "raw" elements, "open" and "close" tags with their attributes. In time linear in the page, however broken.

    Comments and declarations are left out; what is not closed goes on to the end; a '<' that begins nothing is text.
    """
    ends, at, n = _Ends(html), 0, len(html)

    def upto(mark: str, start: int) -> int:
        found = html.find(mark, start)
        return n if found < 0 else found + len(mark)

    none_left: dict[str, bool] = {}
    while at < n:
        begin = html.find("<", at)
        if begin != at:
            yield "text", "", html[at : begin if begin > 0 else n]
            if begin < 0:
                return
        at = begin
        if html.startswith("<!--", at):
            at = upto("-->", at + 4)
        elif html[at : at + 9].upper() == "<![CDATA[":
            end = upto("]]>", at + 9)
            yield "text", "", html[at + 9 : end].removesuffix("]]>").replace("&", "&amp;")
            at = end
        elif html.startswith(("<!", "<?"), at) and not none_left.get(">"):
            end = html.find(">", at)
            if end < 0:
                none_left[">"] = True
                continue
            at = end + 1
        elif (m := _TAG.match(html, at)) and (end := ends.after(m.end())) >= 0:
            raw = None if m[1] else _RAW.match(html, at)
            if raw:
                shut = re.compile(rf"</{raw[1]}\s*>", re.I).search(html, end + 1)
                yield "raw", raw[1], ""
                at = shut.end() if shut else n
            else:
                yield "close" if m[1] else "open", m[2].lower(), html[m.end() : end]
                at = end + 1
        else:
            yield "text", "", "<"
            at += 1


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order, character references decoded and white space folded.

    Elements that are boilerplate by their tag or role taint all they hold; a telling class or id does
    so outside articles and inside them. On an article or around it, it marks the article, as a comment or a teaser.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate by tag or role, article, by class or id
    out: list[Block] = []
    words: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(words))).strip()
        words.clear()
        if text:
            main = next((i for i, s in enumerate(stack) if s[2]), None)
            inside = any(s[3] and not s[2] for s in stack[main or 0 :])
            marked = main is not None and any(s[3] and (i < main or s[2]) for i, s in enumerate(stack))
            out.append(Block(text, any(s[1] for s in stack) or inside, main is not None, marked, any(s[0] in _HEADINGS for s in stack)))

    for kind, tag, content in pieces_of(html):
        if kind == "text":
            words.append(content)
            continue
        if kind == "raw":
            words.append(" ")
            continue
        if tag in _INLINE:
            if tag in ("br", "wbr", "img"):
                words.append(" " if tag == "br" else "")
            continue
        flush()
        if kind == "close":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag in _VOID or _CLOSES.search(content):
            continue
        if stack and stack[-1][0] in _CLOSED_BY_BLOCK and (tag == stack[-1][0] or stack[-1][0] == "p" or {tag, stack[-1][0]} <= {"dt", "dd"}):
            stack.pop()
        names = " ".join(x.strip("\"'") for x in _NAMES.findall(content))
        article_head = tag == "header" and any(s[2] for s in stack)
        main = tag in _MAIN or "main" in names.lower().split()
        hard = tag in _BOILER and not article_head or tag not in ("html", "body", *_MAIN) and bool(_BOILER_ROLE & set(names.lower().split()))
        stack.append((tag, hard, main, tag not in ("html", "body") and bool(_BOILER_NAME.search(names))))
    flush()
    return out


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array of ``x`` by prefix doubling."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while n > 1:
        second = np.full(n, -1, np.int64)
        if k < n:
            second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= 2 * n:
            break
    return order


def run_key(tokens: list[str], whole: bool) -> bytes:
    """Name of a run of tokens, or of a whole block shorter than a run."""
    return xxhash.xxh3_128_digest(("\0" if whole else "\1") + "\0".join(tokens))


def sorted_runs(streams: list[list[str]], run: int = RUN) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The streams' tokens, one more behind each stream; where runs of ``run`` tokens begin, equal runs side by side; the stream of each; and which of them are the first of their run."""
    ids: dict[str, int] = {}
    tokens: list[str] = []
    flat: list[int] = []
    for n, stream in enumerate(streams):
        flat += [ids.setdefault(t, len(ids)) for t in stream] + [-1 - n]  # a separator that occurs once
        tokens += [*stream, ""]
    x = np.array(flat, np.int64)
    order = suffix_array(x)
    # suffixes that share their first `run` tokens are neighbours
    ends = np.minimum.accumulate(np.where(x < 0, np.arange(len(x)), len(x))[::-1])[::-1]
    order = order[ends[order] - order >= run]
    heads = np.stack([x[order + i] for i in range(run)], 1)
    new = np.ones(len(order), bool)
    new[1:] = (heads[1:] != heads[:-1]).any(1)
    return tokens, order, -1 - x[ends[order]], np.flatnonzero(new)


def local_runs(streams: list[list[str]], owners: list[str], run: int = RUN) -> dict[bytes, tuple[str, str]]:
    """The distinct runs of ``run`` tokens and the whole shorter streams, with the smallest and largest owner of each."""
    names = sorted(set(owners))
    number = {o: i for i, o in enumerate(names)}
    found: dict[bytes, tuple[str, str]] = {}
    long, own = [], []
    for stream, who in zip(streams, owners, strict=True):
        if len(stream) < run:
            key = run_key(stream, True)
            low, high = found.get(key, (who, who))
            found[key] = min(low, who), max(high, who)
            continue
        long.append(stream)
        own.append(number[who])
    if not long:
        return found
    tokens, order, at, first = sorted_runs(long, run)
    owner = np.array(own)[at]
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    for start, lo, hi in zip(order[first].tolist(), low.tolist(), high.tolist(), strict=True):
        found[run_key(tokens[start : start + run], False)] = names[lo], names[hi]
    return found


def counted_runs(articles: list[list[str]], tiles: bool, run: int = RUN) -> dict[bytes, int]:
    """How many of the ``articles``, given as blocks, hold each of the runs of ``run`` tokens that begin a block, or of the ``tiles`` of blocks."""
    streams, owner = [], []
    for n, blocks in enumerate(articles):
        for tokens in (b.lower().split() for b in blocks):
            if len(tokens) >= run:
                streams.append(tokens)
                owner.append(n)
    if not streams:
        return {}
    tokens, order, at, first = sorted_runs(streams, run)
    size = np.array([len(s) for s in streams])
    place = order - (np.cumsum(size + 1) - size - 1)[at]
    wanted = (place == 0) | tiles & ((place % run == 0) | (place == size[at] - run))
    group = np.zeros(len(order), np.int64)
    group[first[1:]] = 1
    held = np.unique(np.cumsum(group)[wanted] * len(articles) + np.array(owner)[at][wanted])
    runs, counts = np.unique(held // len(articles), return_counts=True)
    return {run_key(tokens[i : i + run], False): n for i, n in zip(order[first[runs]].tolist(), counts.tolist(), strict=True)}


def tiles_of(low: list[str], run: int = RUN) -> list[bytes]:
    """The runs of ``run`` tokens one after another that hold all of a block, the last one up to its end; none of a shorter block."""
    return [run_key(low[at : at + run], False) for at in [*range(0, len(low) - run, run), len(low) - run] if at >= 0]


#: An article's blocks, and how many at its begin and at its end lie before or behind all headings.
Article = tuple[list[str], int, int]


def trimmed(article: Article, starts: set[bytes], stops: set[bytes], common: set[bytes]) -> list[str]:
    """An article's blocks without the furniture at its ends: ``starts`` and ``stops`` are the runs that begin a first and a last block, ``common`` the runs that tile furniture."""
    blocks, lead, tail = article
    lows = [b.lower().split() for b in blocks]
    tiles = [tiles_of(low) for low in lows]
    covered = [bool(t) and common.issuperset(t) for t in tiles]
    if 2 * sum(len(low) for low, c in zip(lows, covered, strict=True) if c) > sum(map(len, lows)):
        return blocks
    begin, end = 0, len(blocks)
    if starts.intersection(tiles[0][:1]):
        while begin < lead and covered[begin]:
            begin += 1
    if stops.intersection(tiles[-1][:1]):
        while end > len(blocks) - tail and covered[end - 1]:
            end -= 1
    return blocks[begin:end]


def ends_counted(articles: list[Article]) -> Iterator[tuple[int, dict[bytes, int]]]:
    """What ``counted_runs`` finds among the first (0) and the last (1) blocks of articles."""
    yield 0, counted_runs([blocks[: min(lead, 1)] for blocks, lead, _ in articles], False)
    yield 1, counted_runs([blocks[-1:] if tail else [] for blocks, _, tail in articles], False)


def begins_counted(articles: list[Article]) -> Iterator[tuple[int, dict[bytes, int]]]:
    """These and the runs that begin any block (2)."""
    yield from ends_counted(articles)
    yield 2, counted_runs([blocks for blocks, _, _ in articles], False)


def tiles_counted(articles: list[Article]) -> Iterator[tuple[int, dict[bytes, int]]]:
    """The tiles of all blocks (3)."""
    yield 3, counted_runs([blocks for blocks, _, _ in articles], True)


def begun_by(blocks: list[str], heads: set[bytes]) -> list[str]:
    """The blocks that begin with one of the runs ``heads``."""
    return [b for b in blocks if heads.intersection(tiles_of(b.lower().split()[:RUN]))]


def unique_runs(text: str, shared: set[bytes], run: int = RUN) -> str:
    """``text`` without the tokens that lie in shared runs."""
    words, low = text.split(), text.lower().split()
    if len(low) < run:
        return "" if run_key(low, True) in shared else text
    covered = np.zeros(len(low) + 1, np.int64)
    for at in range(len(low) - run + 1):
        if run_key(low[at : at + run], False) in shared:
            covered[at] += 1
            covered[at + run] -= 1
    left = np.cumsum(covered)[:-1] == 0
    return text if left.all() else " ".join(w for w, k in zip(words, left.tolist(), strict=True) if k)


def article_of(blocks: list[Block]) -> Article | None:
    """The article that a page marks, if it marks one. Marked articles are no part of it where another one stands beside them."""
    own = [b for b in blocks if b.main and not b.boiler]
    article = [b for b in own if not b.marked] or own
    if not article:
        return None
    headings = [i for i, b in enumerate(article) if b.heading] or [len(article), -1]
    return [b.text for b in article], headings[0], len(article) - 1 - headings[-1]


def main_texts(pages: list[str]) -> list[str]:
    """The main texts of pages of one host, in one task."""
    parsed = {p: blocks_of(p) for p in pages}  # equal pages count once
    streams = [(b.text.lower().split(), p) for p, blocks in parsed.items() for b in blocks if not b.main]
    runs = local_runs([s for s, _ in streams], [p for _, p in streams])
    shared = {k for k, (low, high) in runs.items() if low != high}
    articles = list({str(a): a for blocks in parsed.values() if (a := article_of(blocks))}.values())
    often = lambda counts: {k for k, n in counts.items() if n >= SHARE * len(articles)}
    starts, stops, heads = (often(counts) for _, counts in begins_counted(articles if len(articles) >= FEWEST else []))
    common = often(counted_runs([begun_by(a, heads) for a, _, _ in articles], True))
    texts = []
    for p in pages:
        article = article_of(parsed[p])
        texts.append(_bare_text([b.text for b in parsed[p] if not b.boiler], shared) if article is None else "\n\n".join(trimmed(article, starts, stops, common)))
    return texts


def _bare_text(blocks: list[str], shared: set[bytes]) -> str:
    return "\n\n".join(t for t in (unique_runs(b, shared) for b in blocks) if t)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row of ``pages``."""
    small_batches(pages.sparkSession)
    texts = T.ArrayType(T.StringType())
    kinds = {"id": pages.schema[id_col].dataType, "url": pages.schema[url_col].dataType, "host": T.StringType(), "page": T.StringType(), "article": T.StringType(), "own": texts, "lead": T.IntegerType(), "tail": T.IntegerType(), "size": T.LongType(), "outside": texts}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """article: name of a marked article; own, lead, tail: its parts, or own: the blocks that may be a page's text where it marks none; outside: the blocks that may tell boilerplate."""
        for b in batches:
            rows = []
            for html in b["html"]:
                blocks = blocks_of(html)
                article, outside = article_of(blocks), [x.text for x in blocks if not x.main]
                name = None if article is None else xxhash.xxh3_128_hexdigest(str(article))
                rows.append((xxhash.xxh3_128_hexdigest(html), name, *(article or ([x.text for x in blocks if not x.boiler], 0, 0)), sum(map(len, outside)) + 1, outside))
            parts = pd.DataFrame(rows, columns=["page", "article", "own", "lead", "tail", "size", "outside"], index=b.index, dtype=object)
            yield pd.concat([b[["id", "url", "host"]], parts], axis=1)

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    parsed, _ = written(read.mapInPandas(parse, T.StructType([T.StructField(k, t) for k, t in kinds.items()])))
    texts_of = article_texts(parsed.filter("article is not null").select("id", "url", "host", "article", "own", "lead", "tail"))
    bare = cut(parsed.filter("article is null").select("host").distinct())
    if not bare.isEmpty():
        own = bare_texts(parsed.withColumn("own", F.when(F.col("article").isNull(), F.col("own"))).join(_small(bare), "host", "left_semi"))
        texts_of = texts_of.unionByName(parsed.filter("article is null").select("id", "url", "host", "page").join(own, ["host", "page"]).select("id", "url", "text"))
    return texts_of.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def article_texts(marked: DataFrame) -> DataFrame:
    """(id, url, text) of pages that mark an article, with its name and parts."""
    most, counts = GROUP_BYTES, "host string, kind int, run binary, n long"

    def counted(count: Callable[[list[Article]], Iterator[tuple[int, dict[bytes, int]]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Rows of ``counts`` of what ``count`` finds among the different articles of a host in each group."""

        def rows(held: dict[str, dict[str, Article]]) -> pd.DataFrame:
            return pd.DataFrame([(host, kind, run, n) for host, articles in held.items() for kind, found in count(list(articles.values())) for run, n in found.items()], columns=["host", "kind", "run", "n"])

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, dict[str, Article]] = defaultdict(dict)
            size = 0
            for b in batches:
                for host, article, own, lead, tail in b[["host", "article", "own", "lead", "tail"]].itertuples(index=False):
                    held[host][article] = list(own), lead, tail
                    size += sum(map(len, own))
                    if size >= most:
                        yield rows(held)
                        held, size = defaultdict(dict), 0
            yield rows(held)

        return find

    whole = marked.select("id", "url", F.array_join("own", "\n\n").alias("text"))
    number = marked.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles")).filter(F.col("articles") >= FEWEST)
    number = _small(cut(number))
    outermost = marked.select("host", "article", F.array(F.element_at("own", 1), F.element_at("own", -1)).alias("own"), "lead", "tail")
    # an article on pages in several groups counts more than once here; that asks more hosts, which are counted exactly below
    ends = outermost.mapInPandas(counted(ends_counted), counts).groupBy("host", "kind", "run").agg(F.sum("n").alias("n"))
    asked = cut(ends.join(number, "host").filter(F.col("n") >= SHARE * F.col("articles")).select("host", "articles").distinct())
    if asked.isEmpty():
        return whole
    hosts = _small(asked)

    def often(articles: DataFrame, count: Callable[[list[Article]], Iterator[tuple[int, dict[bytes, int]]]]) -> DataFrame:
        """(host, kind, run) that ``SHARE`` of the different articles of a host hold."""
        runs = articles.dropDuplicates(["host", "article"]).mapInPandas(counted(count), counts).groupBy("host", "kind", "run").agg(F.sum("n").alias("n"))
        return cut(runs.join(hosts, "host").filter(F.col("n") >= SHARE * F.col("articles")).select("host", "kind", "run"))

    def by_host(runs: DataFrame, names: dict[str, int]) -> DataFrame:
        """The runs of each host; few are common to its articles, no more than 1 / SHARE of an article's, so they are broadcast for few hosts."""
        lists = runs.groupBy("host").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("run"))).alias(c) for c, k in names.items()])
        return F.broadcast(lists) if runs.count() <= MOST_BROADCAST else lists

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [begun_by(list(blocks), set(heads)) for blocks, heads in zip(b["own"], b["heads"], strict=True)]
            yield b[["host", "article"]].assign(own=pd.Series(own, index=b.index, dtype=object), lead=0, tail=0)

    of_asked = marked.join(hosts.select("host"), "host", "left_semi")
    begins = often(of_asked.select("host", "article", F.transform("own", lambda b: F.substring_index(b, " ", RUN)).alias("own"), "lead", "tail"), begins_counted)
    furnished = begins.filter("kind < 2").select("host").distinct()
    heads = by_host(begins.join(furnished, "host"), {"heads": 2})
    tiles = often(marked.select("host", "article", "own").join(heads, "host").mapInPandas(alike, "host string, article string, own array<string>, lead int, tail int"), tiles_counted)
    names = {"starts": 0, "stops": 1, "common": 3}
    few = by_host(begins.filter("kind < 2").unionByName(tiles), names)

    @F.pandas_udf("string")
    def text(own: pd.Series, lead: pd.Series, tail: pd.Series, starts: pd.Series, stops: pd.Series, common: pd.Series) -> pd.Series:
        parts = zip(own, lead, tail, starts, stops, common, strict=True)
        return pd.Series(["\n\n".join(b if c is None else trimmed((list(b), i, j), set(s), set(t), set(c))) for b, i, j, s, t, c in parts], dtype=object)

    return marked.join(few, "host", "left").select("id", "url", text("own", "lead", "tail", *names).alias("text"))


def _small(hosts: DataFrame) -> DataFrame:
    """``hosts``, broadcast while there are few: a shuffle by the host alone would leave a hot host in one task."""
    return F.broadcast(hosts) if hosts.count() <= MOST_BROADCAST else hosts


def bare_texts(parsed: DataFrame) -> DataFrame:
    """(host, page, text) of the distinct pages that mark no article; ``parsed`` has all pages of their hosts."""
    pages = cut(parsed.dropDuplicates(["host", "page"]).select("host", "page", "own", "size", "outside"))
    groups = cut(pages.groupBy("host").agg(F.ceil(F.sum("size") / GROUP_BYTES).cast("int").alias("groups")))
    dealt = cut(pages.join(_small(groups), "host").withColumn("part", F.pmod(F.xxhash64("page"), "groups").cast("int")).drop("groups"))

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        streams = [(t.lower().split(), page) for page, blocks in zip(pdf["page"], pdf["outside"], strict=True) for t in blocks]
        runs = local_runs([s for s, _ in streams], [p for _, p in streams])
        return pd.DataFrame([(key[0], key[1], k, lo, hi) for k, (lo, hi) in runs.items()], columns=["host", "part", "run", "low", "high"])

    runs = cut(dealt.groupBy("host", "part").applyInPandas(find, "host string, part int, run binary, low string, high string"))
    shared = runs.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    back = runs.join(shared.select("host", "run"), ["host", "run"], "left_semi").select("host", "part", "run")

    def clean(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        known = set(map(bytes, found["run"]))
        return pd.DataFrame({"host": key[0], "page": own["page"], "text": [_bare_text(list(b), known) for b in own["own"]]}, columns=["host", "page", "text"])

    bare = dealt.filter("own is not null").select("host", "part", "page", "own")
    return bare.groupBy("host", "part").cogroup(back.groupBy("host", "part")).applyInPandas(clean, "host string, page string, text string")
