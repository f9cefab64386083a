"""Marked articles, broken markup, long labelled texts, and entries that share a word."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from survperf.llm import html, media, quality, sharding, similar, simhash, toxicity

STORY = "<article><p>Story of the day.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        STORY + '<div id="comments"><li class="comment"><article class="comment-body"><p>nice post</p></article></li></div>',
        '<main><p>Story of the day.</p><article class="comment"><p>nice post</p></article></main>',
        STORY + '<div class="related"><article><p>Teaser</p></article></div>',
        STORY + '<div class="sidebar"><article><p>Aside</p></article></div>',
        '<div class="cookie-notice"><article><p>We use cookies</p></article></div>' + STORY,
    ],
)
def test_marked_articles_are_no_main_text(page):
    assert html.main_texts([f"<html><body>{page}</body></html>"]) == ["Story of the day."]


def test_a_marked_article_alone_is_the_text():
    assert html.main_texts(['<div class="widget"><article><p>All there is</p></article></div>']) == ["All there is"]
    assert html.main_texts(['<body class="has-sidebar"><article class="post"><p>One</p></article><article><p>Two</p></article></body>']) == ["One\n\nTwo"]


@pytest.mark.parametrize("broken", ['<a href="', "<a b", "<!", "<p class='", "<script ", "</a", '<p title="x" '])
def test_broken_markup_takes_linear_time(broken):
    page = broken * (1_000_000 // len(broken))
    began = time.process_time()
    html.blocks_of(page)
    assert time.process_time() - began < 5


def test_pieces_of_a_page():
    kinds = [k for k, _, _ in html.pieces_of('a<!-- <p> --><p class="x>y">b</p><script>if (a<b) "</p>"</script ><![CDATA[1 < 2]]> < <br/>')]
    assert kinds == ["text", "open", "text", "close", "raw", "text", "text", "text", "text", "open"]
    assert [b.text for b in html.blocks_of('<p title="a > b">x<p>y &lt; z')] == ["x", "y < z"]
    assert html.blocks_of("") == [] and [b.text for b in html.blocks_of("<")] == ["<"]


def test_a_long_labelled_text_does_not_empty_its_class(spark):
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(2000 if i % 2 and i < 8 else 5)) if i % 2 else "ok ok\nfine") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.fit(docs, labels, most_lines=1000) is not None


def test_a_stem_and_a_word_under_one_key():
    auto = toxicity.Model(entries={"idiot": 1.0, "=idiot": 3.0, "=fool": 2.0}, exceptions=("fool",)).automaton()
    assert toxicity.matches("idiots idiot", auto) == [(0, 5, 1.0), (7, 12, 3.0)]
    assert toxicity.matches("fool fools", auto) == []


def test_simhash_family_makes_few_links(spark):
    """A family makes links near its size, and families that only meet away from their hubs are joined too."""
    rng = np.random.default_rng(5)
    prints = set()
    for centre in (int(rng.integers(0, 1 << 62)), int(rng.integers(0, 1 << 62))):
        family = {centre}
        while len(family) < 2000:
            family.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
        prints |= family
    # a path of steps of three bits, on which a hub reaches its neighbours alone
    at = int(rng.integers(0, 1 << 62))
    for k in range(18):
        prints.add(at)
        at ^= 7 << 3 * k
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    whole, few = simhash.links(df), simhash.star_links(df).collect()
    assert {tuple(r) for r in few} <= {tuple(r) for r in whole.collect()}
    # each member is tried in at most as many blocks, with three hubs in each
    assert len(few) < 12 * len(signed) < whole.count()
    want, got = (dict(map(tuple, simhash.components(e).collect())) for e in (whole, spark.createDataFrame(few, "a long, b long")))
    assert got == want


def test_shards_in_few_lanes(spark):
    """Many buckets in few partitions: the same order under other session partitions, each record once."""
    rows = spark.range(3000).selectExpr("id", "repeat('x', cast(id % 50 as int)) as text")
    before, got, plans = spark.conf.get("spark.sql.shuffle.partitions"), [], []
    try:
        for partitions, df in (("4", rows), ("7", rows.repartition(5))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got.append(sorted((r.shard, r.slot, r.id) for r in sharding.shuffle_into_shards(df, bucket_bytes=1024, lanes=3).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
    assert [(s, n) for s, n, _ in got[0]] == sorted((k % 8, k // 8) for k in range(3000))
    order = [i for _, _, i in sorted(got[0], key=lambda r: (r[1], r[0]))]
    assert sorted(order) == list(range(3000))
    # a uniform order: about half of the neighbours ascend, and places are not tied to ids
    assert 1350 < sum(a < b for a, b in zip(order, order[1:])) < 1650
    assert abs(np.corrcoef(order, np.arange(3000))[0, 1]) < 0.1


def test_shards_of_maps(spark):
    rows = [(1, {"b": 2, "a": 1}, [{"k": 1}, None], ({"x": 1},)), (1, {"a": 1, "b": 2}, [{"k": 1}, None], ({"x": 1},)), (2, None, None, None), (3, {}, [], (None,)), (3, {"a": None}, [{}], ({},))]
    df = spark.createDataFrame(rows, "id long, m map<string,long>, a array<map<string,long>>, s struct<z:map<string,long>>")
    got = sharding.shuffle_into_shards(df, least_buckets=2, lanes=1)
    assert got.schema["m"].dataType == df.schema["m"].dataType and got.columns == [*df.columns, "shard", "slot"]
    show = lambda r: str((r.id, r.m and sorted(r.m.items()), r.m is None, r.a, r.s))
    assert sorted(map(show, got.collect())) == sorted(map(show, df.collect()))


def test_media_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "ab", "own", "row", 5)], "doc_id long, text string, _m string, row string, made int")
    row = media.with_media(df).first()
    assert (row._m, row.row, row.made, row.n_bytes, len(row.payload)) == ("own", "row", 5, 2, 64)


def test_only_records_that_may_repeat_are_shuffled_to_be_counted(spark):
    rows = spark.range(2000).selectExpr("struct(id, repeat('x', cast(id % 50 as int)) as text) as row")
    plan = sharding.scatter(rows, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    both = rows.unionAll(rows.filter("row.id % 500 = 0")).unionAll(rows.filter("row.id = 500"))
    got = sorted((r.row.id, r.nth) for r in sharding.scatter(both, 4).collect())
    assert got == sorted([(k, 1) for k in range(2000)] + [(k, 2) for k in (0, 500, 1000, 1500)] + [(500, 3)])


def test_near_copies_are_met_by_their_fingerprints_first(spark):
    base = [f"w{i}" for i in range(400)]
    texts = {k: " ".join("x" if i == 7 * k else w for i, w in enumerate(base)) for k in range(1, 6)} | {9: "apart from all others here"}
    df = spark.createDataFrame([*texts.items(), (10, texts[1])], "doc_id long, text string")
    sets = similar.distinct_sets(df.select("doc_id", similar.with_set(F.col("text"), np.zeros(0, np.int64)).alias("s")).select("doc_id", "s.*"))
    rows = {r.key: r for r in sets.collect()}
    assert sets.count() == len(rows) == 6
    linked = {(a, b) for a in rows for b in rows if a < b and ((rows[a].fp ^ rows[b].fp) & (1 << 64) - 1).bit_count() <= 3}
    got = {tuple(r) for r in similar.print_pairs(sets).collect()}
    assert got and got <= linked
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == [1, 9]


NOTICE = "Sign up today for the weekly letter of our newsroom"
ABOUT = "All of our stories are written and checked by people who live here"
QUOTE = "what one article repeats of another is content and stays where it is"


def host_pages(n, blocks_of):
    """Pages of ``n`` different articles; ``blocks_of`` puts the story's blocks among others."""
    story = lambda i: [f"Story {i}", *(f"paragraph {k} of story {i} tells of {'abcdefgh'[k]} and of nothing else at all" for k in range(4))]
    return [f"<body><nav><li>Home</nav><article>{''.join(f'<p>{b}</p>' for b in blocks_of(i, story(i)))}</article><footer>us</footer></body>" for i in range(n)], [story(i) for i in range(n)]


def furnished_host():
    """(page, main text) of a host that ends three of four articles with two notices and begins all with one."""
    pages, stories = host_pages(8, lambda i, s: [ABOUT.upper(), *s[:2], *[QUOTE] * (i > 0), *s[2:], *([NOTICE, ABOUT] if i % 4 else [ABOUT, NOTICE][:i])])
    for i, s in enumerate(stories):
        s[2:2] = [QUOTE] * (i > 0)
    stories[4] += [ABOUT, NOTICE]  # the host does not end its articles like this
    return [(p, "\n\n".join(s)) for p, s in zip(pages, stories, strict=True)]


def test_html_suffix_array_decides_in_articles(spark, monkeypatch):
    texts, want = zip(*furnished_host(), strict=True)
    assert html.main_texts(list(texts)) == list(want)
    other, kept = host_pages(3, lambda i, s: [*s, NOTICE])  # too few articles to tell
    rows = [(i, f"https://H.example/{i}", p) for i, p in enumerate(texts)] + [(99, "https://h.example/copy", texts[2])] + [(50 + i, "http://other.example/", p) for i, p in enumerate(other)]
    answers = [*enumerate(want), (99, want[2]), *((50 + i, "\n\n".join([*s, NOTICE])) for i, s in enumerate(kept))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size, most in ((html.GROUP_BYTES, html.MOST_BROADCAST), (64, 0)):
        monkeypatch.setattr(html, "GROUP_BYTES", size)
        monkeypatch.setattr(html, "MOST_BROADCAST", most)
        assert sorted((r.page_id, r.text) for r in html.extract(df.repartition(3)).collect()) == sorted(answers)


def test_html_what_articles_share_stays(spark):
    """Passages in the middle, ends that fewer share, copies of articles, versions of one story, short last blocks."""
    pages, stories = host_pages(8, lambda i, s: [*s[:3], NOTICE, *s[3:], *[ABOUT] * (i < 5)])
    want = ["\n\n".join([*s[:3], NOTICE, *s[3:], *[ABOUT] * (i < 5)]) for i, s in enumerate(stories)]
    assert html.main_texts(pages) == want
    df = spark.createDataFrame([(k, f"http://h.example/{i}", p.replace("us", f"us {k}")) for i, p in enumerate(pages) for k in range(9 if i < 5 else 1)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(df).collect()} == set(want)
    versions, _ = host_pages(6, lambda i, s: [f"as of {i} o'clock", *[f"{QUOTE} {k}" for k in range(3)], *[NOTICE] * 3])
    assert [t.count(NOTICE) for t in html.main_texts(versions)] == [3] * 6
    titled = [f"<article><h1>{NOTICE}</h1><p>{s[1]}</p><p>{s[2]}</p><h2>Sources</h2><p>{ABOUT}</p></article>" for s in stories]
    assert html.main_texts(titled) == ["\n\n".join([NOTICE, s[1], s[2], "Sources"]) for s in stories]
    assert html.main_texts([p.replace("<h2>Sources</h2>", "").replace(ABOUT, f"<h2>{ABOUT}</h2>") for p in titled])[0].count(ABOUT) == 1
    shared, stories = host_pages(6, lambda i, s: [*s, NOTICE, "Share"])
    assert html.main_texts(shared) == ["\n\n".join([*s, NOTICE, "Share"]) for s in stories]


def test_html_counted_runs():
    """The suffix array's counts against a search without it."""
    rng = np.random.default_rng(7)
    articles = [[" ".join(f"w{x}" for x in rng.integers(0, 2, rng.integers(1, 14))) for _ in range(rng.integers(0, 4))] for _ in range(40)]
    for tiles in (False, True):
        held = {}
        for n, blocks in enumerate(articles):
            for t in (b.split() for b in blocks):
                for key in html.tiles_of(t, 4)[: None if tiles else 1]:
                    held.setdefault(key, set()).add(n)
        assert html.counted_runs(articles, tiles, 4) == {k: len(v) for k, v in held.items()}
    assert html.counted_runs([], True) == html.counted_runs([["a b"]], False) == {}
