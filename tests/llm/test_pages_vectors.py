"""WARC round trips, page text, top-k search."""

import io
import random
import time
import zlib

import numpy as np
import pytest
from gridloom.llm import html_text, topk, warc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    big = "é" * 150
    rows = [(i, f"http://x/{i}", random.Random(i % 9).choice("abc") * (40 * (i % 5))) for i in range(60)]
    rows += [(100, None, big), (99, "http://x/ a\r\nInjected: 1", big), (None, "u", big), (101, "", None), (101, "", "")]
    rows += [(None, "u", "lone" * 50), (7, "again", rows[7][2]), (200, "u", "WARC/1.1\r\n\r\n" * 5000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(3)
    found = warc.round_trip(table, "page_id", "url", "html").collect()
    got = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(brute.warc([(k, b) for k, _, b in rows]), key=str)
    bodies = {r.key: bytes(r.payload).decode() for r in found if r.record_type == "response" and r.key is not None}
    assert all(bodies[k] == (b or "") for k, _, b in rows if k in bodies)
    assert {r.url for r in found if r.key == 99} == {"http://x/%20a%0D%0AInjected:%201"}
    assert warc.round_trip(table.limit(0), "page_id", "url", "html").count() == 0


def test_normalised_members_stand_alone(spark, tmp_path):
    records = [warc.record(i, "u", b"x" * (i * 1000), "00", None) for i in range(50)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = packer.compress(b"".join(records)) + packer.flush()
    path = tmp_path / "whole.warc.gz"
    path.write_bytes(whole)
    made = warc.normalise(spark.createDataFrame([(str(path),)], "archive string"), f"file://{tmp_path}/out")
    row = made.first()
    members = open(row.members.removeprefix("file://"), "rb").read()
    entries = sorted(spark.read.schema(warc.INDEX).json(row.sidecar).collect(), key=lambda e: e.offset)
    assert [zlib.decompress(members[e.offset : e.offset + e.length], 31) for e in entries] == records
    assert sum(e.length for e in entries) == len(members) and row.n_records == 50
    assert list(warc.split_records(warc.inflate(io.BytesIO(members)))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(io.BytesIO(whole[:-500]))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><header class=site><a href=/>Home</a> My site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site a better place for all of its readers. Accept?</p></div>
<div class="ad">Buy now the best things that money can get in this town.</div><!-- <p>hidden</p> -->
<article><header><h1>A &amp; B&nbsp;title</h1></header><p>First   para
graph with <b>bold</b>, <a href=x>a link</a> and 1 < 2.<p>Second one.<br>Still&#33; <div class="share">Share on: <a>X</a></div>
<ul><li>Item one<li>Item two</ul><aside>Related stuff that nobody wants to read here at all.</aside><p>End.</p></article>
<div id=comments><h2>Comments</h2><p>Reader: I liked this a lot, thanks for the effort you made here!</p></div>
<form><p>Your name please, and your mail address too</p><input></form><footer>&copy; 2020 Someone, all rights kept</footer>"""


def test_main_text():
    want = ["A & B title", "First para graph with bold, a link and 1 < 2.", "Second one. Still!", "Item one", "Item two", "End."]
    assert html_text.main_text(PAGE, html_text.train()).split("\n") == want


def test_main_text_without_structure():
    prose = "This is a long paragraph of plain prose that goes on for a good while, as paragraphs of articles do."
    page = f"<div><a>Home</a></div><div><a>News</a></div><div>{prose}</div><div>{prose} More.</div><div><a>Next</a></div>"
    assert html_text.main_text(page, html_text.train()).split("\n") == [prose, prose + " More."]


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<!--", "<script>", "</p></div>", "<a href='x>", "<p>" * 3000, "&#0;&bogus;<b"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page, html_text.train()), str)


def test_tree_on_pages_it_has_not_seen():
    """Pages of another seed, with names of classes that no list knows."""
    unknown = {"ad": "zq1", "comments": "qx-rr", "notice": "vv", "sidebar": "lo"}
    draw, right, kept, main = random.Random(77), 0, 0, 0
    for _ in range(150):
        page = html_text.labelled_page(draw)
        for name, new in unknown.items():
            page = page.replace(f'class="{name}"', f'class="{new}"') if draw.random() < 0.3 else page
        found = html_text.blocks(page)
        chosen = html_text.classify(html_text.train(), html_text.features(found))
        truth = np.array([html_text.MAIN in b.text.split() for b in found])
        right, kept, main = right + (chosen & truth).sum(), kept + chosen.sum(), main + truth.sum()
    assert right / kept >= 0.97 and right / main >= 0.98


def test_tree_uses_words_links_and_neighbours():
    used, waiting = set(), [html_text.train()]
    while waiting:
        node = waiting.pop()
        if isinstance(node, html_text.Split):
            used.add(html_text.FEATURES[node.feature])
            waiting += [node.low, node.high]
    assert {"n_words", "link_density"} <= used and used & {"before_words", "before_density"} and used & {"after_words", "after_density"}


LONG = "This is a long paragraph of plain prose that goes on for a good while, as paragraphs of articles do. " * 4


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="story-header-search"><p>{LONG}</p></div>', LONG),
        (f'<article><div class="form-and-function"><p>{LONG}</p></div></article>', LONG),
        (f"<article><p><a title=don't href=x>one</a> two</p><p>{LONG}</p><p>it's</p></article>", f"one two\n{LONG.strip()}\nit's"),
        (f"<article><p>{LONG}<math><mi>x</mi></math> end</p></article>", f"{LONG}x end"),
        (f'<article><p>{LONG}</p><p title="never closed>And more of it.</p></article>', f"{LONG.strip()}\nAnd more of it."),
        (f"<article><p>{LONG} 1 <b c", f"{LONG} 1 <b c"),
        (f"<article><!--><p>{LONG}</p><!-- x --!><p>More of it here.</p></article>", f"{LONG.strip()}\nMore of it here."),
    ],
)
def test_no_text_is_lost(page, want):
    assert html_text.main_text(page, html_text.train()) == "\n".join(line.strip() for line in want.split("\n")).replace("  ", " ")


def test_a_slash_does_not_close_a_link_or_a_part():
    found = html_text.blocks("<div/><a href=http://e.org/>one two</a> three</div><svg/><p>four")
    assert [(b.text, b.link_words) for b in found] == [("one two three", 2), ("four", 0)]


BROKEN = ['<a x="' + "<b " * 20_000, '<a <b "x ' * 8000, "<div>" * 8000 + "x" + "</div>" * 8000, "<b>" + "<div>" * 8000 + "</b>" * 8000,
          "<" * 60_000, "<!--" * 15_000, "<a " + "=" * 60_000, "<a b='c" * 8000, "<a" + " " * 60_000, "<p>" * 20_000]


@pytest.mark.parametrize("page", BROKEN, ids=range(len(BROKEN)))
def test_broken_pages_take_linear_time(page):
    tree, times = html_text.train(), []
    for part in (page, page * 4):
        began = time.process_time()
        html_text.main_text(part, tree)
        times.append(time.process_time() - began)
    assert times[0] < 1 and times[1] < 10 * times[0] + 0.5


def plain_tag(page):
    """Name, closing, empty, attributes and end of the tag that opens ``page``, character by character."""
    at, closes = (2, True) if page[1] == "/" else (1, False)
    name, attributes = "", []
    while at < len(page) and page[at] not in " \n/>":
        name, at = name + page[at], at + 1
    while True:
        slash = False
        while at < len(page) and page[at] in " \n/":
            slash, at = page[at] == "/", at + 1
        if at == len(page):
            return None
        if page[at] == ">":
            return name, closes, slash, attributes, at + 1
        key, at = page[at], at + 1
        while at < len(page) and page[at] not in " \n/>=":
            key, at = key + page[at], at + 1
        value, ahead = "", at
        while ahead < len(page) and page[ahead] in " \n":
            ahead += 1
        if ahead < len(page) and page[ahead] == "=":
            at = ahead + 1
            while at < len(page) and page[at] in " \n":
                at += 1
            if at < len(page) and page[at] in "\"'" and page[at] in page[at + 1 :]:
                close = page.index(page[at], at + 1)
                value, at = page[at + 1 : close], close + 1
            else:
                while at < len(page) and page[at] not in " \n>":
                    value, at = value + page[at], at + 1
        attributes.append((key, value))


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["<", "</"]), st.text("id='\"/> \n=", max_size=14))
def test_tags_against_a_plain_reader(head, rest):
    page = f"{head}p{rest}"
    tag = html_text.Tokens(page).tag(html_text.MARKUP.match(page))
    want = plain_tag(page)
    if want is None:
        assert tag is None
    else:
        told = {}
        for key, value in want[3]:
            if key in html_text.TOLD:
                told.setdefault(key, value)
        assert tag == html_text.Tag(want[0], want[1], want[2], told, want[4])



def test_extract_table(spark):
    rows = [(1, "u", PAGE, 9), (None, None, None, 9), (1, "u", PAGE, 9), (2, "v", "<nav>x</nav>", 9)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    found = html_text.extract(table, "page_id", "html", ("url",)).collect()
    assert sorted((r.page_id or 0, len(r.text.split("\n")) if r.text else 0) for r in found) == [(0, 0), (1, 6), (1, 6), (2, 0)]
    assert html_text.extract(table.limit(0), "page_id", "html").count() == 0


def test_top_k_with_ties_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(400)]
    rows += [(i, (rng.integers(-300, 300) * np.array([1, 2, 0, -1])).tolist()) for i in range(400, 460)]
    rows += [(500, [0, 0, 0, 0]), (501, None), (None, [1, 1, 1, 1]), (7, rows[7][1]), (550, [1, None, 2, 3]), (600, [5, 5]), (601, [2, 1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<long>, rank int").repartition(4)
    found = topk.top_k(table, "id", "v", F.col("id") % 50 == 0, 5)
    want = brute.top_k([(i, v if v is None or None not in v else None) for i, v in rows], 5)
    assert sorted(map(tuple, found.collect())) == want
    assert topk.top_k(table.limit(0), "id", "v", F.col("id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_pruning_loses_nothing(spread):
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(20, 16))
    vectors = np.floor(256 * (centres[rng.integers(0, 20, 2000)] + spread * rng.normal(size=(2000, 16))) * rng.uniform(0.9, 1, (2000, 1)))
    queries = vectors[:60]
    scores = queries @ vectors.T
    floors = np.sort(scores, axis=1)[:, -40]
    ids = np.arange(2000)
    found = topk.search_block(ids[:60], queries, floors, ids, vectors, 10)
    for q in range(60):
        own = sorted(((-scores[q, i], i) for i in range(2000) if i != q))[:10]
        got = [(-s, i) for qid, i, s in zip(*found) if qid == q]
        assert got == [(s, i) for s, i in own if -s >= floors[q]]


def test_usable_vectors(spark):
    rows = [([1.0, 2.0],), (None,), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), ([],)]
    table = spark.createDataFrame(rows, "v array<float>").select(topk.usable(F.col("v")).alias("ok"))
    assert [r.ok for r in table.collect()] == [True, False, False, False, False, True]
    assert spark.range(1).select(topk.quantise(F.array(F.lit(-0.001), F.lit(0.5)))).first()[0] == [-1, 128]


def test_one_id_on_many_rows(spark):
    """More rows of one id than a block holds."""
    draw = np.random.default_rng(2)
    vectors = draw.integers(-3, 4, (9000, 4)).tolist()
    rows = [(50, v) for v in vectors] + [(100, [1, 2, 3, 1]), (7, [2, 2, 2, 2])]
    table = spark.createDataFrame(rows, "vec_id long, v array<int>")
    found = topk.top_k(table, "vec_id", "v", table.vec_id % 50 == 0, 5)
    want = []
    for q in (50, 100):
        own = min((v for i, v in rows if i == q), key=lambda v: (len(v), v))
        score = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(score)]
    assert sorted(map(tuple, found.collect())) == want
