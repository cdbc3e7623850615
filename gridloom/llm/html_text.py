"""Main text of web pages: flat text blocks, classified by a small decision tree.

Markup is cut into blocks at block-level tags. A block is described by its word count and link density, those of its
neighbours, and what its open elements are (list items, headings, frames of the page, named parts). The tree is grown
from a small labelled table: the blocks of pages that are made here, whose parts are known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard, by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mrow ms mspace msqrt mroot mstyle msub msubsup msup mtext munder munderover".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "applet audio button canvas datalist embed head iframe map noembed noframes noscript object optgroup option "
    "script select style svg template textarea title video xmp".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
FRAME = frozenset("nav menu footer aside form dialog fieldset".split())
FOREIGN = frozenset("svg math".split())  # these alone may close themselves
CLOSED_BY_BLOCK = frozenset(["p"])  # a block-level tag ends an open paragraph
SELF_CLOSING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}

# Words in class, id and role that name a part of a page.
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners billboard breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown feedback foot footer "
    "form gdpr header hidden legal login masthead menu menubar menus modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup privacy promo promoted promotion reader recommended related "
    "replies reply respond rss search share sharing sidebar signup sidenav skip social sponsor sponsored sponsors "
    "subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
ARTICLE_WORDS = frozenset("article articlebody body content entry main maincontent post postbody prose story text".split())

# What opens with ``<``: a comment, a declaration or the like, or the name of a tag. No form can backtrack.
MARKUP = re.compile(
    r"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![a-zA-Z>]))|(?P<empty>/>)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+))"
)
COMMENT_END = re.compile(r"--!?>")
GAP = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"(=?[^\s/>=]*+)(?:\s*+=\s*+)?+")
HAS_VALUE = re.compile(r"=\s*+\Z")
BARE = re.compile(r"[^\s>]*+")
TOLD = frozenset("class id role hidden aria-hidden style".split())
WORD = re.compile(r"[A-Za-z]+")
SPACES = re.compile(r"\s+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dd dt".split())
FRAME_ROLES = frozenset("navigation contentinfo complementary banner search".split())


class Tag(NamedTuple):
    name: str
    closes: bool
    empty: bool  # a slash before its end
    attributes: dict[str, str]
    end: int


class Tokens:
    """Tags of a page, read forward only. Text that looks like a tag but never ends is text."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()  # quotes and ends that do not come again

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag(self, head: re.Match) -> Tag | None:
        """The tag whose name ``head`` matched; None if the page ends within it.

        A quote that nothing closes opens no value: the value is then the word it begins.
        """
        page, at, attributes = self.page, head.end(), {}
        if self.find(">", at) < 0:
            return None
        while True:
            gap = GAP.match(page, at)
            at = gap.end()
            if at >= len(page):
                return None
            if page[at] == ">":
                return Tag(head["name"].lower(), bool(head["close"]), gap.group().endswith("/"), attributes, at + 1)
            found = ATTRIBUTE.match(page, at)
            name, value, at = found[1].lower(), "", found.end()
            if HAS_VALUE.search(found.group()) and found.end() > found.end(1):
                quote = page[at : at + 1]
                close = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
                if close >= 0:
                    value, at = page[at + 1 : close], close + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare.group(), bare.end()
            if name in TOLD:
                attributes.setdefault(name, value)


class Block(NamedTuple):
    text: str
    n_words: int
    link_words: int
    n_items: int  # list items and cells around the block
    framed: int  # open elements that are a frame of the page by name or role
    junk: int  # open elements whose class or id names such a part
    article: int  # open elements that are, or name, the main text
    heading: int


class Element(NamedTuple):
    """An open element, with counts over it and all that are open around it."""

    name: str
    blocks: int
    hidden: int
    links: int
    items: int
    framed: int
    junk: int
    article: int
    heading: int


ROOT = Element("", 0, 0, 0, 0, 0, 0, 0, 0)


def part_named(value: str) -> tuple[bool, bool]:
    """Whether a class or id names a part besides the main text, and whether it names the main text.

    A name counts by its last word, or by half of its words or more; one with a word for the main text is not another
    part, as in "entry-header".
    """
    junk = article = False
    for name in value.split():
        words = [w.lower() for w in WORD.findall(HUMP.sub(" ", name))]
        if any(w in ARTICLE_WORDS for w in words):
            article = True
        elif words and (words[-1] in JUNK_WORDS or 2 * sum(w in JUNK_WORDS for w in words) >= len(words)):
            junk = True
    return junk, article


def opened(tag: Tag, around: Element) -> Element:
    name, told = tag.name, tag.attributes
    hidden = name in HIDDEN or "hidden" in told or told.get("aria-hidden", "").lower() == "true"
    hidden |= "style" in told and bool(INVISIBLE.search(told["style"]))
    junk, article = part_named(f"{told.get('class', '')} {told.get('id', '')}")
    if name in ("html", "body"):  # they hold all parts
        junk = article = False
    article |= name in ("article", "main")
    framed = name in FRAME or name == "header" and not around.article or told.get("role", "").lower() in FRAME_ROLES
    return Element(
        name,
        around.blocks + (name not in INLINE),
        around.hidden + hidden,
        around.links + (name == "a"),
        around.items + (name in ITEMS),
        around.framed + framed,
        around.junk + junk,
        around.article + article,
        around.heading + (name in HEADINGS),
    )


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, in time linear in the page. Unclosed and stray tags are tolerated."""
    found: list[Block] = []
    stack: list[Element] = [ROOT]
    open_at: dict[str, list[int]] = {}
    parts: list[tuple[str, bool]] = []
    tokens = Tokens(page)

    def flush() -> None:
        if not parts:
            return
        text = SPACES.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text:
            e = stack[-1]
            links = sum(len(html.unescape(p).split()) for p, linked in parts if linked)
            found.append(Block(text, len(text.split()), links, e.items, e.framed, e.junk, e.article, e.heading))
        parts.clear()

    def pop() -> None:
        open_at[stack.pop().name].pop()

    def leave(depth: int) -> None:
        if stack[-1].blocks > stack[depth - 1].blocks:
            flush()
        while len(stack) > depth:
            pop()

    at, start, end = 0, 0, len(page)  # text from ``start`` on is not taken yet

    def take(until: int) -> None:
        if until > start and not stack[-1].hidden:
            parts.append((page[start:until], stack[-1].links > 0))

    while (at := tokens.find("<", at)) >= 0:
        head = MARKUP.match(page, at)
        if not head:
            at += 1
            continue
        if head["name"]:
            tag = tokens.tag(head)
            if tag is None:  # the page ends within it
                break
            after = tag.end
        else:
            tag = None
            if head["comment"]:
                close = head.end() + 1 if page.startswith(">", head.end()) else head.end() + 2 if page.startswith("->", head.end()) else None
                if close is None:
                    stop = COMMENT_END.search(page, head.end())
                    close = stop.end() if stop else end
                after = close
            elif head["empty"]:
                after = head.end()
            else:
                close = tokens.find(">", head.end())
                after = close + 1 if close >= 0 else end
        take(at)
        start = at = after
        if tag is None:
            continue
        name = tag.name
        if tag.closes:
            places = open_at.get(name)
            if places and not (name in INLINE and stack[-1].blocks > stack[places[-1]].blocks):
                leave(places[-1])
            elif name not in INLINE:
                flush()
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name not in INLINE:
            flush()
            ends = SELF_CLOSING.get(name, CLOSED_BY_BLOCK)
            while stack[-1].name in INLINE:  # formatting does not span blocks
                pop()
            if stack[-1].name in ends or stack[-1].name in CLOSED_BY_BLOCK:
                pop()
        if name in VOID or tag.empty and name in FOREIGN:
            continue
        open_at.setdefault(name, []).append(len(stack))
        stack.append(opened(tag, stack[-1]))
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = close.start() if close else end
            take(at)
            start = at
    take(end)
    flush()
    return found


FEATURES = (
    "n_words", "link_density", "before_words", "before_density", "after_words", "after_density",
    "items", "framed", "junk", "article", "heading",
)


def features(page: list[Block]) -> np.ndarray:
    """One row per block, in the order of ``FEATURES``."""
    own = np.array([(b.n_words, b.link_words / b.n_words) for b in page], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    rest = np.array([b[3:] for b in page], float).reshape(-1, 5)
    return np.hstack([own, before[: len(own)], after[: len(own)], rest])


# The labelled table is made from pages of known parts. Their words tell the label and nothing else; names of classes
# are drawn so that most parts tell nothing by them, and some mislead.
MAIN, OTHER = "main", "side"
PLAIN_NAMES = ("c1", "col-2", "x", "grid item", "block", "css-1a2b", "wrap", "inner left", "row", "box7")
TABLE_PAGES = 600


def labelled_page(draw: random.Random) -> str:
    """A page of menus, notices, adverts, an article, comments and footers; words of the article are ``MAIN``."""

    def words(n: int, kind: str, links: float = 0.0) -> str:
        return " ".join(f"<a href=x>{kind}</a>" if draw.random() < links else kind for _ in range(n))

    def named(*names: str, told: float = 0.5) -> str:
        chosen = draw.choice(names) if names and draw.random() < told else draw.choice(PLAIN_NAMES)
        return f' class="{chosen}"' if told == 1.0 or draw.random() < 0.9 else ""

    def menu() -> str:
        items = [words(draw.randint(1, 3), OTHER, 1.0) for _ in range(draw.randint(3, 9))]
        if draw.random() < 0.6:
            body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        else:
            body = "".join(f"<div>{i}</div>" for i in items)
        tag = draw.choice(("nav", "div", "div"))
        return f"<{tag}{named('menu', 'navbar', 'breadcrumbs')}>{body}</{tag}>"

    def related() -> str:
        return f"<div{named()}><p>{words(draw.randint(15, 60), OTHER, draw.choice((0.5, 0.8, 1.0)))}</p></div>"

    def aside() -> str:
        body = "".join(f"<p>{words(draw.randint(3, 18), OTHER, draw.choice((0.0, 0.0, 0.6)))}</p>" for _ in range(draw.randint(1, 3)))
        tag = draw.choice(("aside", "div", "form"))
        names = ("ad", "sidebar", "cookie-notice", "widget", "newsletter", "share")
        return f"<{tag}{named(*names, told=1.0 if tag == 'div' else 0.5)}>{body}</{tag}>"

    def comments() -> str:
        body = "".join(f"<div><b>{words(1, OTHER)}</b><p>{words(draw.randint(3, 45), OTHER)}</p></div>" for _ in range(draw.randint(1, 4)))
        return f"<div{named('comments', 'comment-list', 'replies', told=1.0)}><h3>{words(1, OTHER)}</h3>{body}</div>"

    def article() -> str:
        body = [f"<h1>{words(draw.randint(2, 9), MAIN)}</h1>"]
        for _ in range(draw.randint(2, 9)):
            kind = draw.random()
            if kind < 0.7:
                body.append(f"<p>{words(draw.choice((draw.randint(1, 15), draw.randint(20, 90))), MAIN, draw.choice((0.0, 0.0, 0.1)))}</p>")
            elif kind < 0.8:
                body.append(f"<h2>{words(draw.randint(1, 6), MAIN)}</h2><p>{words(draw.randint(25, 70), MAIN)}</p>")
            elif kind < 0.9:
                body.append("<ul>" + "".join(f"<li>{words(draw.randint(2, 14), MAIN)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
            else:
                body.append(aside())
        tag = draw.choice(("article", "main", "div", "div"))
        if tag == "div":  # nothing but the prose tells: no short lines at the edges
            body = [f"<p>{words(draw.randint(17, 90), MAIN, draw.choice((0.0, 0.08)))}</p>" for _ in range(draw.randint(2, 7))]
        text = "".join(body)
        if draw.random() < 0.15:  # a name that misleads, around prose
            long = "".join(f"<p>{words(draw.randint(50, 120), MAIN)}</p>" for _ in range(draw.randint(2, 4)))
            text += f'<div class="{draw.choice(("notice", "form", "widget", "banner"))}">{long}</div>'
        return f"<{tag}{named('post', 'entry', 'story')}>{text}</{tag}>"

    def foot() -> str:
        tag = draw.choice(("footer", "footer", "div"))
        return f"<{tag}{named('footer', 'copyright', told=1.0 if tag == 'div' else 0.5)}>{words(draw.randint(3, 30), OTHER, draw.choice((0.0, 0.3)))}</{tag}>"

    top = f"<header>{words(draw.randint(1, 6), OTHER)}</header>" if draw.random() < 0.5 else ""
    parts = [top, menu(), *([aside()] if draw.random() < 0.7 else []), article()]
    parts += [part() for part in (related, comments, aside, menu) if draw.random() < 0.4]
    return f"<body>{''.join(parts)}{foot()}</body>"


def labelled_rows(n_pages: int = TABLE_PAGES, seed: int = 1) -> np.ndarray:
    """The labelled table: the features of every block, and whether it is main text."""
    draw, rows = random.Random(seed), []
    for _ in range(n_pages):
        page = blocks(labelled_page(draw))
        truth = np.array([MAIN in b.text.split() for b in page], float)
        rows.append(np.hstack([features(page), truth[:, None]]))
    return np.vstack(rows)


class Split(NamedTuple):
    """Rows with ``feature <= limit`` go to ``low``; leaves are the shares of main text."""

    feature: int
    limit: float
    low: Split | float
    high: Split | float


def grow(rows: np.ndarray, truth: np.ndarray, depth: int, least: int = 2) -> Split | float:
    """CART by Gini impurity, with ``least`` rows in a leaf; ties go to the earlier feature and the smaller limit."""
    share, n = float(truth.mean()), len(truth)
    if depth == 0 or share in (0.0, 1.0) or n < 2 * least:
        return share
    best = None
    for feature in range(rows.shape[1]):
        order = np.argsort(rows[:, feature], kind="stable")
        values, ones = rows[order, feature], np.cumsum(truth[order])
        at = np.arange(1, n)
        allowed = (values[1:] > values[:-1]) & (at >= least) & (n - at >= least)
        at = at[allowed]
        if not len(at):
            continue
        low, high = ones[at - 1], ones[-1] - ones[at - 1]
        cost = low * (1 - low / at) + high * (1 - high / (n - at))
        k = int(cost.argmin())
        if best is None or cost[k] < best[0] - 1e-9:
            best = float(cost[k]), feature, float(values[at[k] - 1] + values[at[k]]) / 2
    if best is None or best[0] > n * share * (1 - share) - 1e-9:
        return share
    _, feature, limit = best
    low = rows[:, feature] <= limit
    return Split(feature, limit, grow(rows[low], truth[low], depth - 1, least), grow(rows[~low], truth[~low], depth - 1, least))


@cache
def train(n_pages: int = TABLE_PAGES, depth: int = 16) -> Split | float:
    data = labelled_rows(n_pages)
    return grow(data[:, :-1], data[:, -1], depth)


def classify(tree: Split | float, rows: np.ndarray) -> np.ndarray:
    """Which blocks are main text."""
    if not isinstance(tree, Split):
        return np.full(len(rows), tree > 0.5)
    low = rows[:, tree.feature] <= tree.limit
    out = np.empty(len(rows), bool)
    out[low], out[~low] = classify(tree.low, rows[low]), classify(tree.high, rows[~low])
    return out


def main_text(page: str, tree: Split | float) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(df: DataFrame, key: str, page: str, keep: tuple[str, ...] = (), out: str = "text") -> DataFrame:
    """``key``, the ``keep`` columns, and the main text of every row's whole page.

    NULL, empty pages and pages without main text give the empty text. Rows with equal or NULL keys are extracted each.
    Columns that are not named are left out. The tree is grown anew from the labelled table.
    """
    tree = train()
    names = [key, *keep]
    source = df.select(*(F.col(n).alias(f"_{i}") for i, n in enumerate(names)), F.col(page).alias("_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", tree) for p in batch.column("_page").to_pylist()]
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, out])

    fields = [T.StructField(n, df.schema[n].dataType) for n in names]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
