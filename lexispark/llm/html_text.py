"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

A page is read into a tree of block elements whose leaves are blocks of text
(inline markup does not cut a block). Each node has features: text, links and
marks in its subtree, depth, place, siblings, its element, tokens of its class,
id and role. Boosted trees, trained on pages that ``example_page`` makes from
random layouts with known labels, give each node's log-odds of being main text.

Decoding is hierarchical: a node may be kept only inside kept nodes. Under
that rule the labelling with the greatest total likelihood is found from the
leaves up, so no block is kept in a menu that is dropped, nor a dropped
article's paragraph.

Reading takes time that grows with the page's length, whatever is broken in it.

Defined results: a null or empty page, or one without kept blocks, gives the
empty text; broken markup is closed where a browser would, text after an
unclosed tag start is text; repeated rows get equal results; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import ship, tidied

#: Pages that the model is trained on, the seed that makes them, and trees.
EXAMPLES, SEED, ROUNDS = 500, 20_240, 80
#: Pages, and bytes of them, whose nodes are scored together.
PAGES, BYTES = 64, 4 << 20

# Elements by their role in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml object canvas audio video textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset "
    "legend blockquote pre figure figcaption address details summary dialog hr center menu select option button optgroup search".split()
)
CLOSES = {  # a start tag ends these open elements, up to the listed borders
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TAG_GROUPS = ("article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button select option search", "table thead tbody tr td th", "blockquote pre figure figcaption", "body html", "#text")
TOKEN_GROUPS = (
    "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense banner commercial",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "footer foot bottom contentinfo copyright legal colophon imprint",
    "header head masthead top logo branding topbar",
    "sidebar side aside rail widget widgets complementary related recommended recommendations more popular trending teaser",
    "comment comments commentlist disqus reply replies respond discussion reviews responses reader readers",
    "notice notices cookie cookies consent gdpr popup modal alert alertdialog banner overlay toast newsletter subscribe subscription signup paywall dialog warning message messages",
    "share social sharing follow facebook twitter login signin search form contact",
    "content article main post entry story body text page blog hentry prose articlebody maincontent",
    "hidden sr-only invisible print none",
    "author byline meta tags date category info credits",
)
_GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_GROUPS_OF_TOKEN: dict[str, list[int]] = {}
for _i, _g in enumerate(TOKEN_GROUPS):
    for _t in _g.split():
        _GROUPS_OF_TOKEN.setdefault(_t, []).append(_i)

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*+([\"'])")
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECES = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.,;:!?]")

# Places of a node's raw record.
PARENT, TAG, DEPTH, TEXT, LINKED, TAGS, TOKENS, START, HIDDEN, BLOCKS, MARKS, CHILDREN, INDEX = range(13)


def _tokens(attributes: str) -> tuple[frozenset[int], bool]:
    """Groups of the tokens of class, id and role; whether the element is hidden."""
    groups: set[int] = set()
    hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            for token in _PIECES.findall(_CAMEL.sub(" ", value).lower()):
                groups.update(_GROUPS_OF_TOKEN.get(token, ()))
    return frozenset(groups), hidden


class Tags:
    """Reads markup from left to right in time that grows with the page's length, whatever is broken in it.

    What has once been looked for in vain to the page's end is not looked for
    again: an end of a tag, a quotation mark, a comment's end, an element's end.
    """

    def __init__(self, html: str):
        self.html, self.none = html, set()

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, or -1."""
        if what in self.none:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def end(self, at: int) -> int:
        """Where the tag that goes on at ``at`` ends: past its first > outside of quoted values; -1 without one."""
        start, html = at, self.html
        while "quotes" not in self.none:
            stop = _STOP.search(html, at)
            if not stop:
                self.none.add("quotes")  # the rest is one open tag: from here on, quotes do not count
                break
            at = stop.end()
            if stop[0] == ">":
                return at
            if (quote := _QUOTE.match(html, at)) and (over := self.find(quote[1], quote.end())) >= 0:
                at = over + 1
        return self.find(">", start) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The next tag: begin, end, lower-case name (empty for comments and such), whether it is an end tag, attributes."""
        html = self.html
        while (begin := self.find("<", at)) >= 0:
            at = begin + 1
            if html.startswith("!--", at):
                over = self.find("-->", at + 3)
                return begin, over + 3 if over >= 0 else len(html), "", False, ""
            if html.startswith(("!", "?"), at):
                over = self.find(">", at)
                if over >= 0:
                    return begin, over + 1, "", False, ""
                continue
            closing = html.startswith("/", at)
            if (name := _NAME.match(html, at + closing)) and (over := self.end(name.end())) >= 0:
                return begin, over, name[0].lower(), closing, html[name.end() : over - 1]
        return None

    def close(self, tag: str, at: int) -> int:
        """Past the next end tag of an element whose content is raw; -1 without one."""
        if "</" + tag in self.none:
            return -1
        for m in re.compile(rf"</{re.escape(tag)}(?![A-Za-z0-9-])", re.I).finditer(self.html, at):
            over = self.find(">", m.end())
            return over + 1 if over >= 0 else -1
        self.none.add("</" + tag)
        return -1


class Open:
    """The open elements, with the places of each name's and of the blocks."""

    def __init__(self):
        self.all: list[tuple[str, int]] = []  # element and, for a block, its node, else -1
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.all))
        if node >= 0:
            self.blocks.append(len(self.all))
        self.all.append((tag, node))

    def pop(self) -> tuple[str, int]:
        tag, node = self.all.pop()
        self.places[tag].pop()
        if node >= 0:
            self.blocks.pop()
        return tag, node

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def parse(html: str) -> list[list]:
    """Nodes in page order; a text block's TEXT is its text, an element's is empty. The first is the root."""
    nodes: list[list] = [[-1, "#root", 0, "", 0, 0, frozenset(), 0, False, 0, 0, 0, 0]]
    tags, opened = Tags(html), Open()
    pieces: list[str] = []
    linked = 0
    inside_link = 0
    here = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            if inside_link:
                linked += len(raw)

    def flush(at: int) -> None:
        nonlocal linked
        if pieces:
            block = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if block:
                parent = nodes[here]
                nodes.append([here, "#text", parent[DEPTH] + 1, block, min(linked, len(block)), 0, frozenset(), at, False, 1, 0, 0, parent[CHILDREN]])
                parent[CHILDREN] += 1
        linked = 0

    def close(upto: int) -> None:
        """Close open elements down to place ``upto``."""
        nonlocal here, inside_link
        while len(opened.all) > upto:
            tag, node = opened.pop()
            if node >= 0:
                here = nodes[node][PARENT]
            elif tag == "a":
                inside_link -= 1

    at, end = 0, len(html)
    while True:
        found = tags.next(at)
        text(html[at : found[0]] if found else html[at:])
        if not found:
            break
        begin, at, tag, closing, attributes = found
        if not tag:
            continue
        if closing:
            i = opened.last(tag)
            if i >= 0:
                if tag in BLOCK:
                    flush(begin)
                    close(i)
                elif not opened.blocks or opened.blocks[-1] < i:  # an inline end tag does not close blocks
                    close(i)
            continue
        whole = attributes.endswith("/")
        if tag in RAW:
            over = -1 if attributes.rstrip().endswith("/") else tags.close(tag, at)
            if over >= 0:
                at = over
            elif tag in ("script", "style", "textarea", "title", "xmp") and not attributes.rstrip().endswith("/"):
                at = end
            pieces.append(" ")
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                pieces.append("\n")
            continue
        if tag in BLOCK:
            flush(begin)
            if tag in CLOSES:
                ends, borders = CLOSES[tag]
                i = opened.last(*ends)
                if i > opened.last(*borders):
                    close(i)
            if opened.blocks and opened.all[opened.blocks[-1]][0] == "p":  # a block ends an open paragraph and the inline elements in it
                close(opened.blocks[-1])
            if tag == "hr":
                continue
            groups, hidden = _tokens(attributes) if attributes else (frozenset(), False)
            parent = nodes[here]
            nodes.append([here, tag, parent[DEPTH] + 1, "", 0, 1, groups, begin, hidden, 0, 0, 0, parent[CHILDREN]])
            parent[CHILDREN] += 1
            here = len(nodes) - 1
            opened.push(tag, here)
        else:
            if not whole:
                opened.push(tag, -1)
                inside_link += tag == "a"
            nodes[here][TAGS] += 1
    flush(end)
    return nodes


#: Features of a node; nodes whose features are held together.
WIDTH, NODES = 14 + len(TAG_GROUPS) * 2 + len(TOKEN_GROUPS) * 2 + 2, 65_536


def features(nodes: list[list], size: int) -> Iterator[np.ndarray]:
    """Features of the nodes of one page, NODES at a time."""
    n = len(nodes)
    chars, links, tags, blocks, marks = ([0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node[TAG] == "#text":
            chars[i], links[i], blocks[i] = len(node[TEXT]), node[LINKED], 1
            marks[i] = len(_MARKS.findall(node[TEXT]))
        tags[i] += node[TAGS]
        if (p := node[PARENT]) >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            blocks[p] += blocks[i]
            marks[p] += marks[i]
    total = max(1, chars[0])
    above: list[frozenset] = [frozenset()] * n
    tags_above: list[frozenset] = [frozenset()] * n
    hidden = [False] * n
    own_tag = [frozenset((_GROUP_OF_TAG[node[TAG]],)) if node[TAG] in _GROUP_OF_TAG else frozenset() for node in nodes]
    x = np.zeros((0, WIDTH))
    for i, node in enumerate(nodes):
        if not i % NODES:
            if i:
                yield x
            x = np.zeros((min(NODES, n - i), WIDTH))
        p = node[PARENT]
        siblings = nodes[p][CHILDREN] if p >= 0 else 1
        c = chars[i]
        row = x[i % NODES]
        row[:14] = [
            math.log1p(c), links[i] / (c + 1), math.log((c + 1) / (tags[i] + 1)), node[DEPTH], node[INDEX] / siblings, math.log1p(siblings), math.log1p(blocks[i]),
            c / (blocks[i] + 1), marks[i] / (c + 1), node[START] / (size + 1), c / total, math.log1p(node[CHILDREN]), c / (chars[p] + 1) if p >= 0 else 1.0, (chars[p] - c) / siblings if p >= 0 else 0.0,
        ]
        if p >= 0:
            above[i] = above[p] | nodes[p][TOKENS]
            tags_above[i] = tags_above[p] | own_tag[p]
        hidden[i] = node[HIDDEN] or (p >= 0 and hidden[p])
        at = 14
        for groups, width in ((own_tag[i], len(TAG_GROUPS)), (tags_above[i], len(TAG_GROUPS)), (node[TOKENS], len(TOKEN_GROUPS)), (above[i], len(TOKEN_GROUPS))):
            for g in groups:
                row[at + g] = 1
            at += width
        row[at] = hidden[i]
        row[at + 1] = "©" in node[TEXT]
    yield x


def decode(nodes: list[list], margin: np.ndarray) -> list[bool]:
    """The likeliest labelling in which every kept node's parent is kept."""
    n = len(nodes)
    keep = (-np.logaddexp(0, -margin)).tolist()
    drop = (-np.logaddexp(0, margin)).tolist()
    for i in range(n - 1, 0, -1):
        p = nodes[i][PARENT]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [False] * n
    for i in range(n):
        p = nodes[i][PARENT]
        out[i] = (p < 0 or out[p]) and keep[i] > drop[i]
    return out


_WORDS = "the of and house river winter market stone letter garden window city report study people water system government music children history account morning language".split()


def example_page(chance: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout, and its blocks of main text."""
    main: set[str] = set()
    pick = chance.choice
    strange = chance.random() < 0.4  # a page whose names say nothing but for those of adverts, notices and comments

    def words(low: int, high: int) -> str:
        out = [pick(_WORDS) for _ in range(chance.randint(low, high))]
        if len(out) > 8:
            out = [w + pick(["", "", "", "", "", ",", "."]) for w in out]
            out[-1] = out[-1].rstrip(",.") + "."
        return " ".join(out).capitalize()

    number = iter(range(10**9))
    unique = lambda t: f"{t} {next(number)}"

    def link() -> str:
        return f'<a href="/{pick(_WORDS)}">{unique(words(1, 3))}</a>'

    def attribute(group: int, often: float = 0.85) -> str:
        if strange and often < 1 or chance.random() > often:
            return pick(["", f' class="{pick(["box", "row", "col", "wrap", "c1", "inner"])}"', f' class="{"".join(pick("bcdfghklmnprstvwz") + pick("aeiou") for _ in range(3))}"'])
        token = pick(TOKEN_GROUPS[group].split())
        return pick([f' class="{token}"', f' id="{token}"', f' class="{token}-{pick(["box", "list", "wrap", "1"])}"', f' class="site-{token} row"'])

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(chance.randint(3, 9)))
        return pick([f"<nav><ul>{items}</ul></nav>", f"<div{attribute(1)}><ul>{items}</ul></div>", f"<ul{attribute(1)}>{items}</ul>", f"<nav{attribute(1)}>{' '.join(link() for _ in range(4))}</nav>"])

    def paragraph(keep: bool) -> str:
        t = unique(words(*pick([(1, 4), (4, 14), (12, 60), (20, 120)])))
        if keep:
            main.add(t)
        if chance.random() < 0.25:
            a, _, b = t.partition(" ")
            return pick([f"<p><b>{a}</b> {b}</p>", f'<p>{a} <a href="#">{b}</a></p>' if len(b) < 40 else f'<p><a href="#">{a}</a> {b}</p>', f"<p><em>{t}</em></p>", f"<p><b>{t}<br>"])
        return pick([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<div>{t}</div>"])

    def article() -> str:
        out = []
        if chance.random() < 0.9:
            t = unique(words(3, 10))
            main.add(t)
            h = f"<h1>{t}</h1>"
            out.append(pick([h, h, h, f"<header>{h}</header>"]))
        for _ in range(chance.randint(1, 14)):
            r = chance.random()
            if r < 0.72:
                out.append(paragraph(True))
            elif r < 0.8:
                t = unique(words(2, 6))
                main.add(t)
                out.append(f"<{(h := pick(['h2', 'h3']))}>{t}</{h}>")
            elif r < 0.86:
                items = [unique(words(2, 14)) for _ in range(chance.randint(2, 5))]
                main.update(items)
                out.append(f"<{(u := pick(['ul', 'ol']))}>" + "".join(f"<li>{t}</li>" for t in items) + f"</{u}>")
            elif r < 0.9:
                t = unique(words(8, 30))
                main.add(t)
                out.append(pick([f"<blockquote>{t}</blockquote>", f"<blockquote><p>{t}</p></blockquote>", f"<pre>{t}</pre>", f"<table><tr><td>{t}</td></tr></table>"]))
            elif r < 0.94:
                out.append(advert())
            elif r < 0.97:
                out.append(notice())
            else:
                out.append(form())
        body = "".join(out)
        tag = pick(["article", "article", "main", "section", "div"])
        return f"<{tag}{attribute(8, 0.5 if tag in ('article', 'main') else 0.95)}>{body}</{tag}>"

    def advert() -> str:
        return pick([f"<div{attribute(0, 1)}>{pick([paragraph(False), unique(words(2, 25)), link()])}</div>", f"<aside{attribute(0, 1)}>{paragraph(False)}</aside>", f"<!-- ad --><div{attribute(0, 1)}>{unique(words(3, 30))}</div>"])

    def notice() -> str:
        t = pick([unique(words(4, 40)), paragraph(False)])
        return pick([f"<div{attribute(6, 1)}>{t}<button>{unique('ok')}</button></div>", f"<div{attribute(6, 1)}>{t}</div>", f"<section{attribute(6, 1)}>{t}</section>", f'<div role="alert">{t}</div>'])

    def form() -> str:
        return f"<form{attribute(7, 0.5)}><label>{unique(words(1, 4))}</label><input name=q><textarea>{words(1, 4)}</textarea><button>{unique('go')}</button>{pick(['', paragraph(False)])}</form>"

    def sidebar() -> str:
        parts = [f"<h{(n := pick('234'))}>{unique(words(1, 4))}</h{n}>", "<ul>" + "".join(f"<li>{pick([link(), unique(words(2, 8))])}</li>" for _ in range(chance.randint(2, 6))) + "</ul>"]
        parts += [paragraph(False) for _ in range(chance.randint(0, 3))]
        return pick([f"<aside{attribute(4, 0.6)}>{''.join(parts)}</aside>", f"<div{attribute(4, 1)}>{''.join(parts)}</div>"])

    def comments() -> str:
        one = lambda: f"<{(t := pick(['div', 'li', 'article']))}{attribute(5, 0.7)}>{pick(['', f'<b>{unique(words(1, 2))}</b>'])}{paragraph(False)}</{t}>"
        tag = pick(["section", "div", "ol"])
        return f"<{tag}{attribute(5, 1)}>{pick(['', f'<h3>{unique(words(1, 3))}</h3>'])}{''.join(one() for _ in range(chance.randint(1, 6)))}{pick(['', form()])}</{tag}>"

    def header() -> str:
        return pick([f"<header{attribute(3, 0.5)}>{pick([f'<h2>{unique(words(1, 4))}</h2>', f'<div>{unique(words(1, 6))}</div>', unique(words(2, 8))])}{pick(['', menu()])}</header>", f"<div{attribute(3, 1)}>{link()} {unique(words(1, 4))}</div>"])

    def footer() -> str:
        t = pick(["&copy; ", "© ", "", "Copyright "]) + unique(words(3, 30))
        return pick([f"<footer{attribute(2, 0.4)}>{t}</footer>", f"<footer><p>{t}</p>{menu()}</footer>", f"<div{attribute(2, 1)}>{t}</div>"])

    middle = [article()]
    for part, often in ((sidebar, 0.5), (comments, 0.45), (advert, 0.5), (form, 0.2), (notice, 0.3)):
        if chance.random() < often:
            if part is comments and chance.random() < 0.3 and middle[0].endswith("</article>"):
                middle[0] = middle[0][: -len("</article>")] + part() + "</article>"
            else:
                middle.insert(chance.randint(0, len(middle)), part())
    inner = "".join(middle)
    if chance.random() < 0.4:
        inner = f'<div class="{pick(["wrap", "container", "page", "layout"])}">{inner}</div>'
    body = "".join(f() for f, often in ((notice, 0.2), (header, 0.6), (menu, 0.7), (advert, 0.4)) if chance.random() < often) + inner + (footer() if chance.random() < 0.85 else "")
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>", main


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of example pages; an element is kept if any of its text is main text."""
    chance = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html, main = example_page(chance)
        nodes = parse(html)
        kept, every = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i][TAG] == "#text":
                every[i] = len(nodes[i][TEXT])
                kept[i] = every[i] * (nodes[i][TEXT] in main)
            if i:
                kept[nodes[i][PARENT]] += kept[i]
                every[nodes[i][PARENT]] += every[i]
        xs.extend(features(nodes, len(html)))
        ys.append(np.array([k > 0 for k in kept], float))
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: int = EXAMPLES, seed: int = SEED) -> boosting.Trees:
    x, y = labelled(pages, seed)
    return boosting.fit(x, y, rounds=ROUNDS)


def main_texts(pages: list[str], model: boosting.Trees) -> list[str]:
    """Main text of each page."""
    trees = [parse(p) for p in pages]
    margins, held, count = [], [], 0
    for t, p in zip(trees, pages, strict=True):
        for x in features(t, len(p)):
            held.append(x)
            count += len(x)
            if count > NODES:
                margins.append(model.margin(np.concatenate(held)))
                held, count = [], 0
    if held:
        margins.append(model.margin(np.concatenate(held)))
    margins = np.concatenate(margins)
    out, at = [], 0
    for nodes in trees:
        own = margins[at : at + len(nodes)].copy()
        own[0] = 20.0  # the root holds the page and is no choice
        at += len(nodes)
        kept = decode(nodes, own)
        out.append("\n".join(n[TEXT] for n, k in zip(nodes, kept, strict=True) if k and n[TAG] == "#text"))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(train())  # trees of fixed number and depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = min(PAGES, batch.num_rows - at)
                while size > 1 and batch.slice(at, size).column(2).nbytes > BYTES:
                    size //= 2
                part = batch.slice(at, size)
                at += size
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(tidied(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
