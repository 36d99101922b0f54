"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of its elements. Each has one of three states: frame (a wrapper around the article), content, or
boilerplate. Element potentials come from tag, class and id hints, text length, link share and sentence marks;
parent-child potentials say how states follow each other down the tree, given the child's tag. Messages pass up and
down once (sum-product), which gives exact marginals; text of elements that are content with more than half stays.

The potentials are counted from labelled pages: a few hand-labelled layouts, which stand in for rare kinds of pages,
and a bounded sample of the table's own pages that mark their article. Counting is one Spark aggregation; what reaches
the driver are counts of (potential, state), as many as there are tags and buckets.

Edge cases: null or empty html gives an empty text; text outside any tag is kept if the model takes it for content;
broken markup never raises; repeated rows are extracted one by one; a table without usable pages falls back on the
hand-labelled layouts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import bounded_sample, fresh, schema

FRAME, CONTENT, BOILER = range(3)
#: Pages of the sample, those whose rows hash lowest.
SAMPLE = 2_000
MARK = "data-state"
#: Text measures of an element and of those within it say much the same, so each counts for a part.
TEMPER = 0.25
#: Pseudo-count of a step from state to state that no labelled page has (such as from boilerplate to content).
UNSEEN = 1e-6

#: A tag as browsers read it: quotes count only where a value begins, in an unquoted one they are characters like any
#: other. No part can be read in two ways, and one that begins before some ">" always ends, so reading takes linear time.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+)>""")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""")
#: Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without markup inside: skipped up to their end, or to the end of the page, as browsers do.
RAW = set("script style title textarea xmp noembed noframes".split())
#: Skipped only if they are closed.
HIDDEN = set("template iframe".split())
#: Elements that often aren't text, but may hold it: parsed and judged if they are closed, else as if they weren't there.
EMBEDDED = set("noscript svg select button math object canvas audio video".split())
#: A block ends these.
BROKEN_BY_BLOCK = ("svg", "math", "select")
BLOCK = set("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())  # fmt: skip
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Words of class, id and role that hint at a state.
AGAINST = set("""ad ads advert advertisement advertising adv banner sponsor sponsored promo promoted promotion nav navbar navigation menu
topbar toolbar breadcrumb breadcrumbs header masthead footer colophon copyright legal sidebar aside rail widget widgets related
recommended recommendations more trending popular share sharing social follow subscribe newsletter signup login cookie cookies consent
gdpr notice alert popup modal overlay paywall comment comments disqus respond reply replies discussion form search pager pagination
tags taglist hidden skip contentinfo complementary""".split())  # fmt: skip
FOR = set("article content main story entry post body text blog maincontent articlebody".split())
HINT_WORD = re.compile(r"[A-Z]?[a-z]+")


def next_tag(source: str, at: int, last: int) -> tuple[int, int, bool, str, str] | None:
    """(start, end, closing, name, attributes) of the first tag from a place on; comments and the like have no name.

    last: where the last ">" of the page is. Behind it there are no tags, only a comment that is never closed.
    """
    while (at := source.find("<" if at <= last else "<!--", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return at, end + 3 if end >= 0 else len(source), False, "", ""
        if at < last:
            if m := TAG.match(source, at):
                return at, m.end(), bool(m[1]), m[2], m[3]
            if source[at + 1] in "!?/":
                return at, source.index(">", at) + 1, False, "", ""
        at += 1
    return None


class Page:
    """Elements (tag, parent, features) and text pieces (block, element, text) of one page."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.hint, self.mark = ["#root"], [-1], ["none"], [None]
        self.pieces: list[tuple[int, int, str]] = []
        self.chars, self.link_chars, self.sentences = [0], [0], [0]
        self._block, self._open, self._names, self._links = 0, [0], ["#root"], 0
        self._bare_at = -1, 0
        self._many: Counter = Counter()  # open elements by name
        self._read(source)

    def _read(self, source: str) -> None:
        at, ends, last = 0, {}, source.rfind(">")
        while tag := next_tag(source, at, last):
            start, end, closing, name, attributes = tag
            self._text(source[at:start])
            at = end
            if not name:
                continue
            name = name.lower()
            if closing:
                self._end(name)
                continue
            alone = attributes.rstrip().endswith("/")
            if (name in RAW or name in HIDDEN or name in EMBEDDED) and not alone and ends.get(name, -1) < at:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A).search(source, at)
                ends[name] = end.start() if end else len(source)
            if name in RAW and not alone:
                at = ends[name]
            elif name in HIDDEN and not alone:
                at = ends[name] if ends[name] < len(source) else at
            elif name not in EMBEDDED or not alone and ends[name] < len(source):
                self._start(name, attributes)
        self._text(source[at:])

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._add(" ")
            return
        if name in BLOCK:
            self._block += 1
            for other in BROKEN_BY_BLOCK:
                self._pop_to(other)
            if name not in ("html", "head", "body"):
                self._pop_to("p", stop=("td", "th", "table", "article", "section", "div", "li", "blockquote", "form"))
            if name in CLOSES:
                for other in CLOSES[name]:
                    self._pop_to(other, stop=WITHIN[name])
        if name in VOID:
            return
        if name == "button":
            self._pop_to(name)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.hint.append(self._hint(attributes) if attributes else "none")
        mark = re.search(rf'{MARK}="(\d)"', attributes) if MARK in attributes else None
        self.mark.append(int(mark[1]) if mark else None)
        self.chars.append(0)
        self.link_chars.append(0)
        self.sentences.append(0)
        self._open.append(len(self.tag) - 1)
        self._names.append(name)
        self._many[name] += 1
        self._links += name == "a"

    @staticmethod
    def _hint(attributes: str) -> str:
        found = set()
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name in ("class", "id", "role", "itemprop"):
                found.update(x.lower() for x in HINT_WORD.findall(value))
                found.update(value.lower().split())
            elif name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
                found.add("hidden")
        if " hidden" in f" {attributes} ".replace("=", " "):
            found.add("hidden")
        if found & AGAINST:
            return "both" if found & FOR else "against"
        return "for" if found & FOR else "none"

    def _pop_to(self, name: str, stop: tuple[str, ...] = ()) -> None:
        if not self._many[name]:
            return
        for k in range(len(self._names) - 1, 0, -1):
            if self._names[k] == name:
                self._links -= self._names[k:].count("a")
                self._many.subtract(self._names[k:])
                del self._open[k:], self._names[k:]
                return
            if self._names[k] in stop:
                return

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._block += 1
        if name not in VOID:
            self._pop_to(name)

    def _text(self, raw: str) -> None:
        if raw:
            self._add(html.unescape(raw) if "&" in raw else raw)

    def _bare(self, node: int) -> int:
        """An element for text that stands right in the body: the same one within a block."""
        if self._bare_at[0] != self._block:
            self.tag.append("p")
            self.parent.append(node)
            self.hint.append("none")
            self.mark.append(None)
            for column in (self.chars, self.link_chars, self.sentences):
                column.append(0)
            self._bare_at = self._block, len(self.tag) - 1
        return self._bare_at[1]

    def _add(self, text: str) -> None:
        node = self._open[-1]
        size = len(text.strip())
        if size and self.tag[node] in ("#root", "html", "body"):
            node = self._bare(node)
        self.chars[node] += size
        if self._links:
            self.link_chars[node] += size
        self.sentences[node] += text.count(".") + text.count("!") + text.count("?") + text.count(",")
        self.pieces.append((self._block, node, text))

    def features(self) -> list[tuple[str, ...]]:
        """Of each element: tag, hint, bucket of own text, link share of its whole text, sentence marks."""
        chars, links, marks = list(self.chars), list(self.link_chars), list(self.sentences)
        for k in range(len(self.tag) - 1, 0, -1):  # children come after parents
            p = self.parent[k]
            chars[p] += chars[k]
            links[p] += links[k]
            marks[p] += marks[k]
        out = []
        for k, tag in enumerate(self.tag):
            n = chars[k]
            size = "0" if not n else "1" if n < 25 else "2" if n < 80 else "3" if n < 300 else "4"
            share = "no" if not n else str(min(3, 4 * links[k] // n))
            dense = "no" if not n else str(min(3, marks[k] * 100 // n))
            out.append((f"tag {tag if tag in KNOWN else 'other'}", f"hint {self.hint[k]}", f"size {size}", f"links {share}", f"marks {dense}"))
        return out

    def blocks(self, content: list[bool]) -> str:
        """The text of the elements that are content: white space as one space, blocks in page order."""
        out: dict[int, list[str]] = {}
        for block, node, text in self.pieces:
            if content[node]:
                out.setdefault(block, []).append(text)
        said = (" ".join("".join(x).split()) for x in out.values())
        return "\n\n".join(x for x in said if x)


KNOWN = BLOCK | EMBEDDED | set("a b i em strong span u small code q cite label abbr sub sup time #root".split())


def marked_states(page: Page) -> list[int] | None:
    """States of a page that marks them: by MARK attributes, else by its article or main element; None if it has neither."""
    by_mark = any(m is not None for m in page.mark)
    roots = {k for k, t in enumerate(page.tag) if t in ("article", "main")}
    if not by_mark and not roots:
        return None
    outside = lambda k: page.tag[k] in ("nav", "aside", "footer", "form") or page.hint[k] == "against"
    leads = {0}
    if not by_mark:
        # The outermost articles that nothing excludes; what leads to them is frame.
        for k in sorted(roots):
            path, p = [], k
            while p > 0 and not outside(p) and (p == k or p not in roots):
                path.append(page.parent[p])
                p = page.parent[p]
            if p > 0:
                roots.discard(k)
            else:
                leads.update(path)
    states: list[int] = []
    for k in range(len(page.tag)):
        above = states[page.parent[k]] if k else FRAME
        if by_mark:
            states.append(page.mark[k] if page.mark[k] is not None else above)
        elif k in leads:
            states.append(FRAME)
        elif above == CONTENT:
            states.append(BOILER if outside(k) else CONTENT)
        else:
            states.append(CONTENT if k in roots and above == FRAME else BOILER)
    return states


def counts(source: str | None) -> Counter:
    """Counts of (potential, state) of a labelled page; none for others."""
    page = Page(source or "")
    states = marked_states(page)
    found: Counter = Counter()
    if states is None:
        return found
    for k, features in enumerate(page.features()):
        for f in features:
            found[f, states[k]] += 1
        if k:
            found[f"edge {states[page.parent[k]]} {features[0][4:]}", states[k]] += 1
            found[f"edge {states[page.parent[k]]} any", states[k]] += 1
    return found


class Model:
    """Log potentials from weighted counts."""

    def __init__(self, found: dict[tuple[str, int], float]) -> None:
        kinds = ("tag", "hint", "size", "links", "marks")
        values = {kind: sorted({f for f, _ in found if f.startswith(kind + " ")}) for kind in kinds}
        self.node = {}
        for kind in kinds:
            total = [sum(found.get((f, s), 0) for f in values[kind]) for s in range(3)]
            for f in values[kind]:
                self.node[f] = [math.log((found.get((f, s), 0) + 0.5) / (total[s] + 0.5 * (len(values[kind]) + 1))) for s in range(3)]
        self.edge = {}
        for s in range(3):
            overall = [found.get((f"edge {s} any", t), 0) + UNSEEN for t in range(3)]
            for name in {f for f, _ in found if f.startswith(f"edge {s} ")} | {f"edge {s} any"}:
                # A tag that was rarely seen leans on all tags.
                own = [found.get((name, t), 0) + 0.2 * overall[t] / sum(overall) for t in range(3)]
                self.edge[name] = [math.log(v / sum(own)) for v in own]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element, by one upward and one downward pass of messages."""
        n = len(page.tag)
        local, edges = [], []
        for features in page.features():
            own = [(self.node[f], 1.0 if f[:4] == "hint" else TEMPER) for f in features[1:] if f in self.node]  # the tag acts through the edge
            local.append([sum(w * x[s] for x, w in own) for s in range(3)])
            edges.append([self.edge.get(f"edge {p} {features[0][4:]}") or self.edge[f"edge {p} any"] for p in range(3)])
        local[0] = [0.0, -20.0, -20.0]
        up = [[0.0] * 3 for _ in range(n)]
        belief = local
        for k in range(n - 1, 0, -1):
            b, e, into = belief[k], edges[k], belief[page.parent[k]]
            for p in range(3):
                up[k][p] = _log_sum(e[p][0] + b[0], e[p][1] + b[1], e[p][2] + b[2])
                into[p] += up[k][p]
        out = [0.0] * n
        for k in range(n):
            b = belief[k]
            if k:
                above, e, u = belief[page.parent[k]], edges[k], up[k]
                cavity = [above[p] - u[p] for p in range(3)]
                belief[k] = b = [b[s] + _log_sum(*(cavity[p] + e[p][s] for p in range(3))) for s in range(3)]
            top = _log_sum(*b)
            belief[k] = b = [x - top for x in b]
            out[k] = math.exp(b[CONTENT])
        return out

    def extract(self, source: str | None) -> str:
        page = Page(source or "")
        return page.blocks([p > 0.5 for p in self.marginals(page)])


def _log_sum(a: float, b: float, c: float) -> float:
    top = max(a, b, c)
    return top + math.log(math.exp(a - top) + math.exp(b - top) + math.exp(c - top))


def _layouts() -> list[str]:
    """Hand-labelled layouts: 0 frame, 1 content, 2 boilerplate; an element without a mark has its parent's state."""
    long = "Some words of a sentence that goes on for a while, with a pause or two, and then it ends. Another one follows it, as usual, with more words. " * 2
    short, link = "A short line.", '<li><a href="/x">Menu entry</a></li>'
    p, h = f"<p>{long}</p>", "<h1>A heading of the page</h1>"
    nav = f'<nav {MARK}="2"><ul>{link * 5}</ul></nav>'
    menu = f'<div class="menu" {MARK}="2"><ul>{link * 4}</ul></div>'
    header = f'<header {MARK}="2"><a href="/">Name of the site</a><p>What it is about.</p></header>'
    footer = f'<footer {MARK}="2"><p>Copyright of the site. All rights reserved.</p><ul>{link * 3}</ul></footer>'
    foot = f'<div id="footer" class="footer" {MARK}="2"><p>{short}</p><a href="/terms">Terms</a></div>'
    side = f'<aside class="sidebar" {MARK}="2"><h3>Related</h3><ul>{link * 4}</ul><p>{long}</p></aside>'
    rail = f'<div class="sidebar" {MARK}="2"><div class="widget"><h4>Popular</h4><ul>{link * 3}</ul><p>{short}</p></div></div>'
    ad = f'<div class="ad" {MARK}="2">Buy this now, while it is cheap. {long}</div>'
    cookie = f'<div class="cookie-notice" {MARK}="2"><p>{long}</p></div>'
    form = f'<form {MARK}="2"><label>Your mail</label><p>{short}</p></form>'
    letter = f'<div class="newsletter" {MARK}="2"><h3>Subscribe</h3><p>{short}</p><form><label>Mail</label></form></div>'
    notes = f'<section id="comments" class="comments" {MARK}="2"><h2>Comments</h2><div class="comment"><p>{long}</p></div><article class="comment"><p>{long}</p></article><ol><li>{long}</li></ol></section>'
    notes2 = f'<div class="comments" {MARK}="2"><h3>Replies</h3><ul><li><p>{long}</p></li><li><p>{short}</p></li></ul><p>{long}</p></div>'
    share = f'<div class="share" {MARK}="2"><a href="/s">Share</a> <a href="/t">Send</a></div>'
    text = f"{h}{p * 3}<h2>Second part</h2><p>{short}</p><ul><li>{long}</li><li>{short}</li></ul><blockquote><p>{long}</p></blockquote><table><tr><td>{short}</td><td>12</td></tr></table><pre>{short}</pre><p><a href='/y'>{short}</a> {long}</p>"
    mark = f'{MARK}="1"'
    parts = f'<button {MARK}="2">Share</button><noscript {MARK}="2">{short}</noscript><select {MARK}="2"><option>One</option></select><svg {MARK}="2"><text>x</text></svg>'
    parts += "".join(f'<{x} {MARK}="2">{short}</{x}>' for x in ("object", "canvas", "audio", "video"))
    formula = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>. " + long + "</p>"
    held = "".join(f"<{x}>{p * 2}</{x}>" for x in ("button", "noscript", "object", "canvas", "audio", "video"))
    figure = f"<figure><figcaption>{short}</figcaption></figure>"
    bodies = [
        header + nav + f"<main {mark}><article>{text}{figure}{share}</article></main>" + side + footer,
        nav + ad + f"<article {mark}>{text}{ad}{form}{side}{nav}{notes}</article>" + footer,
        header + menu + f'<div id="wrapper" {MARK}="0"><div class="content" {mark}>{text}{letter}</div>{rail}</div>' + foot + cookie,
        cookie + header + f'<div class="page" {MARK}="0"><div {MARK}="0"><div class="post" {mark}><div>{text}</div><section>{p}<div>{p}</div></section></div>{notes2}</div>{side}</div>' + footer,
        header + nav + f'<main {MARK}="0"><article {mark}><header><h1>A heading</h1><p>{short}</p></header>{text}<footer {MARK}="2">{short}</footer></article>{notes}{form}</main>' + footer,
        f'<div {MARK}="0">{menu}<div {mark}>{text}</div>{foot}</div>',
        nav + f'<h1 {mark}>A heading</h1>' + f"<p {mark}>{long}</p>" * 4 + footer,
        f'<table {MARK}="0"><tr {MARK}="0"><td class="nav" {MARK}="2">{link * 3}</td><td {mark}>{text}</td></tr></table>' + foot,
        header + nav + parts + f"<article {mark}>{text}{parts}{formula}{held}</article>" + footer,
        header + f'<section {MARK}="0"><div id="main-content" {mark}><h2>A heading</h2>{p * 2}{ad}{p}</div></section>' + letter + footer,
    ]
    return [f'<html {MARK}="0"><head {MARK}="2"><title>x</title></head><body {MARK}="0">{b}</body></html>' for b in bodies]


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the layouts and from at most sample pages of the table; both weigh the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for source in batch.column(0).to_pylist():
                found.update(counts(source))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["potential", "state", "n"])

    few = bounded_sample(pages.where("html is not null"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in pages.dtypes if kind in ("bigint", "int", "string")]), sample).select("html")
    rows = few.mapInArrow(run, schema("potential string, state long, n long")).groupBy("potential", "state").agg(F.sum("n").alias("n")).collect()
    table = Counter({(r["potential"], r["state"]): r["n"] for r in rows})
    hand: Counter = Counter()
    for layout in _layouts():
        hand.update(counts(layout))
    size = sum(v for (f, _), v in table.items() if f.startswith("tag ")) or 1
    scale = max(size, 20_000) / sum(v for (f, _), v in hand.items() if f.startswith("tag "))
    return Model({k: table[k] * max(1.0, 20_000 / size) * (size > 1) + hand[k] * scale for k in {*table, *hand}})


def with_main_text(pages: DataFrame, model: Model, name: str = "main_text") -> tuple[DataFrame, str]:
    """pages with one string column more (its name is returned): the main text of html."""

    @F.pandas_udf(schema("text string"))
    def run(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in sources:
            yield pd.DataFrame({"text": [model.extract(x) for x in batch]})

    name = fresh(pages, name)
    text: Column = run("html")["text"]
    return pages.withColumn(name, text), name
