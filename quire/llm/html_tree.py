"""HTML main-text extraction by a tree-structured graphical model.

The DOM nodes of a page, elements and runs of text, are binary variables: content or not.
A node's potential is a weighted sum of its features (tag, words of class and id, length,
share of linked characters, ...); an edge's potential depends on the kind of its two
ends. On a tree the sum-product algorithm is exact: messages go upward from the leaves
and downward from the root, and the runs of text whose content marginal is at least one
half are the main text. Weights are trained by gradient ascent of the conditional
likelihood, whose expectations come from the same messages, on labelled pages made by
labelled_pages(); their number, TRAIN_PAGES, bounds the work and the model, which is kept
for the session. Those pages hold their prose in articles, in named, plain and oddly named
blocks, bare in the body, broken by br and in cells of layout tables.

Defined results: a null or empty html has no text; unclosed and stray tags are
tolerated, and scripts, styles and form controls that are never closed end at the next
border of a block; formulas and drawn texts are text of their block; a page is one row and
is parsed whole, in time that grows with its length however its tags nest; repeated rows get
equal results; extra columns are ignored, under whatever names; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

TRAIN_PAGES = 300
EPOCHS = 40
SEED = 11

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
SENTENCE = re.compile(r"\w[.!?…][\"”»)]?(?=\s|$)")
#: Elements whose content is code, form controls, or no part of the text that is shown.
RAW = frozenset("script style textarea title iframe template select option datalist annotation annotation-xml desc metadata".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var "
    "object svg g text tspan textpath math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder "
    "munderover mtable mtr mtd mstyle mspace semantics mpadded menclose mphantom mfenced".split()
)
#: Where an element of RAW that is never closed ends: at the next border of a block.
BORDER = r"(?=</?(?:html|body|main|article|section|aside|nav|header|footer|div|p|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|form|figure)\b)"
#: Start tags that end an open element of the same group.
ENDS = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
SCOPE = frozenset("ul ol dl table tbody body article section div main aside nav blockquote form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Ends:
    """Where the elements of RAW end; a search is not repeated while what it found, or that it found nothing, holds."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, pattern: str, at: int) -> tuple[int, int] | None:
        """Start and end of the first match from at on."""
        known = self.found.get(pattern, (-1, -1))
        if known is not None and known[0] < at:
            m = re.compile(pattern, re.I).search(self.page, at)
            known = self.found[pattern] = (m.start(), m.end()) if m else None
        return known

    def of(self, tag: str, at: int) -> int:
        """Where the content of an element that begins at at is over."""
        close, border = self.next(rf"</{tag}\s*>", at), None
        if tag in ("select", "option", "datalist"):  # hold no blocks, and are often left open
            other = r"|(?=<option\b|</select\b|</datalist\b|</optgroup\b)" if tag == "option" else ""
            border = self.next(BORDER + other, at)
            return min((x[1] for x in (close, border) if x), default=len(self.page))
        close = close or self.next(BORDER, at)
        return close[1] if close else len(self.page)


class Open:
    """The stack of open elements; what a start or end tag closes is found without going down the stack."""

    def __init__(self):
        self.nodes, self.tags, self.depths = [0], ["html"], {}
        #: By depth: the innermost p, and the innermost element of each group, that nothing in between hides.
        self.p, self.groups = [0], [{}]

    def push(self, node: int, tag: str) -> None:
        depth, group = len(self.nodes), ENDS.get(tag)
        hides = tag in SCOPE
        p, groups = (0, {}) if hides else (self.p[-1], {} if tag in HEADINGS else self.groups[-1])
        self.p.append(depth if tag == "p" else p)
        self.groups.append(groups | {group: depth} if group else groups)
        self.nodes.append(node)
        self.tags.append(tag)
        self.depths.setdefault(tag, []).append(depth)

    def close(self, depth: int) -> None:
        """Closes the element at a depth and all within it."""
        if depth:
            for tag in self.tags[depth:]:
                self.depths[tag].pop()
            for x in (self.nodes, self.tags, self.p, self.groups):
                del x[depth:]

    def end(self, tag: str) -> None:
        own = self.depths.get(tag)
        self.close(own[-1] if own else 0)

    def make_room(self, tag: str) -> None:
        """Closes what a start tag ends by itself: a p, or an element of its group."""
        if tag == "p":
            self.close(self.p[-1])
        else:
            groups = self.groups[-1]
            self.close(max(groups.get("p", 0), groups.get(ENDS.get(tag), 0)))


class Node:
    """An element, or a run of text if text is not None."""

    __slots__ = ("tag", "names", "parent", "text", "linked")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, text: str | None = None, linked: float = 0.0):
        self.tag, self.names, self.parent, self.text, self.linked = tag, names, parent, text, linked


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in document order, parents before children; nodes[0] is the root.

    Inline elements are no nodes: their text belongs to the block around them.
    """
    page = page or ""
    nodes = [Node("html", (), -1)]
    stack, ends = Open(), Ends(page)
    run: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = SPACES.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                nodes.append(Node("#text", (), stack.nodes[-1], text, min(1.0, linked / (len(text) - text.count(" ")))))
            run.clear()
            linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            run.append(text)
            if links:
                linked += len(SPACES.sub("", text))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2), m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                run.append(" ")
            continue
        if tag in RAW:  # stands within its block and does not divide it
            at = at if closing or attributes.endswith("/") else ends.of(tag, at)
            continue
        flush()
        if closing:
            stack.end(tag)
            continue
        if tag == "html" and len(stack.nodes) > 1:
            continue
        links = 0
        stack.make_room(tag)
        names: tuple[str, ...] = ()
        if attributes:
            words = [x for a in ATTRIBUTE.findall(attributes) for x in NAME_WORD.findall("".join(a[1:]).lower())]
            names = tuple(dict.fromkeys(words))
        nodes.append(Node(tag, names, stack.nodes[-1]))
        stack.push(len(nodes) - 1, tag)
    flush()
    return nodes


def features(node: Node, nodes: list[Node]) -> list[str]:
    if node.text is None:
        return ["tag " + node.tag, *("name " + x for x in node.names)] if node.names else ["tag " + node.tag, "unnamed " + node.tag]
    n, text = len(node.text), node.text
    size, inside = min(9, n.bit_length()), nodes[node.parent].tag
    found = [f"length {size}", f"linked {int(node.linked * 3.99)}", f"in {inside}", f"in {inside} length {size}"]
    if text[-1] in ".!?…\"”»":
        found.append("ends a sentence")
    sentences = min(3, len(SENTENCE.findall(text)))
    found += [f"sentences {sentences}", f"in {inside} sentences {sentences}", f"sentences {sentences} linked {int(node.linked * 3.99)}", f"in {inside} linked {int(node.linked * 3.99)}"]
    if n < 80 and re.search(r"©|\(c\)|copyright|all rights reserved", text, re.I):
        found.append("copyright")
    return found


#: Kinds of edges: a text below an element, a structural element below another, a block below one, a cell of a table.
EDGES = 4
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption caption ul ol dl tr table tbody".split())


def edge_kind(node: Node) -> int:
    return 0 if node.text is not None else 3 if node.tag in ("td", "th") else 2 if node.tag in BLOCKS else 1


#: Names on fewer training pages than this are taken for one unknown name, as are names that no page has.
KNOWN_PAGES = 4
UNKNOWN = "name ?"


class Model:
    """weights of features for "content", and potentials[kind][parent][child] of the edges."""

    def __init__(self, weights: dict[str, float], potentials: list[list[list[float]]]):
        self.weights, self.potentials = weights, potentials

    def score(self, node: Node, nodes: list[Node]) -> float:
        weights = self.weights
        unknown = weights.get(UNKNOWN, 0.0)
        return sum([weights.get(f, unknown if f.startswith("name ") else 0.0) for f in features(node, nodes)])

    def messages(self, nodes: list[Node]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of content: own with all from below, the message up, and the message from above."""
        table = [[[math.exp(v) for v in row] for row in kind] for kind in self.potentials]
        n = len(nodes)
        below = [self.score(x, nodes) for x in nodes]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            (t00, t01), (t10, t11) = table[edge_kind(nodes[i])]
            e = math.exp(max(-30.0, min(30.0, below[i])))
            up[i] = math.log((t10 + t11 * e) / (t00 + t01 * e))
            below[nodes[i].parent] += up[i]
        above = [0.0] * n
        for i in range(1, n):
            p = nodes[i].parent
            (t00, t01), (t10, t11) = table[edge_kind(nodes[i])]
            e = math.exp(max(-30.0, min(30.0, below[p] + above[p] - up[i])))
            above[i] = math.log((t01 + t11 * e) / (t00 + t10 * e))
        return below, up, above

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of each node."""
        below, _, above = self.messages(nodes)
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, b + a)))) for b, a in zip(below, above, strict=True)]

    def edge_marginals(self, nodes: list[Node]) -> list[list[list[float]]]:
        """P(parent = a, child = b) of the edge above each node but the root."""
        below, up, above = self.messages(nodes)
        found = []
        for i in range(1, len(nodes)):
            p, kind = nodes[i].parent, self.potentials[edge_kind(nodes[i])]
            cavity = below[p] + above[p] - up[i]
            joint = [[math.exp(min(30.0, kind[a][b] + a * cavity + b * below[i])) for b in (0, 1)] for a in (0, 1)]
            total = sum(map(sum, joint))
            found.append([[x / total for x in row] for row in joint])
        return found


def train(pages: list[tuple[list[Node], list[int]]], epochs: int = EPOCHS, rate: float = 0.5) -> Model:
    """Gradient ascent (with AdaGrad steps) of the pages' conditional log-likelihood, with a small L2 penalty."""
    model = Model({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(EDGES)])
    squares: dict = {}
    prepared = [(nodes, labels, [features(x, nodes) for x in nodes]) for nodes, labels in pages]
    seen = Counter(f for _, _, named in prepared for f in {f for names in named for f in names if f.startswith("name ")})
    known = lambda f: UNKNOWN if 0 < seen[f] < KNOWN_PAGES else f
    prepared = [(nodes, labels, [[known(f) for f in names] for names in named]) for nodes, labels, named in prepared]

    def move(key, value: float, gradient: float) -> float:
        gradient -= 0.02 * value
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        return value + rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        slope: dict[str, float] = {}
        edges = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(EDGES)]
        for nodes, labels, named in prepared:
            for label, p, names in zip(labels, model.marginals(nodes), named, strict=True):
                for f in names:
                    slope[f] = slope.get(f, 0.0) + label - p
            for i, joint in enumerate(model.edge_marginals(nodes), 1):
                own = edges[edge_kind(nodes[i])]
                own[labels[nodes[i].parent]][labels[i]] += 1.0
                for a in (0, 1):
                    for b in (0, 1):
                        own[a][b] -= joint[a][b]
        for f in sorted(slope):
            model.weights[f] = move(f, model.weights.get(f, 0.0), slope[f])
        for k in range(EDGES):
            for a in (0, 1):
                for b in (0, 1):
                    model.potentials[k][a][b] = move((k, a, b), model.potentials[k][a][b], edges[k][a][b])
    return model


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, str]]:
    """(html, main text) of pages in layouts of many kinds, whose main text is known by construction."""
    rng = random.Random(seed)
    syllables = "ba co di fu ge ha in jo ka le mi no pe qua re so ta un ve wi za st er th".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 16).capitalize() + rng.choice("...!?")
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'

    def listing(k: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"

    def any_tag(tags: str, names: str, body: str) -> str:
        name = rng.choice(names.split())
        tag = rng.choice(tags.split())
        attribute = rng.choice(("class", "class", "id"))
        plain = tag not in ("div", "section", "p") and rng.random() < 0.5
        return f"<{tag}>{body}</{tag}>" if plain else f'<{tag} {attribute}="{name}">{body}</{tag}>'

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(k))

    outside = [
        lambda: any_tag("nav nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs topnav", listing(rng.randint(2, 8))),
        lambda: any_tag("header header div", "header masthead banner site-header", f"<div>{words(1, 4)}</div>" + listing(rng.randint(0, 4))),
        lambda: any_tag("footer footer div", "footer site-footer bottom copyright", f"&copy; {words(1, 4)} &middot; {prose(1)}"),
        lambda: any_tag("aside aside div", "sidebar side aside widget related recommended", f"<h3>{words(1, 3)}</h3>" + rng.choice((listing(3), f"<p>{prose(rng.randint(1, 3))}</p>"))),
        lambda: any_tag("div div aside section", "ad ads advert advertisement sponsored promo banner-ad", rng.choice((prose(rng.randint(1, 3)), f"<p>{prose(2)}</p>", link(3, 6)))),
        lambda: any_tag("div section aside", "notice cookie cookies consent alert newsletter popup modal subscribe", rng.choice((prose(rng.randint(1, 2)), f"<p>{prose(2)}</p><button>{word()}</button>"))),
        lambda: f'<form class="{rng.choice(("search", "login", "form"))}"><label>{words(1, 3)}</label><input name="q"><button>{word()}</button></form>',
        lambda: any_tag("div section ol", "comments comment comment-list replies responses", f"<h2>{words(1, 2)}</h2>" + "".join(
            rng.choice((f'<div class="comment"><p>{prose(rng.randint(1, 4))}</p></div>', f"<p>{word()}: {prose(rng.randint(1, 3))}</p>")) for _ in range(rng.randint(1, 4)))),
        lambda: any_tag("div", "share social tags tag-list pagination pager", "".join(link(1, 1) for _ in range(rng.randint(2, 5)))),
        lambda: f"<script>var x = {rng.random()};</script>",
        lambda: f"<noscript>{prose(1)}</noscript>",
        lambda: f"<!-- {words(2, 5)} -->",
    ]

    def block() -> tuple[str, list[str]]:
        kind = rng.random()
        if kind < 0.62:
            text = prose(rng.choice((0, 1, 1, 2, 3, 6))) or word().capitalize() + "."
            shown = text
            if rng.random() < 0.25:
                one = text.split(" ")
                at = rng.randrange(len(one))
                one[at] = rng.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<math><mi>{}</mi></math>")).format(one[at])
                shown = " ".join(one)
            if rng.random() < 0.1:
                return f"<p><b>{shown}<br>", [text]
            return f"<p>{shown}</p>" if rng.random() < 0.95 else f"<p>{shown}", [text]
        if kind < 0.74:
            text = words(1, 6).capitalize()
            tag = rng.choice(("h2", "h2", "h3"))
            return f"<{tag}>{text}</{tag}>", [text]
        if kind < 0.86:
            items = [words(1, 9) for _ in range(rng.randint(2, 5))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", items
        if kind < 0.93:
            text = prose(rng.randint(1, 3))
            return f"<blockquote><p>{text}</p></blockquote>", [text]
        cells = [words(1, 3) for _ in range(4)]
        rows = f"<tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr>"
        return f"<table>{rows}</table>", cells

    def framed(title: str, inner: str) -> str:
        before = "".join(rng.choice(outside)() for _ in range(rng.randint(0, 4)))
        after = "".join(rng.choice(outside)() for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.1:  # a fragment
            return f"{before}{inner}{after}"
        head = f"<head><title>{title}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{before}{inner}{after}</body></html>"

    def plain(title: str) -> tuple[str, list[str]]:
        """Prose in blocks that say nothing of it: unnamed or oddly named, bare, or cells of a layout table."""
        named = lambda: rng.choice(("", "", f' class="{word()}"', f' id="{word()}"', f' class="{word()} {word()}"'))
        texts = [prose(rng.choice((1, 1, 2, 4))) for _ in range(rng.choice((1, 1, 2, 3, 6)))]
        kind = rng.random()
        if kind < 0.35:
            tag = rng.choice(("div", "div", "p", "section"))
            inner = "".join(f"<{tag}{named()}>{x}</{tag}>" for x in texts)
        elif kind < 0.6:  # lines broken within one block
            lines = texts + [prose(1) for _ in range(rng.randint(0, 2))]
            inner, texts = rng.choice(("<br>", "<br><br>", "<br/>\n")).join(lines), [" ".join(lines)]
        else:
            inner, texts = texts[0], texts[:1]
        if rng.random() < 0.3:
            inner, texts = f"<h1>{title}</h1>{inner}", [title, *texts]
        if rng.random() < 0.3:
            menu = "".join(rng.choice((link(1, 2), f"{link(1, 1)}<br>")) for _ in range(rng.randint(2, 6)))
            cells = [f"<td{named()}>{menu}</td>", f"<td{named()}>{inner}</td>"]
            cells += [f"<td>{listing(3)}</td>"] if rng.random() < 0.3 else []
            return f"<table{named()}><tr>{''.join(cells)}</tr></table>", texts
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            inner = f"<div{named()}>{inner}</div>"
        return inner, texts

    pages = []
    for _ in range(n):
        title = words(2, 9).capitalize()
        parts, texts = [], []
        if rng.random() < 0.8:
            parts.append(f"<h1>{title}</h1>")
            texts.append(title)
        if rng.random() < 0.15:
            text = prose(3)
            parts.append(text if parts else f"<p>{text}</p>")
            texts.append(text)
        for _ in range(rng.choice((1, 2, 4, 8, 14))):
            part, own = block()
            parts.append(part)
            texts += own
            if rng.random() < 0.08:
                parts.append(rng.choice(outside)())
        if rng.random() < 0.1:  # many short paragraphs
            short = [words(1, 3).capitalize() + "." for _ in range(rng.randint(8, 40))]
            parts += [f"<p>{x}</p>" for x in short]
            texts += short
        inner = "".join(parts)
        shape = rng.random()
        if shape < 0.4:
            inner, texts = plain(title)
            pages.append((framed(title, inner), "\n\n".join(texts)))
            continue
        shape = rng.random()
        if shape < 0.45:
            inner = f"<article>{inner}</article>"
        elif shape < 0.6:
            inner = f"<main>{inner}</main>"
        elif shape < 0.7:
            inner = f'<main><article class="post">{inner}</article></main>'
        else:
            name = rng.choice("content article post entry-content main-content story article-body post-body text".split())
            inner = f'<div class="{name}">{inner}</div>'
        if rng.random() < 0.3:
            inner = f'<div class="{rng.choice(("container", "wrapper", "page", "row", "layout"))}">{inner}' + (rng.choice(outside)() if rng.random() < 0.5 else "") + "</div>"
        pages.append((framed(title, inner), "\n\n".join(texts)))
    return pages


def labels_of(nodes: list[Node], main_text: str) -> list[int]:
    """1 for the runs of text that make up main_text in order, and for elements with such text below."""
    wanted = main_text.split("\n\n") if main_text else []
    labels, at = [0] * len(nodes), 0
    for i, node in enumerate(nodes):
        if node.text is not None and at < len(wanted) and node.text == wanted[at]:
            labels[i] = 1
            at += 1
    for i in range(len(nodes) - 1, 0, -1):
        labels[nodes[i].parent] |= labels[i]
    return labels


@functools.lru_cache(maxsize=4)
def trained(n: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """The model of so many labelled pages; trained once."""
    pages = []
    for page, text in labelled_pages(n, seed):
        nodes = parse(page)
        pages.append((nodes, labels_of(nodes, text)))
    return train(pages)


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page)
    chosen = [x.text for x, p in zip(nodes, model.marginals(nodes), strict=True) if x.text is not None and p >= 0.5]
    return "\n\n".join(chosen)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of pages: page_id, url, text. The model, a few kilobytes, goes along with the task."""
    model = model or trained()
    weights, potentials = model.weights, model.potentials

    def run(batches: Iterator):
        import pyarrow as pa

        own = Model(weights, potentials)
        for batch in batches:
            texts = [main_text(x.as_py(), own) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
