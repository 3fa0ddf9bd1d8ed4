"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element (and inline element with a telling class) is a node with the label main text or not. Node potentials
come from its tag, class words, own text and link share, edge potentials from the labels of parent and child and the
child's kind. Sum-product messages, up to the root and down again, give exact marginals; the same messages give the
gradient with which the weights are trained on labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import generated_pages, labelled_pages

# Element names of the HTML standard by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: What can stand in a head; anything else closes it.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form table thead tbody tfoot tr td th caption blockquote pre figure "
    "figcaption dl dt dd address fieldset legend details summary center hgroup menu dialog button label hr head".split()
)
#: Which open elements a start tag closes, and where the search for them ends.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",),
}
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote button".split())
#: Words in class, id and role that speak for or against main text.
WORDS = {
    "against": r"nav|navbar|menu|breadcrumbs?|foot|footer|sidebar|side|widget|share|social|related|popular|recommended|newsletter|subscribe|signup|login|search|header|masthead|toolbar|pager|pagination|tags|skip|links",
    "advert": r"ads?|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|banner|inline-ad|outbrain|taboola",
    "notice": r"cookie|cookies|consent|notice|alert|gdpr|popup|modal|overlay|warning|paywall",
    "comment": r"comments?|disqus|disqus_thread|discussion|replies|reply|respond",
    "for": r"content|main|article|post|entry|story|body|text|body-text|article-body",
}
_WORDS = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?=$|[\s_-])") for k, v in WORDS.items()}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|data-label|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PLAIN = re.compile(r"class|id|role|data-label|hidden", re.I)


class Page:
    """Nodes in page order with their parents, and the pieces of text: (node, block, text)."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.words: list[tuple[str, ...]] = []
        self.label: list[int] = []
        self.own: list[int] = []
        self.linked: list[int] = []
        self.stops: list[bool] = []
        self.pieces: list[tuple[int, int, str]] = []

    def add(self, tag: str, parent: int, words: tuple[str, ...], label: int) -> int:
        self.tag.append(tag), self.parent.append(parent), self.words.append(words), self.label.append(label)
        self.own.append(0), self.linked.append(0), self.stops.append(False)
        return len(self.tag) - 1


class Tags:
    """The tags of a page in order: (start, end, closing, name, attributes); name None for comments and declarations.

    A quote in a tag hides a ">" up to the next such quote; a quote that is never closed hides nothing. What was once found
    to lead to the end of the page is not read again, so a page is read in time linear in its length.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.hopeless: set[int] = set()

    def _end(self, at: int) -> int:
        k, opened = at, []
        while m := _EDGE.search(self.source, k):
            if m[0] == ">":
                return m.start()
            opened.append(m.start())
            if m.start() in self.hopeless or m.start() == self.last[m[0]]:
                break
            k = self.source.find(m[0], m.end()) + 1
        self.hopeless.update(opened)
        return self.source.find(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """The next tag from ``at`` on."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, len(source) if end < 0 else end + 3, False, None, ""
            if at > self.last[">"]:
                return None
            if source[at + 1] in "!?":
                return at, source.find(">", at) + 1, False, None, ""
            closing = source[at + 1] == "/"
            name = _NAME.match(source, at + 1 + closing)
            if name and name.end() <= self.last[">"]:
                end = self._end(name.end())
                return at, end + 1, closing, name[0].lower(), source[name.end() : end]
            at += 1
        return None

    def raw_end(self, tag: str, at: int) -> int | None:
        """Where the end tag of an element of raw text ends."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.source, at) if at <= self.last[">"] else None
        return found.end() if found else None


def parse(source: str) -> Page:
    page = Page()
    root = page.add("html", -1, (), 0)
    stack: list[tuple[str, int]] = [("html", root)]  # open elements and the node that holds their text
    # Where elements of a name, of the kinds that end a search, and blocks stand in the stack.
    places: dict[str, list[int]] = defaultdict(list)
    scopes, blocks = [0], [0]
    links, block, at, from_here = 0, 0, 0, 0
    no_end: set[str] = set()
    tags = Tags(source)

    def text(piece: str):
        if not piece or stack[-1][0] == "head" and not piece.strip():
            return
        if stack[-1][0] == "head":  # its end tag may be left out
            closed(len(stack) - 1)
        piece = html.unescape(piece)
        node = stack[-1][1]
        size = len(piece.strip())
        page.own[node] += size
        if links:
            page.linked[node] += size
        if size:
            page.stops[node] = piece.rstrip()[-1] in ".!?…:;\"'”"
        page.pieces.append((node, block, piece))

    def opened(tag: str, node: int):
        for kind in (places[tag], *([scopes] if tag in SCOPE else []), *([blocks] if tag in BLOCK else [])):
            kind.append(len(stack))
        stack.append((tag, node))

    def closed(down_to: int):
        nonlocal links, block
        while len(stack) > down_to:
            name, _ = stack.pop()
            for kind in (places[name], scopes, blocks):
                if kind and kind[-1] == len(stack):
                    kind.pop()
            if name == "a":
                links -= 1
            elif name in BLOCK:
                block += 1

    while found_tag := tags.after(from_here):
        start, from_here, closing, tag, attrs = found_tag
        if start > at:
            text(source[at:start])
        at = from_here
        if not tag:
            continue
        if closing:
            if places[tag] and (tag in BLOCK or places[tag][-1] > blocks[-1]):
                closed(places[tag][-1])
            continue
        if stack[-1][0] == "head" and tag not in HEAD and tag not in ("html", "head"):
            closed(len(stack) - 1)
        if tag in RAW:
            if attrs.endswith("/") and (places["svg"] or places["math"]):
                continue
            stop = None if tag in no_end else tags.raw_end(tag, at)
            if stop is None:
                no_end.add(tag)
            if stop or tag != "noscript":  # as browsers do, but for a noscript, which holds ordinary markup
                at = from_here = stop or len(source)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag == "html" and (given := re.search(r'data-label="([01])"', attrs)):
            page.label[root] = int(given[1])
        if tag == "html" or tag == "head" and len(stack) > 1:
            continue
        ends = max((places[name][-1] for name in CLOSES.get(tag, ()) if places[name]), default=0)
        if ends and ends >= scopes[-1]:
            closed(ends)
        node, label = stack[-1][1], page.label[stack[-1][1]]
        found: dict[str, str] = {}
        if attrs and _PLAIN.search(attrs):
            for m in _ATTRIBUTE.finditer(attrs):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        named = " ".join(found.get(x, "") for x in ("class", "id", "role")).lower().strip()
        words = tuple(k for k, v in _WORDS.items() if v.search(named)) if named else ()
        if "hidden" in found or found.get("aria-hidden") == "true" or tag == "template":
            words = (*words, "notice") if "notice" not in words else words
        if tag in BLOCK or (words and words != ("for",)):
            node = page.add(tag, node, words, int(found["data-label"]) if found.get("data-label") in ("0", "1") else label)
        links += tag == "a"
        block += tag in BLOCK
        opened(tag, node)
        if attrs.endswith("/") and tag not in BLOCK:
            closed(len(stack) - 1)
    if at < len(source):
        text(source[at:])
    return page


_GROUP = {**dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), "h"), **dict.fromkeys("td th tr tbody thead tfoot table caption".split(), "table"), **dict.fromkeys("ul ol dl menu".split(), "list"), **dict.fromkeys("li dt dd".split(), "item")}


def features(page: Page) -> list[tuple[list[str], str]]:
    """Per node its features, and the kind of its edge to the parent."""
    n = len(page.tag)
    size, linked = page.own[:], page.linked[:]
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        linked[page.parent[k]] += linked[k]
    out = []
    # What kinds of boilerplate a node stands in.
    under: list[frozenset[str]] = []
    inside: list[bool] = []  # an article, a main or what names itself so
    for k in range(n):
        inside.append(page.tag[k] in ("article", "main") or "for" in page.words[k] or (inside[page.parent[k]] if k else False))
        own_kind = {w for w in page.words[k] if w != "for"} | ({page.tag[k]} & {"nav", "footer", "form", "aside", "header"})
        above = under[page.parent[k]] if k else frozenset()
        under.append(above | own_kind if own_kind else above)
    bare = not any(t in ("article", "main") for t in page.tag) and not any("for" in w for w in page.words)
    for k in range(n):
        group = _GROUP.get(page.tag[k], page.tag[k])
        own = page.own[k]
        share = linked[k] / size[k] if size[k] else -1
        has = ["bias", f"tag={group}", "own=" + ("0" if not own else "1" if own < 25 else "2" if own < 90 else "3" if own < 300 else "4")]
        has.append("links=" + ("none" if share <= 0 else "few" if share < 0.3 else "some" if share < 0.7 else "all"))
        if own and page.stops[k]:
            has.append("stops")
        if bare:  # no element of the page names itself the main one
            has.append(f"bare={group}")
        if k and inside[page.parent[k]] and not under[page.parent[k]]:  # of the main part, and of nothing that is set apart in it
            has += ["in main", f"in main={group}", "in main, " + has[3]]
        if not k or page.tag[k] == "body":
            has.append("text of the page" if own else "no text of the page")
        has += [f"word={w}" for w in page.words[k]]
        has += [f"under={x}" for x in sorted(under[page.parent[k]])] if k else []
        bad = any(w != "for" for w in page.words[k])
        # Inside a named container the parent's label decides more than the text does.
        kind = "bad" if bad else "for" if page.words[k] else group if group in ("nav", "footer", "header", "aside", "form", "article", "main", "h", "section", "button", "label") else "text" if group in ("p", "pre", "blockquote", "item", "table", "list", "figure", "figcaption") else "other"
        out.append((has, kind))
    return out


def marginals(parent: list[int], node: list[float], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(label 1) per node and P(parent label, label) per edge, in the order 00, 01, 10, 11.

    ``node``: log potential of label 1 against 0; ``edge``: log potentials. Nodes come after their parents. Messages are
    kept as normalised pairs, so trees of any depth stay in range.
    """
    n = len(parent)
    phi = [(1.0, math.exp(x)) if x < 0 else (math.exp(-x), 1.0) for x in node]
    psi = [tuple(map(math.exp, e)) for e in edge]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    belief = phi[:]
    for k in range(n - 1, 0, -1):
        b0, b1 = belief[k]
        e = psi[k]
        m0, m1 = e[0] * b0 + e[1] * b1, e[2] * b0 + e[3] * b1
        s = m0 + m1
        up[k] = (m0 / s, m1 / s)
        p0, p1 = belief[parent[k]]
        p0, p1 = p0 * up[k][0], p1 * up[k][1]
        s = p0 + p1
        belief[parent[k]] = (p0 / s, p1 / s)
    pairs: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
    full = belief[:]
    for k in range(1, n):
        # The parent's full belief without what this child told it; down through the edge.
        p0, p1 = full[parent[k]]
        p0, p1 = p0 / max(up[k][0], 1e-300), p1 / max(up[k][1], 1e-300)
        b0, b1 = belief[k]
        e = psi[k]
        j = (p0 * e[0] * b0, p0 * e[1] * b1, p1 * e[2] * b0, p1 * e[3] * b1)
        s = sum(j)
        pairs[k] = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
        full[k] = (pairs[k][0] + pairs[k][2], pairs[k][1] + pairs[k][3])
    return [b1 / (b0 + b1) for b0, b1 in full], pairs


def potentials(page: Page, weights: dict[str, float]) -> tuple[list[float], list[tuple[float, float, float, float]], list[tuple[list[str], str]]]:
    told = features(page)
    get = weights.get
    node = [sum(get(f, 0.0) for f in has) for has, _ in told]
    # What holds for all edges, and what a kind of child adds to it.
    edge = [tuple(get(f"any:{ab}", 0.0) + get(f"{kind}:{ab}", 0.0) for ab in ("00", "01", "10", "11")) for _, kind in told]
    return node, edge, told


def train(pages: list[str], rounds: int = 80, rate: float = 0.5, l2: float = 0.005) -> dict[str, float]:
    """Weights of most likelihood of the pages' labels, by gradient ascent with adaptive steps."""
    parsed = [parse(p) for p in pages]
    weights: dict[str, float] = {}
    squared: dict[str, float] = {}
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        for page in parsed:
            node, edge, told = potentials(page, weights)
            one, pairs = marginals(page.parent, node, edge)
            for k, (has, kind) in enumerate(told):
                y = page.label[k]
                for f in has:
                    gradient[f] = gradient.get(f, 0.0) + y - one[k]
                if k:
                    seen = 2 * page.label[page.parent[k]] + y
                    for j, ab in enumerate(("00", "01", "10", "11")):
                        for f in (f"any:{ab}", f"{kind}:{ab}"):
                            gradient[f] = gradient.get(f, 0.0) + (seen == j) - pairs[k][j]
        for f, g in gradient.items():
            g -= l2 * weights.get(f, 0.0)
            squared[f] = squared.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) + rate * g / (1e-6 + math.sqrt(squared[f]))
    return weights


def main_text(source: str, weights: dict[str, float], least: float = 0.5) -> str:
    page = parse(source)
    node, edge, _ = potentials(page, weights)
    one, _ = marginals(page.parent, node, edge)
    blocks: list[str] = []
    held: list[str] = []
    last = -1
    for k, block, piece in [*page.pieces, (0, -2, "")]:
        if block != last:
            if line := " ".join("".join(held).split()):
                blocks.append(line)
            held, last = [], block
        if one[k] >= least:
            held.append(piece)
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``: the main text of each page's whole html.

    ``labelled``: pages to train on (a bounded list; the written and the generated ones if not given). Null and empty pages have an empty
    text; tags that do not close, and what is no HTML at all, are read as browsers do: unknown tags are inline, stray
    text belongs to the body. Rows that repeat give equal rows.
    """
    weights = train([*labelled_pages(), *generated_pages()] if labelled is None else labelled)
    given = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column("_html")]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return given.mapInArrow(run, schema)


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
