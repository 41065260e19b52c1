"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with the path of block elements from the root to it. Over the
nodes of a path the lengths, punctuation marks and link characters are summed. A path's ratio is its
mean text length times its mean punctuation, lowered by the share of link text and fused with what
its elements say about themselves (an article counts for more; menus, forms and the like for
nothing). Ratios are smoothed along the page and thresholded against their spread; what exceeds the
threshold, smoothed and by itself, is the core. The content is every node, however short, of the declared article that holds
the core, else of the innermost element that holds all of it, without what was ruled out.

One forward cursor cuts the markup; elements are numbers with the number of their parent, and paths are
numbered likewise, so time and memory are in proportion to the page, however deep or broken it is.
Pages are independent, so the job is one map.

Edge cases. Null or empty html: empty text. Text without markup is content. Unclosed and misnested
elements are closed as browsers close them in the common cases. A tag with a quote that never ends is
cut at its first `>`; without one it is text. Null or repeated ids: each row by
itself. Other columns are ignored. Empty table: empty result."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import text_batches

# Elements whose text is never article text.
RAW = {"script", "style", "title", "template", "textarea", "noscript", "iframe", "svg", "math", "canvas", "object", "audio", "video", "select", "datalist"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "label", "input"}
# Elements inside a line of text; they do not part blocks.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
# Elements without content.
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
# What a start tag closes first, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "body": ({"head"}, set()),
}
# Words in class, id and role that name something other than the article.
ASIDE_WORDS = {
    "ad", "adbox", "ads", "adslot", "advert", "advertisement", "advertising", "adverts", "alert", "announcement", "banner", "breadcrumb",
    "breadcrumbs", "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright",
    "dialog", "discussion", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo",
    "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
}
# Words that turn such a name into one of a wrapper, a state or a title.
WRAPPER_WORDS = {"content", "article", "with", "without", "no", "has", "long", "work", "works", "open", "closed", "enabled", "disabled", "layout"}
TITLE_WORDS = {"post", "entry", "story", "title", "page", "heading"}
# Names of that kind that wrappers and sections of articles bear as well. Such an element is
# content after all if its text, counted at a quarter, outweighs the rest of the page.
LOOSE_WORDS = {"discussion", "form", "header", "notice", "notices", "promo", "related", "search", "share", "sharing", "social", "widget"}
LOOSE_ELEMENTS = {"form", "fieldset"}
LOOSE_SHARE = 4
CONTENT_ELEMENTS = {"article", "main"}
CRUMB = 8
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?…。，；：！？]")


class Element:
    __slots__ = ("name", "path", "number", "out", "inside")

    def __init__(self, name: str, path: int, number: int, out: int, inside: int) -> None:
        self.name, self.path, self.number, self.out, self.inside = name, path, number, out, inside


class Node:
    """A run of text in one block: numbers of its tag path and of its element, the outermost declared
    article (0 for none), text, link characters."""

    __slots__ = ("path", "at", "out", "inside", "parts", "link")

    def __init__(self, at: Element) -> None:
        self.path, self.at, self.out, self.inside = at.path, at.number, at.out, at.inside
        self.parts: list[str] = []
        self.link = 0


class Stack:
    """Open elements, and the places of each name among them."""

    def __init__(self, root: Element) -> None:
        self.open, self.places = [root], defaultdict(list)

    @property
    def top(self) -> Element:
        return self.open[-1]

    def push(self, element: Element) -> None:
        self.places[element.name].append(len(self.open))
        self.open.append(element)

    def innermost(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def close(self, names: Iterable[str], stops: Iterable[str] = ()) -> None:
        """Close the innermost element of these names, and what is in it, if none of the stops is nearer."""
        at = self.innermost(names)
        if at > self.innermost(stops):
            while len(self.open) > at:
                self.places[self.open.pop().name].pop()


def markup(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Markup of a page in order: begin, end, whether it is an end tag, name (empty for comments and raw
    elements), attributes. Everything is looked at a bounded number of times: a tag that ends moves the
    cursor behind it, and of a tag that does not the opening quotes are remembered, since no tag that
    meets one of them ends either."""
    dead: set[int] = set()
    last = html.rfind(">")
    size = len(html)

    def tag_end(at: int) -> int:
        """Position behind the first `>` outside of quotes, -1 if there is none."""
        opened = []
        while True:
            stop = _STOP.search(html, at)
            if stop is not None and stop[0] == ">":
                return stop.end()
            close = -1
            if stop is not None and stop.start() not in dead:
                opened.append(stop.start())
                close = html.find(stop[0], stop.end())
            if close < 0:
                dead.update(opened)
                return -1
            at = close + 1

    at = html.find("<")
    while at >= 0:
        end = -1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            end = size if end < 3 else end
            yield at, end, False, "", ""
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at + 2) + 1 or size
            yield at, end, False, "", ""
        elif at < last and (m := _TAG.match(html, at)):
            name, ends = m[2].lower(), bool(m[1])
            end = tag_end(m.end())
            if end > 0 and not ends and name in RAW:
                if not (name in ("svg", "math") and html[end - 2] == "/"):
                    close = _RAW_END[name].search(html, end)
                    end = close.end() if close else size
                yield at, end, False, "", ""
            else:
                end = end if end > 0 else html.find(">", m.end()) + 1
                if end > 0:
                    yield at, end, ends, name, html[m.end() : end - 1]
        at = html.find("<", end if end > 0 else at + 1)


KEPT, LOOSE, NAMED, OUT = range(4)  # what an element says of itself: nothing, or how surely it is ruled out


def says_aside(name: str, attributes: str, inside: int) -> int:
    """Whether, and how surely, an element names itself as something other than the article."""
    if name in LOOSE_ELEMENTS:
        found = LOOSE
    elif name in BOILERPLATE or (name == "header" and not inside):
        return OUT
    else:
        found = KEPT
    if not attributes:
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NO_DISPLAY.search(value)):
            return OUT
        if key not in ("class", "id", "role") or name in ("html", "body") or name in HEADINGS:
            continue
        for token in value.split():
            words = [w.lower() for w in _WORDS.findall(token)]
            named = ASIDE_WORDS.intersection(words)
            # a wrapper named after its place (`content-with-sidebar`) or state (`comments-open`) is not that thing
            if not named or WRAPPER_WORDS.intersection(words) or (named == {"header"} and TITLE_WORDS.intersection(words)):
                continue
            # the id of a section of the article is its heading's
            if key == "id" and name == "section" and inside and named <= LOOSE_WORDS:
                continue
            found = max(found, LOOSE if named <= LOOSE_WORDS else NAMED)
    return found


def text_nodes(html: str, spared: frozenset[int] = frozenset()) -> tuple[list[Node], list[int]]:
    """The text nodes of a page in order, and the parent of each element by number (the root is 0, a parent
    comes before its children). `out` is 0 for content, the number of the outermost element that rules the
    node out by a loose name, or -1 where others do; elements in `spared` do not."""
    stack, parents, nodes = Stack(Element("", 0, 0, 0, 0)), [-1], []
    paths: dict[tuple[int, str], int] = {}
    node: Node | None = None
    links = at = 0

    def add(text: str) -> None:
        nonlocal node
        if not text:
            return
        if node is None or node.at != stack.top.number:
            node = Node(stack.top)
            nodes.append(node)
        node.parts.append(text)
        if links > 0:
            node.link += len(text)

    for begin, end, ends, name, attributes in markup(html):
        add(html[at:begin])
        at = end
        if not name:
            continue
        top = stack.top
        if name in INLINE and not (name not in ("a", "img") and not ends and attributes and says_aside(name, attributes, top.inside)):
            if name == "a":
                links = max(0, links - 1) if ends else links + 1
            if name != "wbr" and ends and top.name == name:
                stack.close((name,))
                node = None
            continue
        node = None  # a block boundary
        if ends:
            stack.close((name,))
            links = 0
            continue
        if name in VOID:
            continue
        links = 0
        if any(e.name == "p" for e in stack.open[-2:]):
            stack.close(("p",))
        if name in CLOSES:
            stack.close(*CLOSES[name])
        top = stack.top
        number = len(parents)
        parents.append(top.number)
        says = says_aside(name, attributes, top.inside)
        # below a loose name a sure one still counts; what it rules out does not speak for the element
        out = -1 if top.out < 0 or says > LOOSE else top.out or (number if says and number not in spared else 0)
        path = paths.setdefault((top.path, name), len(paths) + 1)
        stack.push(Element(name, path, number, out, top.inside or (number if name in CONTENT_ELEMENTS else 0)))
    add(html[at:])
    return nodes, parents


def main_text(html: str | None) -> str:
    if not html:
        return ""
    spared: frozenset[int] = frozenset()
    while True:
        kept, loose, longest = [], {}, {}
        nodes, parents = text_nodes(html, spared)
        for node in nodes:
            if node.out < 0:
                continue
            text = "".join(node.parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if not text:
                continue
            if node.out:
                loose[node.out] = loose.get(node.out, 0) + max(0, len(text) - node.link)
                longest[node.out] = max(longest.get(node.out, (0, 0)), (len(text), node.at))
            else:
                kept.append((node, text))
        most = max(loose, key=loose.get, default=0)
        if not most or loose[most] <= LOOSE_SHARE * sum(len(text) for _, text in kept):
            return " ".join(text for _, text in choose(kept, parents))
        around, at = set(), longest[most][1]  # with what is around its longest text, so the rounds are few
        while at > 0:
            around.add(at)
            at = parents[at]
        spared = spared | around


def choose(nodes: list[tuple[Node, str]], parents: list[int]) -> list[tuple[Node, str]]:
    """Content nodes among the nodes that are not ruled out."""
    if len(nodes) < 2:
        return nodes
    sums: dict[int, list[float]] = {}
    for node, text in nodes:
        s = sums.setdefault(node.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_MARKS.findall(text))
        s[3] += min(node.link, len(text))
    ratio = {p: (chars / n) * math.log(2 + marks / n) * (1 - links / chars) for p, (n, chars, marks, links) in sums.items()}
    # an article that says so, unless it is a crumb beside the rest of the page, counts for more
    own: dict[int, int] = {}
    for node, text in nodes:
        own[node.inside] = own.get(node.inside, 0) + len(text)
    total = sum(own.values())
    weights = [ratio[node.path] * (4.0 if node.inside and CRUMB * own[node.inside] >= total else 1.0) for node, _ in nodes]
    smooth = [
        (w * 2 + weights[max(0, k - 1)] + weights[min(len(weights) - 1, k + 1)]) / 4 for k, w in enumerate(weights)
    ]
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((w - mean) ** 2 for w in smooth) / len(smooth))
    threshold = min(spread, 0.5 * max(smooth))
    core = [k for k, w in enumerate(smooth) if min(w, weights[k]) >= threshold and weights[k] > 0] or list(range(len(nodes)))
    # an element that says it is the article is one if it holds the core, its own text counting for more;
    # all of it is content then, and so is every other such element with a part of the core
    held: dict[int, int] = {}
    for k in core:
        held[nodes[k][0].inside] = held.get(nodes[k][0].inside, 0) + len(nodes[k][1])
    best = max((n for unit, n in held.items() if unit), default=0)
    if best and 4 * best >= sum(held.values()) - best:
        return [(node, text) for node, text in nodes if node.inside and node.inside in held]
    # elsewhere: the innermost element that holds every core node
    holders = {nodes[k][0].at for k in core}
    if len(holders) == 1:
        # a single block is not a container: its parent is, with the headings beside it
        whole = max(0, parents[holders.pop()])
    else:
        below = [0] * len(parents)
        for k in core:
            below[nodes[k][0].at] += 1
        whole = len(parents) - 1
        while whole > 0 and below[whole] < len(core):
            below[parents[whole]] += below[whole]
            whole -= 1
    within = [k == whole for k in range(len(parents))]
    for k in range(1, len(parents)):
        within[k] = within[k] or within[parents[k]]
    return [(node, text) for node, text in nodes if within[node.at]]


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text and n_chars."""

    def texts(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    made = text_batches(pages).select("page_id", "url", F.pandas_udf(texts, "string")(F.col("html").cast("string")).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
