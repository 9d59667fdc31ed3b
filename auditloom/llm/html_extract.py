"""Main text of web pages by composite text density.

A page becomes a tree of elements. For each node with C characters and T tags
below it, of which LC and LT in links, the composite density is

    C / T * log_b(C / LC * T / LT),  b = ln(C * LC / (C - LC) + C_body_links * C / C_body + e)

(every zero divisor counts as one). A node's score is the sum of its
children's densities; the node with the greatest score is taken for the main
text, with those blocks beside the path from it to the body whose density
reaches the least density on that path, and the headings right before what is
taken. An article element counts a child by the child's score where that is
more than its density, so that an article in sections is not outdone by one of
its sections; nothing else depends on article or main elements.

Cut before that: elements that never show text (scripts, styles, menus of
options), and elements that call themselves boilerplate (navigation, footers,
forms, asides, notices, adverts, reader comments, by tag, role, class or id),
unless the main text may be in them: those that hold an article or main element,
and those, but navigation and footers, that hold half of the page's text or more
where the page has no article or main element, are left to the densities.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names and words of class names.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template textarea title iframe head select option input embed svg canvas map noembed noframes xmp audio video".split())
MENU_TAGS = frozenset("nav footer".split())
NAMED_TAGS = frozenset("aside form button label object dialog menu header".split())
BLOCKS = frozenset("html body p div article section main header h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr br fieldset details summary center hgroup search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
P_SCOPE = ("table", "td", "th", "button", "object")
#: A class or id is boilerplate if one of its words is of these and the others are mere parts of a layout.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices pagination paywall popup promo promotion related respond sharing share sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
PARTS = frozenset("area articles bar block bottom box button buttons column container content design first footer form global group header holder icons id inner item items last left line link links list main message mobile outer overlay page panel post posts primary right row secondary section sidebar site slot sticky top unit wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: Every attribute, so that a name is never looked for in another's name or value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "children", "parent", "named", "core", "chars", "tags", "link_chars", "link_tags", "density", "score")

    def __init__(self, tag: str, parent: Node | None, named: bool = False):
        self.tag, self.parent, self.named, self.children = tag, parent, named, []
        self.core = tag in ("article", "main")
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0


def _names_boilerplate(name: str) -> bool:
    words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
    return not words.isdisjoint(BOILERPLATE) and words <= BOILERPLATE | PARTS


def _named(tag: str, attributes: str, inside_article: bool) -> bool:
    """The element calls itself something other than main text."""
    if tag in MENU_TAGS or tag in NAMED_TAGS and not (tag == "header" and inside_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = values[0] or values[1] or values[2], name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name in ("class", "id") and any(map(_names_boilerplate, value.split())):
            return True
    return False


def parse(page: str) -> Node:
    """The tree below the body; children are nodes or strings. Bad nesting is repaired as browsers do for blocks.

    ``depths`` holds where each tag is open, so what a tag closes is found without walking up.
    """
    root = Node("body", None)
    path, depths, hidden = [root], {}, 0  # open elements; depths of each tag; how many of them are never shown
    articles, at, end = 0, 0, len(page)

    def close(depth: int) -> None:  # all from that depth on
        nonlocal articles, hidden
        while len(path) > depth:
            tag = path.pop().tag
            depths[tag].pop()
            articles -= tag in ("article", "main")
            hidden -= tag in DROPPED

    def deepest(tags: tuple[str, ...]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hidden:
            path[-1].children.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if depth := deepest((tag,)):
                close(depth)
            elif tag in ("p", "br") and not hidden:
                path[-1].children.append(Node("br", path[-1]))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and (depth := deepest(("p",))) > deepest(P_SCOPE):
            close(depth)
        if tag in IMPLIED and (depth := deepest(IMPLIED[tag])) > deepest(SCOPES[tag]):
            # the outermost of them: a row closes its cells
            close(min(depths[t][-1] for t in IMPLIED[tag] if depths.get(t) and depths[t][-1] > deepest(SCOPES[tag])))
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if hidden or tag in DROPPED:
            if tag in VOID:
                continue
            node = Node(tag, path[-1])
        else:
            node = Node(tag, path[-1], _named(tag, m[3], articles > 0))
            path[-1].children.append(node)
        if tag not in VOID:
            depths.setdefault(tag, []).append(len(path))
            path.append(node)
            articles += tag in ("article", "main")
            hidden += tag in DROPPED
    return root


def _order(root: Node) -> list[Node]:
    """Parents before children, in page order; no recursion, as pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def prune(root: Node) -> None:
    """Cut the elements that call themselves boilerplate, but where the main text may be in them."""
    nodes = _order(root)
    cores = sum(n.core for n in nodes)
    inside = {}
    for node in reversed(nodes):
        inside[id(node)] = node.core + sum(inside[id(x)] for x in node.children if isinstance(x, Node))
        node.chars = sum(x.chars if isinstance(x, Node) else len("".join(x.split())) for x in node.children)
    whole = root.chars
    for node in nodes:
        node.children = [x for x in node.children if isinstance(x, str) or not x.named or inside[id(x)] or not cores and x.tag not in MENU_TAGS and 2 * x.chars >= whole]


def measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.children:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += len("".join(x.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        node.density = 0.0
        if c:
            base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
            node.density = c / t * (math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(max(base, 1.0001)) if c * t > max(lc, 1) * max(lt, 1) else 0.0)
        article = node.tag == "article"
        node.score = sum(max(x.density, x.score) if article else x.density for x in node.children if isinstance(x, Node))
    return nodes


def select(root: Node) -> list[Node]:
    """The nodes, in page order, whose text is the main text."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: (n.score, n.density))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(p.density for p in path)
    taken = {id(best)}
    for below, above in zip(path, path[1:], strict=False):
        beside = [x for x in above.children if isinstance(x, Node)]
        keep = [x is below or x.chars > 0 and x.density >= least for x in beside]
        for i in range(len(beside) - 1, -1, -1):
            if beside[i].tag in HEADINGS and i + 1 < len(beside) and keep[i + 1]:
                keep[i] = True
        taken |= {id(x) for x, k in zip(beside, keep, strict=True) if k and x is not below}
    return [n for n in nodes if id(n) in taken]


def blocks(node: Node) -> list[str]:
    """White space inside a block is one space; blocks without text are left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return " ".join(b for node in select(root) for b in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one row for each row of ``pages`` (page_id, url, html; others are ignored).

    A null or empty page gives the empty text; ids and addresses are passed on
    as they are, null or repeated, and equal pages give equal texts. Long and
    deeply nested pages take time in proportion to their length. An empty table
    gives an empty result.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rows = pages.selectExpr("page_id", "url", "CAST(html AS string) AS html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
