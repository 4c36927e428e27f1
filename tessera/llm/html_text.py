"""Main text of web pages by tree scoring.

The page's tags become a tree of block elements; runs of inline content between block boundaries are its
paragraphs. Elements that never belong to an article (scripts, forms, menus, page headers and footers, asides, by
tag, role or name) are taken out. Every paragraph gives points for itself, its length and its commas to its
container, half to the next ancestor, and so on; each container's sum is discounted by its share of linked text. The
best container and those siblings that read like it are kept, and their paragraphs are joined in page order.

A null or empty page gives an empty text; texts are read whole, in time linear in their length; broken
markup is closed as browsers close it; repeated rows give a row each; columns besides the three are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import unused

# A tag's attributes: quotes count only after an equals sign, and the end of the page ends everything.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Content that is no markup, up to the end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main map menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul video audio canvas math".split()
)
#: A start tag that ends an open element of these names, unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements that may stand in a paragraph.
PHRASING = {"object", "button", "map", "svg", "video", "audio", "canvas", "option", "optgroup", "select", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = {"head", "nav", "aside", "footer", "menu", "dialog", "button", "select", "option", "optgroup", "legend", "object", "svg", "video", "audio", "canvas", "map", "search", "form", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form", "status"}
#: Names (of a class or id, split at case and punctuation) of what is no article.
UNLIKELY = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist disqus discussion respond replies reply reactions"
    " cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay lightbox toast newsletter subscribe subscription signup login register promo promotion promoted"
    " sponsor sponsored sponsors sidebar sidebars menu navbar navigation nav topnav navi pagination pager share sharing social related recommended recommendations trending"
    " masthead footer footnav toolbar skip rss outbrain taboola paywall teaser feedback survey donate leaderboard".split()
)
#: Those that count as a whole class or id only, and those that turn a name into its opposite.
WHOLE, OPPOSITE = {"widget", "widgets", "hidden", "header"}, {"has", "with", "no", "not", "without"}
LIKELY = {"article", "body", "content", "entry", "main", "post", "story", "text", "prose"}
#: Characters of a paragraph for one more point, the most points for length, and what a sibling needs of the best score.
LENGTH, MOST_LENGTH, SHARE, LEAST = 100, 3, 0.2, 3.0
#: A form that wraps the page instead of asking has so many paragraphs of over LONG characters.
FORM, LONG = 3, 80


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    out: bool = False  # dropped by tag, role or name
    likely: bool = False
    links: int = 0  # anchors that start in it, then in its subtree too
    blocks: int = 0  # paragraphs in its subtree
    chars: int = 0
    linked: int = 0
    points: float = 0.0
    scope: bool = False  # an open paragraph would be ended by a block in it
    core: bool = False  # an article or main element stands in its subtree


@dataclass(slots=True)
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node("html", -1)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # container, text, characters in links


def traits(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """(taken out, likely to be the text, hidden) by the attributes of a start tag."""
    names, role, hidden, whole = set(), "", False, False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for one in html.unescape(value).split():
                parts = {w.lower() for w in _NAME.findall(one)}
                names |= parts if not parts & OPPOSITE else set()
                whole |= one.lower() in WHOLE
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style":
            style = re.sub(r"\s", "", value.lower())
            hidden |= "display:none" in style or "visibility:hidden" in style
        elif key == "itemprop" and value.lower() == "articlebody":
            role = "main"
    bad = bool(names & UNLIKELY) or whole or role in ROLES
    return bad and tag not in ("html", "body", "main"), role == "main" or bool(names & LIKELY), hidden and tag not in ("html", "body")


def parsed(page: str) -> Tree:
    """The block elements of a page and its paragraphs, white space made single and references decoded."""
    tree = Tree()
    nodes, stack = tree.nodes, [0]
    text: list[str] = []
    linked: list[str] = []
    opened: dict[str, int] = {}  # open elements by name
    link = 0  # the depth of the block that an open link began in, 0 if none is open
    gone: list[str] = []  # open inline elements from one that is taken out on
    deep = 0  # the depth of the block it began in

    def flush():
        nonlocal text, linked
        if text:
            run = " ".join("".join(text).split())
            if run:
                tree.blocks.append((stack[-1], run, len(" ".join("".join(linked).split())) if linked else 0))
            text, linked = [], []

    def close(names, barrier=frozenset()):
        nonlocal link
        if not any(opened.get(t) for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                flush()
                for k in stack[i:]:
                    opened[nodes[k].tag] -= 1
                del stack[i:]
                link = link if link <= i else 0
                if deep > i:
                    gone.clear()
                return
            if tag in barrier:
                return

    def say(raw: str):
        if raw and not gone:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if link:
                linked.append(raw)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[1]:
            continue
        tag = m[1].lower()
        if page.startswith("</", lt):
            if tag == "a":
                link = 0
            elif tag == "br":
                say(" ")
            elif tag in HEADINGS:
                close(HEADINGS)
            elif tag in BLOCKS and tag not in ("html", "body"):
                close({tag}, {"td", "th"} if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th") else {"table"} if tag != "table" else frozenset())
            elif gone:
                if tag in gone:
                    del gone[len(gone) - 1 - gone[::-1].index(tag) :]
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            say(" ")
            at = stop.start() if stop else end
            if stop and (m := _TAG.match(page, at)):
                at = m.end()
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            say(" " if tag == "br" else "")
            continue
        if tag not in BLOCKS:
            if tag == "a":
                if "href" in m[2].lower():
                    link = len(stack)
                    nodes[stack[-1]].links += 1
            if gone:
                gone.append(tag)
            elif m[2] and not page.startswith("/>", at - 2):
                out, _, hidden = traits(tag, m[2])
                if out or hidden:
                    gone.append(tag)
                    deep = len(stack)
            continue
        flush()
        if tag != "html":
            close({"head"})
        if tag in ENDS:
            close(*ENDS[tag])
        elif nodes[stack[-1]].scope and tag not in PHRASING:
            close({"p"})
        if tag in ("hr", "html"):
            continue
        out, likely, hidden = traits(tag, m[2])
        scope = tag == "p" or nodes[stack[-1]].scope and tag not in ("button", "object", "table", "td", "th", "caption")
        nodes.append(Node(tag, stack[-1], out or hidden or bool(gone) or tag in DROPPED, likely, scope=scope))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in ("article", "main") and not (out or hidden):
            nodes[-1].core = True
        stack.append(len(nodes) - 1)
    flush()
    return tree


def main_blocks(tree: Tree) -> list[str]:
    """The paragraphs of the best container and of its siblings that read like it."""
    nodes, blocks = tree.nodes, tree.blocks
    for c, run, linked in blocks:
        nodes[c].chars += len(run)
        nodes[c].linked += linked
        nodes[c].blocks += 1
    inside = [False] * len(nodes)  # an article or main element stands above it
    long = [0] * len(nodes)
    for c, run, _ in blocks:
        long[c] += nodes[c].tag == "p" and len(run) > LONG
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        nodes[p].core |= nodes[i].core
        long[p] += long[i]
    for i, n in enumerate(nodes[1:], 1):
        p = n.parent
        inside[i] = inside[p] or nodes[p].tag in ("article", "main")
        wraps = n.core and n.tag != "article" or n.tag == "form" and long[i] >= FORM
        if wraps and n.tag not in ("nav", "footer", "aside"):
            n.out = False
        elif n.tag == "header":  # that of the page goes, that of an article is left with its headings
            n.out = n.out or not inside[i]
        n.out = n.out or nodes[p].out
    # what is taken out counts for nothing from here on
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        if not n.out:
            p.chars, p.linked, p.blocks, p.links = p.chars + n.chars, p.linked + n.linked, p.blocks + n.blocks, p.links + n.links
    for i, n in enumerate(nodes[1:], 1):  # lists of links are menus
        n.out = n.out or nodes[n.parent].out or n.tag in ("ul", "ol", "dl", "table", "div", "section") and not n.core and n.links > 1 and n.linked * 10 > n.chars * 6

    def holder(c: int) -> int:
        """The container that a paragraph in element ``c`` gives its points to."""
        while nodes[c].tag in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt", "tr", "figcaption", "address") or nodes[c].tag in HEADINGS:
            c = nodes[c].parent
        return c

    def keeps(c: int) -> bool:
        """No header of an article stands between, but for its headings."""
        return not nodes[c].out and (nodes[c].tag in HEADINGS or not heads[c])

    heads = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        heads[i] = heads[n.parent] or n.tag == "header"
    held = {}
    for c, run, linked in blocks:
        if keeps(c):
            if c not in held:
                held[c] = holder(c)
            point = 0.2 if nodes[c].tag in HEADINGS else 1 + run.count(",") + min(len(run) // LENGTH, MOST_LENGTH)
            nodes[held[c]].points += point * (1 - linked / len(run))
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].points += nodes[i].points / 2
    best, top = -1, 0.0
    score = [0.0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.points and not n.out:
            score[i] = n.points * (1 - n.linked / max(1, n.chars)) * (1.5 if n.likely or n.tag in ("article", "main") else 1)
            if score[i] > top:
                best, top = i, score[i]
    if best < 0:
        return []
    up, core = best, -1
    while up > 0:  # a part of an article stands for all of it
        if nodes[up].tag == "article" or nodes[up].tag == "main" and core < 0:
            core = up
            if nodes[up].tag == "article":
                break
        up = nodes[up].parent
    best = core if core >= 0 else best

    def like(i: int) -> bool:
        n = nodes[i]
        if n.out or not n.chars:
            return False
        density = n.linked / n.chars
        if core >= 0:
            return n.tag == nodes[best].tag and score[i] >= SHARE * top
        if n.tag == "h1":
            return density < 0.25
        if n.tag in ("p", "pre", "blockquote"):
            return density < 0.25 and (n.chars > 80 or n.points > 0 or density == 0)
        return score[i] >= max(LEAST, SHARE * top)

    kept = [False] * len(nodes)
    for i, n in enumerate(nodes):
        kept[i] = i == best or i > 0 and (kept[n.parent] or best > 0 and n.parent == nodes[best].parent and like(i))
    return [run for c, run, _ in blocks if kept[c] and keeps(c)]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(parsed(page))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in a column ``name``, which replaces one of that name; no shuffle."""
    (own,) = unused(pages, "main_text")
    at = pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, own])

    found = pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(own, StringType())]))
    return found.drop(name).withColumnRenamed(own, name) if name in pages.columns else found.withColumnRenamed(own, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
