"""A tolerant reader of HTML block structure, with features of every block node."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

# Element kinds and attribute words.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
VOID = {"hr"}
# Elements whose content HTML reads as raw text: up to their end tag or, without one, to the end.
RAW = "script|style|noscript|title|textarea|iframe"
TAG_GROUPS = {
    "p": ["p"],
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"],
    "item": ["li", "dt", "dd"],
    "list": ["ul", "ol", "dl", "menu"],
    "box": ["div", "center", "section", "details"],
    "main": ["article", "main"],
    "nav": ["nav"],
    "footer": ["footer"],
    "header": ["header"],
    "aside": ["aside", "dialog"],
    "form": ["form", "fieldset", "legend"],
    "table": ["table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"],
    "quote": ["blockquote", "pre", "figure", "figcaption"],
}
WORD_GROUPS = {
    "nav": "nav menu breadcrumb breadcrumbs pager pagination toc navbar navigation skip tags".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense adslot".split(),
    "footer": "footer foot copyright legal colophon".split(),
    "header": "header masthead topbar logo branding hero".split(),
    "side": "sidebar side aside rail widget widgets related recommend recommended trending popular teaser".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall".split(),
    "form": "form search login signin contact".split(),
    "comment": "comment comments reply replies disqus discussion respond reader feedback".split(),
    "share": "share sharing social follow meta byline".split(),
    "content": "article content main post entry story body text page single maincontent".split(),
}
GROUP_OF = {w: g for g, words in WORD_GROUPS.items() for w in words}
TAG_OF = {t: g for g, tags in TAG_GROUPS.items() for t in tags}

# A raw tag that ends in "/>" is empty unless its end tag comes before the next one like it. A template is no
# part of the page, if it is closed; without an end tag it is a tag like others.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<template(?=[\s/>])(?:(?!<template[\s/>]).)*?</template\s*>"
    rf"|<(?P<empty>{RAW})(?=[\s/>])(?>(?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(?=>)|[^>]*)(?<=/)>"
    r"(?:(?:(?!<(?P=empty)[\s/>]).)*?</(?P=empty)\s*>)?"
    rf"|<(?P<raw>{RAW})(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(?=>)|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""(class|id|role|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: frozenset
    keep: str | None = None
    first: int = 0  # characters of the page before the node
    chars: int = 0
    own: int = 0
    linked: int = 0
    links: int = 0
    tags: int = 0
    stops: int = 0
    inputs: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, str]]  # node and text, in page order


def parse(source: str) -> Page:
    """Block nodes in page order (the first is the root) and the text between block boundaries."""
    nodes = [Node("root", -1, 0, frozenset())]
    stack, runs, parts = [0], [], []
    seen = linked = 0
    link = False

    def flush() -> None:
        nonlocal seen, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.linked += min(linked, len(text))
                node.stops += sum(text.count(c) for c in ".!?;:,")
                runs.append((stack[-1], text))
                seen += len(text)
            linked = 0

    def close(tag: str, stop: set[str] | None = None) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = nodes[stack[i]].tag
            if name == tag:
                flush()
                del stack[i:]
                return
            if stop and name in stop:
                return

    for m in TOKEN.finditer(source):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if link:
                linked += len(text.strip())
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            node = nodes[stack[-1]]
            if tag in ("option", "select"):
                parts.append(" ")
            if m["end"]:
                link = link and tag != "a"
            else:
                node.tags += 1
                if tag == "a":
                    link, node.links = True, node.links + 1
                elif tag == "input":
                    node.inputs += 1
                elif tag == "br":
                    parts.append(" ")
            continue
        link = False
        if m["end"]:
            close(tag)
            continue
        flush()
        # What a start tag ends without an end tag.
        if tag == "li":
            close("li", {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            close("dt", {"dl"})
            close("dd", {"dl"})
        elif tag in ("td", "th", "tr", "tbody"):
            for other in {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("tr", "tbody", "thead")}[tag]:
                close(other, {"table"})
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        found = {a.lower(): x or y or z for a, x, y, z in ATTR.findall(m["attrs"])} if m["attrs"] else {}
        words = {w.lower() for a in ("class", "id", "role") for w in PIECES.findall(found.get(a, ""))}
        nodes[stack[-1]].children.append(len(nodes))
        nodes.append(
            Node(tag, stack[-1], len(stack), frozenset(GROUP_OF[w] for w in words if w in GROUP_OF), found.get("data-keep"), seen)
        )
        if tag not in VOID:
            stack.append(len(nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.chars += node.own
        if i:
            parent = nodes[node.parent]
            parent.chars += node.chars
            parent.linked += node.linked
            parent.links += node.links
            parent.tags += node.tags + 1
            parent.stops += node.stops
            parent.inputs += node.inputs
    return Page(nodes, runs)


TAGS, WORDS = list(TAG_GROUPS), list(WORD_GROUPS)
NAMES = (
    [f"tag_{t}" for t in TAGS]
    + [f"above_{t}" for t in TAGS]
    + [f"word_{w}" for w in WORDS]
    + [f"above_word_{w}" for w in WORDS]
    + "depth chars own link_share links tags density stops inputs share_of_page start siblings place "
    "share_of_parent sibling_chars same_tag parent_chars children has_link_only".split()
)


def features(page: Page) -> list[list[float]]:
    """One row per node but the root: subtree density, attribute words, depth and sibling statistics."""
    nodes = page.nodes
    whole = max(nodes[0].chars, 1)
    above: list[tuple[frozenset, frozenset]] = [(frozenset(), frozenset())] * len(nodes)
    place, siblings, mean, kinds = [0] * len(nodes), [1] * len(nodes), [0.0] * len(nodes), [1.0] * len(nodes)
    for i, node in enumerate(nodes):
        group = TAG_OF.get(node.tag)
        if i:
            tags, words = above[i]
        else:
            tags, words = frozenset(), frozenset()
        below = (tags | {group} if group else tags, words | node.groups)
        count = len(node.children)
        total = sum(nodes[c].chars for c in node.children)
        same: dict[str, int] = {}
        for c in node.children:
            same[nodes[c].tag] = same.get(nodes[c].tag, 0) + 1
        for k, c in enumerate(node.children):
            above[c] = below
            place[c], siblings[c] = k, count
            mean[c] = (total - nodes[c].chars) / max(count - 1, 1)
            kinds[c] = same[nodes[c].tag] / count
    rows = []
    for i, node in enumerate(nodes[1:], 1):
        parent = nodes[node.parent]
        tags, words = above[i]
        group = TAG_OF.get(node.tag)
        chars = node.chars
        share = node.linked / chars if chars else 0.0
        rows.append(
            [float(group == t) for t in TAGS]
            + [float(t in tags) for t in TAGS]
            + [float(w in node.groups) for w in WORDS]
            + [float(w in words) for w in WORDS]
            + [
                float(node.depth),
                math.log1p(chars),
                math.log1p(node.own),
                share,
                math.log1p(node.links),
                math.log1p(node.tags),
                math.log1p(chars / (node.tags + 1)),
                node.stops * 20.0 / chars if chars else 0.0,
                math.log1p(node.inputs),
                chars / whole,
                node.first / whole,
                math.log1p(siblings[i]),
                place[i] / siblings[i],
                chars / parent.chars if parent.chars else 0.0,
                math.log1p(mean[i]),
                kinds[i],
                math.log1p(parent.chars),
                math.log1p(len(node.children)),
                float(share > 0.8),
            ]
        )
    return rows


def labels(page: Page) -> list[float]:
    """Whether a node but the root holds content, from ``data-keep`` marks on it, above it or inside it."""
    nodes = page.nodes
    marks: list[str | None] = [None] * len(nodes)
    holds = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        marks[i] = node.keep or marks[node.parent]
    for i in range(len(nodes) - 1, 0, -1):
        holds[i] |= marks[i] == "1"
        holds[nodes[i].parent] |= holds[i]
    return [float(holds[i] if marks[i] is None else marks[i] == "1") for i in range(1, len(nodes))]


def decide(page: Page, probabilities) -> list[bool]:
    """Nodes to keep: the likeliest choice in which nothing is kept below a node that is dropped."""
    nodes = page.nodes
    yes = [0.0] * len(nodes)
    no = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = min(max(float(probabilities[i - 1]), 1e-6), 1 - 1e-6)
        # A node counts by the text it holds itself; its parts speak for the rest.
        weight = 1.0 + math.log1p(nodes[i].own)
        yes[i] += weight * math.log(p)
        no[i] += weight * math.log(1 - p)
        yes[nodes[i].parent] += max(yes[i], no[i])
        no[nodes[i].parent] += no[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and yes[i] >= no[i]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    return "\n".join(text for node, text in page.runs if kept[node])
