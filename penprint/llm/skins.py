"""Training pages: the texts of real pages set in many layouts, with the truth marked in the markup.

The given pages share one layout and mark their article. A model fitted to that layout alone would
know nothing of others, so every sampled page is also rendered anew: its own paragraphs as content,
its own menus, adverts and footers, and sentences of it, as everything else.
"""

from __future__ import annotations

import html
import random

from penprint.llm.dom import Page, parse

ROOTS = [
    "article", "main", "div class='article-body'", "div id='content'", "div class='post-content'", "div class='entry'",
    "section class='story'", "div class='c1'", "div", "td", "div class='text-block'", "section", "div class='x-main wrap'",
]
# Boilerplate: markup in which {} stands for links, {s} for a sentence of the page.
ROWS = {
    "nav": ["<nav{k}><ul>{li}</ul></nav>", "<div class='menu'{k}>{a}</div>", "<ul id='navigation'{k}>{li}</ul>", "<div class='breadcrumbs'{k}>{a}</div>", "<table{k}><tr>{td}</tr></table>", "<div{k}>{a}</div>"],
    "header": ["<header{k}><div class='logo'>{w}</div><p>{w}</p></header>", "<div class='masthead'{k}><h2>{w}</h2>{a}</div>", "<div id='header'{k}>{s}</div>", "<header{k}><h1>{w}</h1><nav><ul>{li}</ul></nav></header>"],
    "footer": ["<footer{k}>&copy; {w} &middot; {s}</footer>", "<div id='footer'{k}><p>&copy; 2020 {w}</p>{a}</div>", "<footer{k}><div>{a}</div><p>{s}</p></footer>", "<div class='legal'{k}>{s}</div>"],
    "side": ["<aside{k}><h3>{w}</h3><ul>{li}</ul></aside>", "<div class='sidebar'{k}><p>{s}</p>{a}</div>", "<aside{k}><p>{s}</p><p>{s}</p></aside>", "<div class='related-posts'{k}><h4>{w}</h4><ul>{li}</ul></div>", "<div class='widget'{k}>{s}</div>"],
    "notice": ["<div class='cookie-notice'{k}>{s} <a href='/p'>{w}</a></div>", "<div role='alert'{k}><p>{s}</p></div>", "<div id='consent'{k}>{s}</div>", "<div class='newsletter'{k}><p>{s}</p></div>", "<div class='notice'{k}>{s}</div>", "<dialog{k}><p>{s}</p></dialog>"],
    "ad": ["<div class='ad'{k}>{s}</div>", "<div class='sponsored'{k}><p>{s}</p></div>", "<div id='banner-ad'{k}><a href='/b'>{s}</a></div>", "<aside class='promo'{k}>{s}</aside>", "<div class='advert'{k}>{s}</div>"],
    "form": ["<form{k}><label>{w}</label><input name='q'><p>{s}</p></form>", "<form class='search'{k}><input><div>{w}</div></form>", "<div class='login'{k}><form><p>{w}</p><input><input></form></div>"],
    "comments": ["<section class='comments'{k}><h3>{w}</h3><div class='comment'><p>{s}</p></div><div class='comment'><p>{s}</p></div></section>", "<div id='comments'{k}><ol><li><p>{s}</p><p>{s}</p></li><li><p>{s}</p></li></ol></div>", "<div class='reader-replies'{k}><p>{s}</p><p>{s}</p></div>", "<ul class='comment-list'{k}><li>{s}</li><li>{s}</li></ul>"],
    "share": ["<div class='share'{k}>{a}</div>", "<ul class='social'{k}>{li}</ul>"],
}
BEFORE, INSIDE, AFTER = ["nav", "header", "notice", "ad", "side", "form", "nav"], ["ad", "notice", "share", "form", "side"], ["footer", "side", "comments", "ad", "share", "notice", "form", "footer", "comments"]


def _fill(rng: random.Random, pattern: str, words: list[str], sentences: list[str]) -> str:
    def some(low: int, high: int) -> str:
        return html.escape(" ".join(rng.choice(words) for _ in range(rng.randint(low, high))))

    out = pattern.replace("{k}", " data-keep='0'")
    links = [f"<a href='/{i}'>{some(1, 3)}</a>" for i in range(rng.randint(2, 9))]
    for mark, value in (("{li}", "".join(f"<li>{x}</li>" for x in links)), ("{td}", "".join(f"<td>{x}</td>" for x in links)), ("{a}", " ".join(links))):
        out = out.replace(mark, value)
    while "{w}" in out:
        out = out.replace("{w}", some(1, 5), 1)
    while "{s}" in out:
        out = out.replace("{s}", html.escape(" ".join(rng.choice(sentences) for _ in range(rng.randint(1, 3)))), 1)
    return out


def content_of(page: Page) -> tuple[list[tuple[str, str]], list[str]]:
    """Blocks inside the article (or, without one, paragraphs), and the texts outside."""
    inside = [False] * len(page.nodes)
    marked = any(n.tag in ("article", "main") for n in page.nodes)
    for i, node in enumerate(page.nodes[1:], 1):
        inside[i] = inside[node.parent] or (node.tag in ("article", "main") if marked else node.tag == "p")
    blocks = [(page.nodes[i].tag, text) for i, text in page.runs if inside[i]]
    return blocks, [text for i, text in page.runs if not inside[i]]


def given(source: str) -> str:
    """The page as it is, with its article marked as content and its usual other parts as none."""
    for tag in ("nav", "footer", "header", "aside", "form"):
        source = source.replace(f"<{tag}", f"<{tag} data-keep='0'")
    source = source.replace("<div class=\"ad\"", "<div class=\"ad\" data-keep='0'")
    return source.replace("<article", "<article data-keep='1'").replace("<main", "<main data-keep='1'")


def render(source: str, seed: int) -> str | None:
    """The page's content in another layout; None if there is none."""
    blocks, outside = content_of(parse(source))
    if not blocks:
        return None
    rng = random.Random(seed)
    words = [w for t in outside for w in t.split()][:200] or blocks[0][1].split()[:20]
    sentences = [t for t in outside if len(t) > 20] or [" ".join(blocks[-1][1].split()[:12])]
    sentences = sentences + [" ".join(t.split()[: rng.randint(5, 40)]) for _, t in blocks[:3]]
    add = lambda kinds, most: [
        _fill(rng, rng.choice(ROWS[k]), words, sentences) for k in rng.sample(kinds, rng.randint(0, most))
    ]
    body = []
    for tag, text in blocks:
        tag = tag if tag.startswith("h") or rng.random() < 0.8 else rng.choice(["p", "div", "blockquote", "li"])
        inner = html.escape(text)
        if rng.random() < 0.2:
            inner = f"<b>{inner}</b>"
        if rng.random() < 0.1:
            inner = inner.replace(" ", " <a href='/x'>", 1).replace(".", "</a>.", 1)
        body.append(f"<{tag}>{inner}</{tag}>" if rng.random() < 0.9 else f"<{tag}>{inner}")
    rng.random() < 0.5 and body.insert(rng.randint(0, len(body)), "".join(add(INSIDE, 1)))
    root = rng.choice(ROOTS)
    name = root.split()[0]
    content = f"<{root} data-keep='1'>" + "".join(body) + f"</{name}>"
    if name == "td":
        side = "".join(add(["side", "nav", "ad"], 1))
        content = f"<table><tr><td data-keep='0'>{side}</td>{content}</tr></table>"
    parts = add(BEFORE, 4) + [content] + add(AFTER, 4)
    if rng.random() < 0.4:
        parts = [f"<div class='{rng.choice(['wrap', 'container', 'page', 'row', 'c9'])}'>", *parts, "</div>"]
    return "<html><body>" + "".join(parts) + "</body></html>"
