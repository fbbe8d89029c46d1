"""Main-text extraction from web pages by boosted trees over DOM nodes.

A page becomes a tree of block elements. Each gets features of its subtree
(text, link and tag density, punctuation), its attribute tokens and tags, its
depth and its siblings. Gradient-boosted trees give the probability that the
subtree holds article text, and a dynamic program over the tree finds the most
probable labelling in which no part of a dropped element is kept.

There are no labelled pages among the tables, so the trees are fitted on
``pages`` pages drawn from the labelled templates below (a parameter; the draw
is seeded, and no row of the data is read).

Defined results: a null or empty page has empty text and length 0; a page
without any article has what the trees keep, maybe nothing; tags cut off at the
end are dropped; unclosed elements end with their parent; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.arrow import map_batches
from readloom.llm.gbt import BoostedTrees

# Element names of the HTML standard by their behaviour here.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script style noscript template svg math iframe object textarea select button title canvas audio video".split()
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# A quoted value may hold ">"; a quote that never closes is a plain character.
_INSIDE = r"""(?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])" + _INSIDE + r"(?<=/)>|<(" + "|".join(HIDDEN) + r")(?=[\s/>])" + _INSIDE + r">.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _INSIDE + r")(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")

# Groups of attribute tokens, each a feature.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager",
    "head": "header masthead topbar banner branding logo",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget rail related recommended trending popular more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer paywall toast",
    "comment": "comment comments reply replies respond discussion disqus responses feedback thread",
    "form": "form login signup subscribe newsletter search contact register",
    "share": "share sharing social follow tags meta byline author",
    "main": "article content main post entry story text maincontent articlebody page prose",
}
_GROUP = {t: g for g, names in TOKENS.items() for t in names.split()}
_GROUPS = list(TOKENS)
_TAGS = ["p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body"]


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "chars", "link", "tags", "marks", "words", "own", "depth", "texts")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.chars = self.link = self.tags = self.marks = self.words = self.own = self.texts = 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.children.append(self)


@lru_cache(1 << 14)
def _tokens(attributes: str) -> frozenset:
    words = (w for m in _ATTRIBUTE.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
    return frozenset(_GROUP[w] for w in words if w in _GROUP)


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, and (node number or -1 for a break, text) in page order."""
    root = Node("body", None, frozenset())
    nodes, number, pieces = [root], {id(root): 0}, []
    stack: list[tuple[str, Node | None]] = [("body", root)]
    blocks = [0]  # places of blocks in the stack
    open_blocks: Counter = Counter()
    scopes: list[Counter] = [Counter()]  # open inline elements since the last block other than p
    here, links = root, 0

    def pop_to(k: int) -> None:
        nonlocal here, links
        while len(stack) > k:
            name, node = stack.pop()
            if node is None:
                scopes[-1][name] -= 1
                links -= name == "a"
            else:
                blocks.pop()
                open_blocks[name] -= 1
                pieces.append((-1, ""))
                if name != "p":
                    scopes.pop()
        here = stack[blocks[-1]][1]

    for m in _TOKEN.finditer(html):
        text = m[5]
        if text is not None:
            pieces.append((number[id(here)], text))
            shown = text.strip()
            if shown:
                n = len(shown)
                here.own += n
                here.texts += 1
                here.words += shown.count(" ") + 1
                here.marks += shown.count(".") + shown.count(",")
                if links:
                    here.link += n
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCKS:
                if open_blocks[name]:
                    pop_to(next(k for k in reversed(blocks) if stack[k][0] == name))
            elif scopes[-1][name]:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if not m[0].endswith(">"):
            break  # cut off
        if name == "br" or name == "hr":
            pieces.append((-1, ""))
        if name in VOID:
            here.tags += 1
            continue
        if name in ("html", "head"):
            continue
        if name == "body":
            root.tokens |= _tokens(m[4])
            continue
        if (name in ENDS_P or name in SELF_CLOSING) and len(blocks) > 1 and stack[blocks[-1]][0] in SELF_CLOSING.get(name, set()) | {"p"}:
            pop_to(blocks[-1])
        if name in BLOCKS:
            node = Node(name, here, _tokens(m[4]))
            number[id(node)] = len(nodes)
            nodes.append(node)
            blocks.append(len(stack))
            stack.append((name, node))
            open_blocks[name] += 1
            if name != "p":
                scopes.append(Counter())
            pieces.append((-1, ""))
            here = node
        else:
            here.tags += 1
            stack.append((name, None))
            scopes[-1][name] += 1
            links += name == "a"
    for node in reversed(nodes):
        node.chars += node.own
        node.tags += 1
        if node.parent is not None:
            for field in ("chars", "link", "tags", "marks", "words"):
                setattr(node.parent, field, getattr(node.parent, field) + getattr(node, field))
    return nodes, pieces


def features(nodes: list[Node]) -> list[list[float]]:
    total = max(1, nodes[0].chars)
    inside: dict[int, list[float]] = {}
    out = []
    log = math.log1p
    kinds = [Counter(c.tag for c in node.children) for node in nodes]
    of = {id(node): k for node, k in zip(nodes, kinds)}
    place_of = {id(c): i for node in nodes for i, c in enumerate(node.children)}
    for node, below in zip(nodes, kinds):
        up = node.parent
        above = inside[id(up)] if up is not None else [0.0] * (len(_GROUPS) + len(_TAGS))
        own = [1.0 if g in node.tokens else 0.0 for g in _GROUPS] + [1.0 if t == node.tag else 0.0 for t in _TAGS]
        # Of an ancestor's mark half is left at each step down.
        inside[id(node)] = [max(a, b / 2) for a, b in zip(own, above)]
        n = len(up.children) if up is not None else 1
        same = of[id(up)][node.tag] if up is not None else 1
        beside = up.chars - node.chars if up is not None else 0
        place = place_of.get(id(node), 0) / n
        out.append(
            own
            + above
            + [
                log(node.chars), log(node.own), node.chars / total, node.link / max(1, node.chars), node.chars / node.tags,
                node.marks / max(1, node.words), node.words / max(1, node.texts + len(node.children)), node.depth, n, place,
                same / n, log(beside), up.link / max(1, up.chars) if up is not None else 0.0,
                below["p"], len(node.children),
            ]
        )
    return out


def decode(nodes: list[Node], keep: np.ndarray) -> list[bool]:
    """The most probable labels under which all below a dropped node is dropped."""
    p = np.clip(keep, 1e-6, 1 - 1e-6)
    cost_keep, cost_drop = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    number = {id(x): i for i, x in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        up = number[id(nodes[i].parent)]
        cost_keep[up] += min(cost_keep[i], cost_drop[i])
        cost_drop[up] += cost_drop[i]
    kept = [False] * len(nodes)
    for i, node in enumerate(nodes):
        kept[i] = cost_keep[i] <= cost_drop[i] and (node.parent is None or kept[number[id(node.parent)]])
    return kept


def text_of(pieces: list[tuple[int, str]], kept: list[bool]) -> str:
    """Blocks of kept nodes in page order, joined by one space."""
    return " ".join(" ".join(unescape(t) if k >= 0 and kept[k] else " " for k, t in pieces_run(pieces)).split())


def pieces_run(pieces):
    """Pieces, with the texts of one node between two breaks joined."""
    run, last = [], None
    for k, t in pieces:
        if k == last and k >= 0:
            run.append(t)
            continue
        if run:
            yield last, "".join(run)
        run, last = ([t], k) if k >= 0 else ([], None)
    if run:
        yield last, "".join(run)


# Templates of labelled pages. {main} marks article text, {other} anything else.


def _word(rnd: random.Random) -> str:
    return "".join(rnd.choice(("an", "ter", "lo", "mi", "sch", "on", "é", "ra", "ti", "un", "des", "o", "th", "er")) for _ in range(rnd.randint(1, 4)))


def _sentence(rnd: random.Random, low: int = 4, high: int = 22) -> str:
    words = [_word(rnd) for _ in range(rnd.randint(low, high))]
    return (" ".join(words)).capitalize() + rnd.choice((".", ".", ".", "?", ","))


def _prose(rnd: random.Random, low: int, high: int) -> str:
    return " ".join(_sentence(rnd) for _ in range(rnd.randint(low, high)))


def _named(rnd: random.Random, tag: str, group: str, sure: float = 0.75) -> str:
    if rnd.random() > sure:
        return f"<{tag}>"
    token = rnd.choice(TOKENS[group].split())
    return f'<{tag} {rnd.choice(("class", "class", "id"))}="{rnd.choice(("", "", "site-", "x "))}{token}{rnd.choice(("", "", "-1", " box"))}">'


def _links(rnd: random.Random, n: int) -> str:
    items = [f'<a href="/{_word(rnd)}">{" ".join(_word(rnd) for _ in range(rnd.randint(1, 4)))}</a>' for _ in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rnd.random() < 0.7 else rnd.choice((" | ", " ")).join(items)


def labelled_page(rnd: random.Random) -> str:
    """A page whose article blocks carry the attribute data-m (removed before parsing)."""
    other: list[str] = []
    if rnd.random() < 0.9:
        tag = rnd.choice(("nav", "nav", "div", "header"))
        other.append((f"<{tag}>" if tag == "nav" else _named(rnd, tag, "menu", 0.9)) + _links(rnd, rnd.randint(2, 12)) + f"</{tag}>")
    if rnd.random() < 0.4:
        tag = rnd.choice(("header", "div"))
        title = rnd.choice(("h1", "h2", "p", "span"))
        other.append(_named(rnd, tag, "head", 0.4 if tag == "header" else 1.0) + f"<{title}>{_sentence(rnd, 1, 5)}</{title}>" + rnd.choice(("", _links(rnd, 3))) + f"</{tag}>")
    between = []
    for group, chance in (("ad", 0.7), ("notice", 0.4), ("side", 0.4), ("share", 0.3), ("form", 0.3)):
        if rnd.random() < chance:
            tag = {"side": rnd.choice(("aside", "div")), "form": rnd.choice(("form", "form", "div"))}.get(group, rnd.choice(("div", "div", "section", "p")))
            text = _prose(rnd, 1, 4)
            inner = rnd.choice((text, text, f"<p>{text}</p>", f"<h3>{_sentence(rnd, 1, 4)}</h3>" + _links(rnd, 4))) if tag != "p" else text
            if group == "form" and rnd.random() < 0.6:
                inner += "<label>" + _word(rnd) + "</label><input name=q>"
            between.append(_named(rnd, tag, group, 1.0 if tag in ("div", "section", "p") else 0.5) + inner + f"</{tag}>")
    cut = rnd.randint(0, len(between))
    mark = " data-m"
    inner = []
    par = rnd.choice(("p", "p", "p", "p", "p", "div"))
    if rnd.random() < 0.85:
        inner.append(f"<h1{mark}>{_sentence(rnd, 1, 12)}</h1>")
    for _ in range(rnd.choice((1, 2, 3, 5, 8, 12, 20))):
        kind = rnd.random()
        if kind < 0.75:
            open_b = "<b>" if rnd.random() < 0.15 else ""
            text = _prose(rnd, 1, rnd.choice((1, 2, 6, 12)))
            if rnd.random() < 0.15:
                text += f' <a href="/x">{_word(rnd)}</a> ' + _sentence(rnd)
            if rnd.random() < 0.12:
                text = _word(rnd).capitalize() + "."
            inner.append(f"<{par}{mark}>{open_b}{text}" + ("</div>" if par == "div" else rnd.choice(("</p>", "</p>", "</p>", "<br>"))))
        elif kind < 0.83:
            inner.append(f"<h2{mark}>{_sentence(rnd, 1, 8)}</h2>")
        elif kind < 0.9:
            inner.append(f"<ul{mark}>" + "".join(f"<li{mark}>{_sentence(rnd, 2, 12)}</li>" for _ in range(rnd.randint(2, 6))) + "</ul>")
        elif kind < 0.95:
            inner.append(f"<blockquote{mark}><p{mark}>{_prose(rnd, 1, 3)}</p></blockquote>")
        else:
            group = rnd.choice(("ad", "share", "side"))
            inner.append(_named(rnd, "div", group, 1.0) + rnd.choice((_prose(rnd, 1, 2), _links(rnd, 3))) + "</div>")
    shape = rnd.random()
    if shape < 0.55:
        body = f"<article{mark}>" + "".join(inner) + "</article>"
    elif shape < 0.7:
        body = f"<main{mark}>" + "".join(inner) + "</main>"
    else:
        body = f'<div{mark} class="{rnd.choice(TOKENS["main"].split())}">' + "".join(inner) + "</div>"
    if rnd.random() < 0.3:
        body = f'<div{mark} {rnd.choice(("class=wrap", "id=page", ""))}>' + body + "</div>"
    after = []
    if rnd.random() < 0.45:
        tag = rnd.choice(("section", "div", "div", "ol"))
        one = rnd.choice(("p", "div", "li"))
        after.append(_named(rnd, tag, "comment", 1.0) + rnd.choice(("", "<h3>" + _sentence(rnd, 1, 3) + "</h3>")) + "".join(f"<{one}>{_prose(rnd, 1, 4)}</{one}>" for _ in range(rnd.randint(1, 6))) + f"</{tag}>")
    if rnd.random() < 0.9:
        tag = rnd.choice(("footer", "footer", "div"))
        after.append((f"<{tag}>" if tag == "footer" else _named(rnd, tag, "foot", 1.0)) + f"&copy; {_word(rnd)}.example &middot; {_prose(rnd, 1, 2)}" + rnd.choice(("", _links(rnd, 4))) + f"</{tag}>")
    return "<html><body>" + "".join(other + between[:cut]) + body + "".join(between[cut:] + after) + "</body></html>"


def labelled_nodes(html: str) -> tuple[list[list[float]], list[bool]]:
    """Features and labels of a page from the templates."""
    plain = html.replace(" data-m", "")
    nodes, _ = parse(plain)
    labels = [False]
    for m in _TOKEN.finditer(html):
        if m[3] and not m[2] and m[3].lower() in BLOCKS - {"html", "body", "hr"}:
            labels.append("data-m" in m[4])
    number = {id(x): i for i, x in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if labels[i]:
            labels[number[id(nodes[i].parent)]] = True
    return features(nodes), labels


@lru_cache(4)
def train(pages: int = 400, seed: int = 7) -> BoostedTrees:
    rnd = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        f, labels = labelled_nodes(labelled_page(rnd))
        x += f
        y += labels
    return BoostedTrees().fit(np.array(x), np.array(y, dtype=float))


def extract_all(model: BoostedTrees, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    parsed = [parse(x or "") for x in pages]
    if not parsed:
        return []
    rows = [r for nodes, _ in parsed for r in features(nodes)]
    keep, out, start = model.probability(np.array(rows)), [], 0
    for nodes, pieces in parsed:
        out.append(text_of(pieces, decode(nodes, keep[start : start + len(nodes)])))
        start += len(nodes)
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages: int = 400) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    sent = df.sparkSession.sparkContext.broadcast(train(pages))
    rows = df.select(df[id_col].cast("bigint").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"))

    def make():
        model = sent.value

        def work(batch):
            texts = extract_all(model, batch.column("html").to_pylist())
            return [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return map_batches(rows, "page_id bigint, url string, text string, n_chars bigint", "html", make)
