"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element is described by its tag, the tokens of its attributes, its
depth, its place among its siblings, and the text, link and markup density of
its subtree, with the same facts of its parent. Three boosted forests score the
node as *container* (above the article), *main* (in it) or *noise*. A dynamic
programme over the tree then picks the most likely consistent labelling: nothing
below noise is main, and no container lies below main. Text of main nodes is
kept, block by block in page order.

There are no labelled pages, so the forests are trained here on pages that
``training_pages`` composes (``LAYOUTS``, class names and page furniture of many
kinds, with known article nodes); the training set's size is a parameter.

Map-only: pages never leave their partition, nothing is shuffled.

Defined results: null and empty pages, and pages without a main node, give the
empty string and 0 characters. Very long and broken pages are read whole, in time in proportion to their length. Repeated
rows give repeated results; an empty table gives an empty result. Of equally likely labels the one nearer to the article
counts. Columns beyond id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Node, read_page
from .gradient_trees import Forest, fit_forest
from ..workers import importable
from .runtime import table

CONTAINER, MAIN, NOISE = range(3)
# Groups of tags that are one feature each.
TAG_GROUPS = (
    ("article", "main"), ("p", "pre", "blockquote"), ("h1", "h2"), ("h3", "h4", "h5", "h6"), ("div", "section"),
    ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",),
    ("form", "fieldset", "button", "input"), ("table", "tbody", "tr", "td", "th"), ("figure", "figcaption"), ("html",),
)
# Attribute tokens that speak for and against an article.
GOOD_NAMES = "article body content entry main post story text copy prose page blog".split()
BAD_NAMES = (
    "ad ads advert advertisement advertising alert author banner bar bottom breadcrumb breadcrumbs byline comment "
    "comments consent contact cookie cookies copyright disclaimer discussion disqus dropdown feedback foot footer form gdpr head header "
    "hero login masthead menu meta modal more nav navbar navigation newsletter notice notification pagination popular "
    "popup print promo promoted promotion recommended related replies reply respond rss search share sharing shoutbox sidebar signup site "
    "skip social sponsor sponsored subscribe tags teaser toolbar top topbar trending widget widgets"
).split()
_GOOD, _BAD = frozenset(GOOD_NAMES), frozenset(BAD_NAMES)
_SPLIT = re.compile(r"[^a-z]+")
_END = re.compile(r"[.!?…。]")
_GROUP = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group}
WIDTH = 2 * (len(TAG_GROUPS) + 3) + 15


def node_features(nodes: list[Node], runs: list[tuple[int, str]]) -> np.ndarray:
    """A row for each node."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.zeros(n)
    stops = np.zeros(n)
    for k, piece in runs:
        size = len(piece) if not piece.isspace() else 0
        own[k] += size
        if size:
            stops[k] += len(_END.findall(piece))
    links = np.array([x.links for x in nodes], float)
    tags, text, stop, link = np.ones(n), own.copy(), stops.copy(), links
    paragraphs = np.array([x.tag == "p" for x in nodes], float)
    for i in range(n - 1, 0, -1):
        up = parent[i]
        tags[up] += tags[i]
        text[up] += text[i]
        stop[up] += stop[i]
        link[up] += link[i]
        paragraphs[up] += paragraphs[i]
    groups = np.zeros((n, len(TAG_GROUPS) + 3))
    under_bad, under_good = np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        k = _GROUP.get(x.tag)
        if k is not None:
            groups[i, k] = 1
        if x.names:
            words = _SPLIT.split(x.names)
            groups[i, -3] = sum(w in _GOOD for w in words)
            groups[i, -2] = sum(w in _BAD for w in words)
        groups[i, -1] = x.hidden
        if i:
            up = parent[i]
            bad_tag = nodes[up].tag in ("nav", "footer", "aside", "form", "header")
            under_bad[i] = under_bad[up] + (groups[up, -2] > 0 or bad_tag)
            under_good[i] = under_good[up] + (groups[up, -3] > 0 or nodes[up].tag in ("article", "main"))
    above = groups[np.maximum(parent, 0)] * (parent >= 0)[:, None]
    siblings = np.array([nodes[max(x.parent, 0)].children for x in nodes], float)
    place = np.array([x.place for x in nodes], float)
    total = max(text[0], 1.0)
    safe = np.maximum(text, 1.0)
    rest = np.stack(
        [
            np.array([x.depth for x in nodes], float),
            siblings,
            place / np.maximum(siblings, 1),
            np.log1p(text),
            np.log1p(own),
            text / total,
            link / safe,
            tags / safe,
            stop / safe,
            np.log1p(stop),
            np.log1p(paragraphs),
            np.log1p(text[np.maximum(parent, 0)]),
            text / np.maximum(text[np.maximum(parent, 0)], 1.0),
            under_bad,
            under_good,
        ],
        axis=1,
    )
    return np.concatenate([groups, above, rest], axis=1)


def decode(parent: np.ndarray, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The most likely labels with no main below noise and no container below main."""
    n = len(parent)
    best = logp * weight[:, None]
    total = best.copy()
    choice = np.zeros((n, 3), np.int64)  # the label of i, by the label above it
    for i in range(n - 1, 0, -1):
        c, m, x = total[i]
        from_container = int(np.argmax((c, m, x)))
        from_main = MAIN if m >= x else NOISE
        choice[i] = (from_container, from_main, NOISE)
        total[parent[i]] += (total[i][from_container], total[i][from_main], x)
    out = np.zeros(n, np.int64)
    out[0] = int(np.argmax(total[0]))
    for i in range(1, n):
        out[i] = choice[i, out[parent[i]]]
    return out


# --- training pages ---------------------------------------------------------------------------------------------


def _words(r: random.Random, n: int) -> str:
    syllables = ["ta", "ren", "mo", "il", "ver", "ko", "s", "an", "de", "pri", "lu", "est", "or", "ch", "im"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(1, 22)).capitalize() + r.choice("...?!") for _ in range(n))


def _furniture(r: random.Random, kind: str) -> str:
    """HTML of one piece of page furniture; every element of it is noise."""
    links = lambda n: [f'<a href="/{i}">{_words(r, r.randint(1, 3))}</a>' for i in range(n)]
    listing = lambda n: "<ul>" + "".join(f"<li>{x}</li>" for x in links(n)) + "</ul>"
    say = lambda a, z: _sentences(r, r.randint(a, z))
    box = lambda names, inner: f'<{(t := r.choice(["div", "div", "section"]))} class="{r.choice(names)}">{inner}</{t}>'
    if kind == "menu":
        inner = r.choice([listing(r.randint(2, 9)), " | ".join(links(r.randint(2, 8)))])
        return r.choice([f"<nav>{inner}</nav>", box(["nav", "menu", "navbar", "main-menu", "breadcrumbs"], inner)])
    if kind == "header":
        inner = f"<h1>{_words(r, 2)}</h1><p>{say(1, 1)}</p>" if r.random() < 0.5 else f"{_words(r, 3)} {listing(3)}"
        return r.choice([f"<header>{inner}</header>", box(["header", "site-header", "masthead", "topbar"], inner)])
    if kind == "footer":
        inner = r.choice([f"&copy; {_words(r, 2)} &middot; {say(1, 3)}", f"<p>{say(1, 2)}</p>{listing(4)}"])
        return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", box(["footer", "site-footer", "bottom"], inner)])
    if kind == "sidebar":
        inner = f"<h3>{_words(r, 2)}</h3>" + r.choice([listing(r.randint(3, 9)), f"<p>{say(1, 5)}</p>", f"<p>{say(2, 4)}</p>" * 2])
        return r.choice([f"<aside>{inner}</aside>", box(["sidebar", "widget", "related", "side-bar popular"], inner)])
    if kind == "notice":
        return box(["cookie-notice", "notice", "cookie-banner", "alert", "gdpr consent"], r.choice([say(1, 3), f"<p>{say(1, 3)}</p><button>OK</button>"]))
    if kind == "ad":
        inner = r.choice([say(1, 3), f"<p>{say(1, 3)}</p>", f'<a href="/x">{say(1, 2)}</a>', f"<h4>{_words(r, 3)}</h4><p>{say(1, 2)}</p>"])
        return box(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], inner)
    if kind == "form":
        inner = f'<label>{_words(r, 1)}</label><input name="q"><p>{say(1, 2)}</p><button>{_words(r, 1)}</button>'
        return r.choice([f"<form>{inner}</form>", box(["newsletter", "signup", "search-form", "login"], f"<form>{inner}</form>")])
    if kind == "share":
        return box(["share", "social", "share-buttons", "tags"], r.choice([listing(4), " ".join(links(4))]))
    one = lambda: r.choice([f'<div class="comment"><b>{_words(r, 2)}</b><p>{say(1, 5)}</p></div>', f"<li><p>{say(1, 4)}</p></li>"])
    many = "".join(one() for _ in range(r.randint(1, 6)))
    return r.choice([f'<section id="comments"><h3>{_words(r, 2)}</h3>{many}</section>', f'<div class="comments">{many}</div>', f'<ol class="comment-list">{many}</ol>'])


def _heading(r: random.Random) -> str:
    """An article's own title, often inside a header element of its own."""
    k = r.choice([1, 1, 1, 2])
    title = f"<h{k}>{_words(r, r.randint(1, 12))}</h{k}>"
    lead = r.choice(["", "", f"<p>{_sentences(r, r.randint(1, 2))}</p>"])
    kind = r.random()
    if kind < 0.65:
        return title
    if kind < 0.85:
        return f"<header>{title}{lead}</header>"
    return f'<div class="{r.choice(["article-head", "post-header", "entry-header", "article-header", "headline", "title", "head"])}">{title}{lead}</div>'


def _article(r: random.Random) -> list[str]:
    blocks = []
    if r.random() < 0.8:
        blocks.append(_heading(r))
    for _ in range(min(60, int(r.expovariate(0.12)) + 1)):
        kind = r.random()
        if kind < 0.70:
            body = _sentences(r, r.choice([1, 1, 2, 3, 5, 9]))
            blocks.append(f"<p>{body}</p>" if r.random() < 0.85 else f"<p><b>{body}<br>")
        elif kind < 0.78:
            blocks.append(f"<h{r.choice([2, 3])}>{_words(r, r.randint(1, 7))}</h{r.choice([2, 3])}>")
        elif kind < 0.85:
            blocks.append("<ul>" + "".join(f"<li>{_sentences(r, 1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.89:
            blocks.append(f"<blockquote><p>{_sentences(r, 2)}</p></blockquote>")
        elif kind < 0.92:
            blocks.append(f"<figure><img src=x><figcaption>{_sentences(r, 1)}</figcaption></figure>")
        elif kind < 0.97:
            blocks.append(f"<div>{_sentences(r, r.randint(1, 4))}</div>")
        else:
            blocks.append("<table>" + f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 3)}</td></tr>" * 3 + "</table>")
    return blocks


#: Ways to place an article on a composed page, with their shares.
LAYOUTS = {"article": 0.30, "main": 0.12, "named": 0.16, "unnamed": 0.14, "bare": 0.12, "table": 0.10, "nested": 0.06, "loose": 0.08}
_GOOD_SHELLS = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-body text"]


def _anonymous(r: random.Random) -> str:
    """Attributes that say nothing."""
    return r.choice(["", "", " class=x1", f' class="c{r.randint(1, 99)}"', ' class="col-8 row"', ' id="u7"', ' class="lg:flex overflow-hidden"', ' style="width:70%"'])


def _placed(r: random.Random, layout: str, blocks: list[str]) -> str:
    """The article's part of a page; what is inside x-main is the article."""
    inner = "".join(blocks)
    mark = lambda x: f"<x-main>{x}</x-main>"
    if layout == "article":
        return mark(f"<article{_anonymous(r)}>{inner}</article>")
    if layout == "main":
        return mark(f"<main>{inner}</main>")
    if layout == "named":
        return mark(f'<div class="{r.choice(_GOOD_SHELLS)}">{inner}</div>')
    if layout == "unnamed":
        return mark(f"<{(t := r.choice(['div', 'div', 'section']))}{_anonymous(r)}>{inner}</{t}>")
    if layout == "bare":
        return mark(inner)
    if layout == "loose":  # no blocks at all
        return mark("<br><br>".join(_sentences(r, r.randint(1, 5)) for _ in range(r.randint(2, 12))))
    if layout == "nested":
        return mark(f"<div{_anonymous(r)}><div{_anonymous(r)}>{inner}</div></div>")
    cells = [f"<x-main><td{_anonymous(r)}>{inner}</td></x-main>"]
    if r.random() < 0.6:
        cells.insert(r.randint(0, 1), f"<x-noise><td width=160>{_furniture(r, r.choice(['menu', 'sidebar', 'ad']))}</td></x-noise>")
    top = f"<tr><x-noise><td colspan=2>{_furniture(r, r.choice(['menu', 'header']))}</td></x-noise></tr>" if r.random() < 0.4 else ""
    return f"<table{_anonymous(r)}>{top}<tr>{''.join(cells)}</tr></table>"


def training_pages(n: int, seed: int = 5, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> Iterator[str]:
    """Composed pages with marks: x-main around the article, x-noise around furniture."""
    r = random.Random(seed)
    kinds = ["menu", "header", "footer", "sidebar", "notice", "ad", "form", "share", "comments"]
    noise = lambda k: f"<x-noise>{_furniture(r, k)}</x-noise>"
    for _ in range(n):
        layout = r.choices(layouts, [LAYOUTS[k] for k in layouts])[0]
        blocks = _article(r)
        for k in r.choices(["ad", "share", "form", "notice", "comments", "sidebar", "menu"], k=r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), noise(k))
        article = _placed(r, layout, blocks)
        before = [noise(k) for k in r.sample(kinds, r.choice([0, 1, 2, 2, 3]))]
        after = [noise(k) for k in r.sample(kinds, r.choice([0, 1, 2, 2, 3]))]
        page = "".join(before) + article + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            page = f'<div {r.choice(["", "class=wrap", "id=page", "class=container", "class=site"])}>{page}</div>'
        yield f"<html><head><title>{_words(r, 4)}</title></head><body>{page}</body></html>"


def labelled_nodes(page: str) -> tuple[list[Node], list, np.ndarray]:
    """Nodes of a marked page without the marks, and the label of each."""
    nodes, runs = read_page(page)
    label, new, kept = [], {}, []
    for i, x in enumerate(nodes):
        up = CONTAINER if i == 0 else label[x.parent]
        label.append(MAIN if x.tag == "x-main" else NOISE if x.tag == "x-noise" else up)
    places: dict[int, int] = {}

    def real(i: int) -> int:
        while nodes[i].tag in ("x-main", "x-noise"):
            i = nodes[i].parent
        return i

    for i, x in enumerate(nodes):
        if x.tag in ("x-main", "x-noise"):
            continue
        if i == 0:
            new[0], node = 0, Node("html", "", -1, 0, 0)
        else:
            up = new[real(x.parent)]
            node = Node(x.tag, x.names, up, kept[up].depth + 1, places.get(up, 0), x.hidden)
            places[up] = places.get(up, 0) + 1
            kept[up].children += 1
            new[i] = len(kept)
        node.links = x.links
        kept.append(node)
    labels = np.array([label[i] for i in new])
    for k, piece in runs:
        if nodes[k].tag == "x-main" and not piece.isspace():
            labels[new[real(k)]] = MAIN  # the article's text is directly in it
    return kept, [(new[real(k)], piece) for k, piece in runs], labels


@lru_cache(8)
def train_forests(pages: int = 500, seed: int = 5, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> tuple[Forest, ...]:
    """One forest for each label, trained on composed pages."""
    x, y = [], []
    for page in training_pages(pages, seed, layouts):
        nodes, runs, labels = labelled_nodes(page)
        x.append(node_features(nodes, runs))
        y.append(labels)
    x, y = np.concatenate(x), np.concatenate(y)
    return tuple(fit_forest(x, (y == label).astype(float)) for label in (CONTAINER, MAIN, NOISE))


def log_probabilities(forests: tuple[Forest, ...], x: np.ndarray) -> np.ndarray:
    margin = np.stack([f.margin(x) for f in forests], axis=1)
    margin -= margin.max(axis=1, keepdims=True)
    return margin - np.log(np.exp(margin).sum(axis=1, keepdims=True))


def blocks_of(nodes: list[Node], runs: list[tuple[int, str]], labels: np.ndarray) -> str:
    """Text of main nodes: one line for each block in page order."""
    lines: list[str] = []
    open_node, held = -1, []

    def close() -> None:
        if held:
            line = " ".join(entities.unescape("".join(held)).split())
            if line:
                lines.append(line)
            held.clear()

    for k, piece in runs:
        if k != open_node:
            close()
            open_node = k
        if labels[k] == MAIN and not nodes[k].hidden:
            held.append(piece)
    close()
    return "\n".join(lines)


def extract_batch(pages: list[str], forests: tuple[Forest, ...]) -> list[str]:
    """Main text of each page; all nodes of the batch are scored at once."""
    read = [read_page(p) if p else ([], []) for p in pages]
    rows = [node_features(*p) for p in read if p[0]]
    logp = log_probabilities(forests, np.concatenate(rows)) if rows else None
    out, at = [], 0
    for nodes, runs in read:
        if not nodes:
            out.append("")
            continue
        own = logp[at : at + len(nodes)]
        at += len(nodes)
        parent = np.array([x.parent for x in nodes])
        out.append(blocks_of(nodes, runs, decode(parent, own, np.ones(len(nodes)))))
    return out


def extract_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    training: int = 500,
    batch: int = 128,
) -> DataFrame:
    """id_col, url_col, text and n_chars of every page."""
    importable(pages.sparkSession)
    forests = train_forests(training)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                texts = extract_batch(part.column(2).to_pylist(), forests)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    schema = f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars bigint"
    return pages.select(id_col, url_col, html_col).mapInArrow(work, schema)


def op9_dom_trees(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
