"""A fast, forgiving HTML reader: block elements as nodes, text runs in page order.

Inline elements don't make nodes (their text belongs to the block around them,
link text is counted). Implied end tags are honoured; unknown end tags are
ignored. Scripts, styles, templates, drawings, media and the document head
have no text; formulas and the fallback of objects have. Hidden is what the
``hidden`` attribute, ``aria-hidden`` or its own style says, not a class or a label; of inline elements too, whose text is
left out up to their end tag or the next block, whichever comes first. Options are form controls: their text is left out even
where their list isn't closed.

The reader only moves forward, so broken markup takes time in proportion to its length: a
quote that is never closed ends nothing, a tag that is never closed is text, and an unclosed script or style takes
the rest of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element groups of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr object "
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select",
       "canvas", "audio", "video")
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
STOP = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_NAME = re.compile(r"[a-z][^\s/><]*", re.IGNORECASE)
_STOPS = re.compile("[>\"']")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile("hidden|none", re.IGNORECASE)


def is_hidden(attrs: str) -> bool:
    """Whether an element of these attributes is not shown."""
    if not _MAY_HIDE.search(attrs):
        return False
    seen = set()
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).strip().lower()
        if name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        if (name == "hidden" and value != "until-found") or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            rules = (x.partition(":") for x in value.split(";"))
            style = {k.strip(): v.replace("!important", "").strip() for k, _, v in rules}
            if style.get("display") == "none" or style.get("visibility") == "hidden":
                return True
    return False


@dataclass
class Node:
    tag: str
    names: str
    parent: int
    depth: int
    place: int
    hidden: bool = False
    children: int = 0
    links: int = 0
    runs: list = field(default_factory=list)


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None, is end tag, attributes) of everything that isn't text, in order."""
    last = html.rfind(">")
    gone: set[str] = set()  # quotes and end tags that don't come any more
    at = html.find("<")
    while 0 <= at:
        begin, at = at, at + 1
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = len(html) if end < 0 else end + 3
            yield begin, at, None, False, ""
        elif begin < last and html[begin + 1] in "!?":
            at = html.index(">", begin) + 1
            yield begin, at, None, False, ""
        elif begin < last and (m := _NAME.match(html, begin + 1 + (html[begin + 1] == "/"))):
            end = _tag_end(html, m.end(), last, gone)
            tag, closing, attrs = m[0].lower(), html[begin + 1] == "/", html[m.end() : end]
            at = end + 1
            if tag in _RAW_END and not closing and not (tag == "svg" and attrs.endswith("/")):
                stop = None if tag in gone else _RAW_END[tag].search(html, at)
                if stop is None:
                    gone.add(tag)
                    at = len(html) if tag in ("script", "style") else at
                else:
                    close = html.find(">", stop.end())
                    at = len(html) if close < 0 else close + 1
                yield begin, at, None, False, ""
            else:
                yield begin, at, tag, closing, attrs
        at = html.find("<", at)


def _tag_end(html: str, at: int, last: int, gone: set[str]) -> int:
    """Place of the '>' that ends a tag whose name ends at ``at``; quotes count after '=' only."""
    first = at
    while at <= last and (m := _STOPS.search(html, at)):
        if m[0] == ">":
            return m.start()
        at = m.end()
        before = m.start() - 1
        while before > first and html[before].isspace():
            before -= 1
        if html[before] == "=" and m[0] not in gone:
            close = html.find(m[0], at)
            if close < 0:
                gone.add(m[0])
            elif close < last:
                at = close + 1
    return html.index(">", first)


def read_page(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in page order, runs of (node, raw text)); node 0 is the page."""
    nodes = [Node("html", "", -1, 0, 0)]
    runs: list[tuple[int, str]] = []
    stack = [0]
    link = 0
    at = 0

    veil, under = "", 0  # an inline element that isn't shown, and how many of its name are open in it
    choosing = False  # inside an option

    def text(piece: str) -> None:
        if veil or choosing:
            return
        k = stack[-1]
        runs.append((k, piece))
        if link:
            nodes[k].links += len(piece)

    open_tags: Counter[str] = Counter()

    def pop_to(tags: tuple, stop: tuple = ()) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in tags:
                open_tags.subtract(nodes[k].tag for k in stack[i:])
                del stack[i:]
                return
            if tag in stop:
                return

    for start, end, tag, closing, attrs in tokens(html):
        if start > at:
            text(html[at:start])
        at = end
        if tag is None:
            continue
        choosing = tag in ("option", "optgroup") and not closing
        if tag == "a":
            link = 0 if closing else 1
        if tag in INLINE:
            if veil == tag:
                under += -1 if closing else 1
                veil = veil if under else ""
            elif not veil and not closing and tag not in VOID and is_hidden(attrs):
                veil, under = tag, 1
            if tag == "br":
                text(" ")
            continue
        veil = ""
        if tag in ("html", "body"):
            continue
        if tag == "head":
            pop_to(("head",)) if closing else None
            continue
        if closing:
            pop_to((tag,), () if tag != "p" else tuple(CLOSES_P - {"p"}))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            pop_to(("p",), ("td", "th", "li", "div", "section", "article", "blockquote"))
        if tag in SAME:
            pop_to(SAME[tag], STOP.get(tag, ()))
        parent = stack[-1]
        names = " ".join("".join(g) for g in _NAMES.findall(attrs)).lower() if "=" in attrs else ""
        above = nodes[parent]
        nodes.append(
            Node(tag, names, parent, above.depth + 1, above.children, above.hidden or is_hidden(attrs))
        )
        above.children += 1
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
    if at < len(html):
        text(html[at:])
    return nodes, runs
