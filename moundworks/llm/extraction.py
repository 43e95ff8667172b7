"""Main text of HTML pages by scoring the element tree.

A page becomes a tree of elements. What is never an article (scripts, menus, forms,
adverts, comments, hidden parts) is cut off by tag, role or the words of its class and
id. Each paragraph then passes points to its ancestors, one, one for each comma and
one for each hundred characters: in full to the parent, half to the grandparent, and
less further up. An element's points are discounted by the share of its text that
lies in links. The element with most points is the container; a surrounding article
takes its place, and siblings with a good part of its points, or that read like
paragraphs or headings of it, are kept with it. All text of the kept elements is the
result, block by block.

Each page is one row of one batch; no page meets another.
"""

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from moundworks.llm.batches import map_batches, text_steps

#: Elements without content, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are no part of an article, by tag and by role.
NEVER = frozenset(
    "head script style noscript template nav footer aside form button input select option textarea label datalist "
    "iframe object embed applet canvas svg audio video map dialog menu noframes noembed title".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())
#: Words of a class or id that name such parts.
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox sponsor sponsored promo promotion promoted "
    "nav navbar navigation navmenu menu submenu topbar breadcrumb breadcrumbs pager pagination "
    "sidebar aside rail widget widgets toolbar "
    "footer footnav masthead "
    "comment comments commentlist respond responses reply replies reactions feedback disqus discussion "
    "cookie cookies consent gdpr notice notices notification alert banner popup modal overlay lightbox interstitial toast paywall "
    "newsletter subscribe subscription signup login register "
    "share sharing sharebar social "
    "related recommended recommendations teaser teasers outbrain taboola "
    "hidden offscreen skip skiplink".split())
#: Page headers go too; inside an article only their headings stay.
HEADERS = frozenset({"header"})
#: Words of a header that is the article's own, also where no element names the article.
OWN_HEADER = frozenset({"article", "entry", "post", "story", "content"})
#: Elements that hold the article by their tag; they are never cut off for a word.
ARTICLES = frozenset({"article", "main"})
ROOTS = frozenset({"html", "body"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li listing main nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
#: Blocks whose own text counts as a paragraph.
PARAGRAPHS = BLOCKS - HEADINGS - {"li", "dt", "th", "caption", "legend", "summary"}
#: An open element of the first kind is ended by the start of one of the second.
_ENDED_BY = {
    "p": BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}), "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}),
    "head": frozenset({"body"}) | BLOCKS, **{h: HEADINGS for h in HEADINGS},
}
#: Such an element is looked for no further up than one of these.
_FENCES = {
    "p": frozenset("td th caption button object article section main aside nav div blockquote li dd dt figure fieldset form details table body".split()),
    "li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "option": frozenset({"select", "datalist"}),
    **{t: frozenset({"table"}) for t in ("td", "th", "tr", "thead", "tbody")}, "head": frozenset(), **{h: BLOCKS for h in HEADINGS},
}

#: Points that a container's kind starts with.
_START = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "body": 0.0}
#: Share of the best points from which a sibling is kept, and share of text in links up to which it may be.
SIBLING_SHARE, LINK_SHARE = 0.2, 0.33
#: How far up a paragraph's points go.
REACH = 6

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|<)*+)>|<[!?/][^>]*>", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)


class Element:
    """A node: its tag, attributes, and a list of texts and elements."""

    __slots__ = ("tag", "attributes", "parent", "content", "points", "size", "linked")

    def __init__(self, tag: str, attributes: dict[str, str], parent: "Element | None"):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.content: list[Element | str] = []
        self.points, self.size, self.linked = 0.0, 0, 0


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") and ("start" | "end", tag, attributes) in page order; comments and declarations are left out."""
    at, last = 0, html.rfind(">")
    while at < len(html):
        low = html.find("<", at)
        if low < 0 or low > last and not html.startswith("<!--", low):
            break
        found = _MARKUP.match(html, low) or _LOOSE.match(html, low)
        if found is None:
            yield "text", html[at:low + 1], ""
            at = low + 1
            continue
        if low > at:
            yield "text", html[at:low], ""
        at = found.end()
        groups = found.groups()
        if not groups[1]:
            continue
        tag = groups[1].lower()
        yield ("end" if groups[0] else "start"), tag, groups[2]
        if tag in RAW and not groups[0]:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            yield "text", html[at:close.start() if close else len(html)], ""
            at = close.start() if close else len(html)
    if at < len(html):
        yield "text", html[at:], ""


def attributes_of(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def parse(html: str) -> Element:
    """The element tree of a page, for any input: what is not closed ends with its parent,
    and an end without a start is left out."""
    root = Element("#root", {}, None)
    here = root
    for kind, value, more in markup(html):
        if kind == "text":
            here.content.append(value if here.tag in RAW else unescape(value))
        elif kind == "start":
            here = _make_room(here, value)
            child = Element(value, attributes_of(more), here)
            here.content.append(child)
            if value not in VOID and not (more.rstrip().endswith("/") and value not in BLOCKS and value not in RAW and value not in ("a", "b", "i", "span")):
                here = child
        else:
            up = here
            while up is not None and up.tag != value:
                if value not in BLOCKS and up.tag in BLOCKS:  # an inline end does not close a block
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            elif value == "p":
                here.content.append(Element("p", {}, here))
    return root


def _make_room(here: Element, tag: str) -> Element:
    """Where an element with this tag starts: elements that end before it are left."""
    while True:
        up = here
        closed = None
        while up is not None and up.tag != "#root":
            if tag in _ENDED_BY.get(up.tag, ()):
                closed = up
                break
            if up.tag in BLOCKS and not any(tag in _ENDED_BY[k] and up.tag not in _FENCES[k] for k in _ENDED_BY):
                break
            up = up.parent
        if closed is None:
            return here
        here = closed.parent


def _names(e: Element) -> set[str]:
    """Words of an element's class and id."""
    a = e.attributes
    return {w.lower() for w in _NAME_WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")} if a else set()


def _is_cut(e: Element, principal: set[Element]) -> bool:
    """Whether an element and all in it is left out by its tag, role, names or style."""
    if e.tag in NEVER:
        return True
    a = e.attributes
    if not a or e in principal:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN_STYLE.search(a.get("style", "")):
        return True
    return a.get("role", "").lower() in NEVER_ROLES or bool(_names(e) & NEVER_WORDS)


def _principal(root: Element) -> set[Element]:
    """The page's main element, its longest article, and all elements around them: no word cuts
    them off. Articles in parts that are cut off, and comments, come last."""
    elements = _in_order(root)
    size: dict[Element, int] = {}
    for e in reversed(elements):
        size[e] = sum(len(c) if isinstance(c, str) else size[c] for c in e.content) if e.tag not in NEVER else 0
    apart: set[Element] = set()
    for e in elements:
        named = _names(e)
        if e.parent in apart or e.parent is not None and e.parent.tag != "article" and _names(e.parent) & NEVER_WORDS or named & {"comment", "comments"}:
            apart.add(e)
    found = {e for e in elements if e.tag in ROOTS}
    for named in ([e for e in elements if e.tag == "main" or e.attributes.get("role") == "main"], [e for e in elements if e.tag == "article"]):
        up = max(named, key=lambda e: (e not in apart, size[e]), default=None)
        while up is not None:
            found.add(up)
            up = up.parent
    return found


def prune(root: Element) -> None:
    """Cut off what is never an article, from the top down."""
    principal = _principal(root)
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        inside = inside or e.tag in ARTICLES
        kept: list[Element | str] = []
        for c in e.content:
            if isinstance(c, str):
                kept.append(c)
            elif _is_cut(c, principal):
                kept.append(" " if c.tag not in BLOCKS else Element("hr", {}, e))
            elif (c.tag in HEADERS or c.tag not in HEADINGS and _names(c) & HEADERS) and c not in principal:
                kept += _headings(c, e, principal) if inside or _names(c) & OWN_HEADER else [Element("hr", {}, e)]
            else:
                kept.append(c)
                stack.append((c, inside))
        e.content = kept


def _headings(e: Element, parent: Element, principal: set[Element]) -> list[Element]:
    """The headings in a header, as children of ``parent``."""
    found, stack = [], [e]
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS:
            x.parent = parent
            found.append(x)
        else:
            stack += [c for c in reversed(x.content) if isinstance(c, Element) and not _is_cut(c, principal)]
    return found


def _in_order(root: Element) -> list[Element]:
    """All elements, parents before children."""
    found, stack = [], [root]
    while stack:
        e = stack.pop()
        found.append(e)
        stack += [c for c in e.content if isinstance(c, Element)]
    return found


def _own_text(e: Element) -> str:
    """Text of an element and of the inline elements in it, but not of blocks in it."""
    parts, stack = [], list(reversed(e.content))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in BLOCKS:
            stack += reversed(c.content)
    return " ".join("".join(parts).split())


def score(root: Element) -> list[Element]:
    """Set points, and the lengths of all text and of linked text; returns the elements, parents first."""
    elements = _in_order(root)
    for e in elements:
        if e.tag in PARAGRAPHS and (text := _own_text(e)):
            value, up = 1.0 + text.count(",") + len(text) / 100, e.parent if e.tag in ("p", "pre", "blockquote", "dd") else e
            for level in range(REACH):
                if up is None:
                    break
                up.points += value / (1, 2, 6, 9, 12, 15)[level]
                up = up.parent
    for e in reversed(elements):
        own = sum(len(c.strip()) for c in e.content if isinstance(c, str))
        e.size += own
        if e.tag == "a":
            e.linked = e.size
        if e.parent is not None:
            e.parent.size += e.size
            e.parent.linked += e.linked
    for e in elements:
        if e.points:
            e.points = (e.points + _START.get(e.tag, 0.0)) * (1 - link_share(e))
    return elements


def link_share(e: Element) -> float:
    return e.linked / e.size if e.size else 0.0


def container(elements: list[Element]) -> list[Element]:
    """The best element, or the article around it, with the siblings that belong to it, in page order."""
    inline_free = [e for e in elements if e.points > 0 and e.tag not in ("html", "#root") and (e.tag in BLOCKS or e.parent is None)]
    best = max(inline_free, key=lambda e: e.points, default=None)
    if best is None:
        return [elements[0]] if elements else []
    up = best
    while up is not None:
        if up.tag in ARTICLES:
            best = up
            break
        up = up.parent
    if best.parent is None:
        return [best]
    kept = []
    for c in best.parent.content:
        if isinstance(c, str):
            continue
        good = c.points >= SIBLING_SHARE * best.points and link_share(c) <= LINK_SHARE
        if c is best or best.tag != "body" and c.size and (
            good or c.tag in HEADINGS or c.tag == "p" and link_share(c) <= LINK_SHARE and c.size >= 80
        ):
            kept.append(c)
    return kept


def blocks(kept: list[Element]) -> list[str]:
    """Text of each block in page order, white space as single spaces; empty ones are left out."""
    out, run = [], []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    for e in kept:
        close()
        stack: list[Element | str | None] = [e]
        while stack:
            c = stack.pop()
            if c is None:
                close()
            elif isinstance(c, str):
                run.append(c)
            elif c.tag == "br":
                run.append(" ")
            else:
                block = c.tag in BLOCKS or c is e
                if block:
                    close()
                    stack.append(None)
                stack += reversed(c.content)
    close()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n".join(blocks(container(score(root))))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, text and n_chars (code points) of the main text of every page.

    A null or empty page, and one without text outside of menus, forms and the like,
    has an empty text. Markup may be broken in any way; it is read as far as it goes.
    Pages of any length are parsed whole, one by one. One row per input row: repeated
    rows have equal results, null keys and URLs stay null. Of containers with equal
    points the outermost, then the first of the page wins. An empty table gives no
    rows. Other columns, whatever they are called, are not read.
    """
    types = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, "_html"):
            found = [main_text(h) for h in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["_id", "_url", "text", "n_chars"])

    renamed = pages.select(pages[key].alias("_id"), pages[url].alias("_url"), pages[html].alias("_html"))
    found = map_batches(renamed, step, f"_id {types[0]}, _url {types[1]}, text string, n_chars bigint")
    return found.withColumnsRenamed({"_id": key, "_url": url})
