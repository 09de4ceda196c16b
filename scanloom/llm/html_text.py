"""Main text of web pages by tree scoring.

A page becomes a tree; menus, headers, footers, sidebars, notices, adverts, forms, comments and what isn't text are taken
out of it by tag, role and class. Each paragraph that is left passes points, for its length and its commas, to its parent
in full and to the ancestors above in part. A container's points are discounted by its link density. The best container
is kept. From it the way goes up to the body, and at each level siblings are kept: those that score well, and inside the
article that the best container is in, or beside the best container itself, all that isn't mostly links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import bounded_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split())
#: Elements that end an open paragraph, and those that such an end doesn't cross.
CLOSES_P = BLOCK - {"body", "html", "option", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
SCOPE = frozenset("button caption html table td th object template marquee".split())
#: An open element of the first kind is ended by the start of one of the second, unless one of the third is between.
SELF_CLOSING = {
    **{t: ({t}, {"ul", "ol", "menu", "dir"}) for t in ("li",)},
    **{t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")},
    **{t: ({"td", "th"}, {"table", "tr"}) for t in ("td", "th")},
    "tr": ({"tr", "td", "th"}, {"table"}),
    **{t: ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED = frozenset("nav footer aside form button select textarea input script style noscript template iframe object embed svg canvas dialog menu head title audio video map search datalist label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status log".split())
#: Words of a class or an id that mark what isn't the article.
MARKS = frozenset(
    "nav navbar navigation menu menubar submenu header masthead topbar footer foot sidebar aside rail breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner cookie cookies consent gdpr notice notices notification popup modal overlay subscribe subscription newsletter signup login register social share sharing sharebar related recommended recommendations "
    "comment comments commentlist disqus discussion replies reply respond feedback pagination pager paging pagenav widget widgets toolbar tagcloud skip copyright legal disclaimer alert toast paywall outbrain taboola form search searchbox".split()
)
ARTICLE = frozenset(["article", "main"])
PARAGRAPHS = frozenset("p pre blockquote li dd td section div article main figcaption body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: of those, only a class that is a mark as a whole takes one out.
PROSE = frozenset("p pre blockquote li dl dt dd td th tr table figure figcaption span b strong i em u a q cite code sub sup small mark abbr math time".split())
#: Elements whose parts belong together, whatever they score.
WHOLE = frozenset("table ul ol dl".split())
#: Characters of a paragraph that counts; text, that makes a form a wrapper of the page if it is also half of the page's.
LEAST, WRAPPER = 25, 250


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "points", "text", "links", "own", "commas")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points, self.text, self.links, self.own, self.commas = 0.0, 0, 0, 0, 0


def parse(page: str) -> Node:
    """The tree of a page. Any text gives one: unknown ends are ignored, missing ones are put where they must be."""
    root = Node("#root", "", None)
    stack, open_, at = [root], Counter(), 0

    def pop_to(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    def close(tags: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        if not any(open_[t] > 0 for t in tags):
            return
        last = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                last = k
                if len(tags) == 1:
                    break
            elif stack[k].tag in fence:
                break
        if last is not None:
            pop_to(last)

    find = _TAG.search
    while True:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].children.append(Node("br", "", stack[-1]))
            elif open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in ("table", "td", "th") and tag not in BLOCK and tag not in ("table", "td", "th"):
                        break
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in SELF_CLOSING:
            close(*SELF_CLOSING[tag])
        node = Node(tag, attributes, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle", "rect", "use")):
            stack.append(node)
            open_[tag] += 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _is_dropped(node: Node, within: bool) -> bool:
    """within: inside an article, where a header belongs to it."""
    if node.tag in DROPPED or (node.tag == "header" and not within):
        return True
    if not node.attributes or node.tag in ("html", "body", "main", *HEADINGS):
        return False
    a = _attributes(node.attributes)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return True
    if a.get("role", "").lower() in ROLES or "comment" in a.get("itemprop", "").lower():
        return True
    for name in (a.get("class", "") + " " + a.get("id", "")).split():
        words = [w.lower() for w in _PART.findall(name)]
        if words and words[0] in ("has", "no", "with", "without"):
            continue
        marked = MARKS.intersection([name.lower()] if node.tag in PROSE else words)
        if marked and not (within and marked <= {"header"}) and (node.tag != "article" or marked & {"comment", "comments", "ad", "ads", "promo", "related", "sponsored", "reply"}):
            return True
    return False


def _wrappers(root: Node) -> set[int]:
    """Forms that are wrapped around most of a page's text, as some frameworks make them."""
    nodes = _order(root)
    if not any(n.tag in ("form", "fieldset") for n in nodes):
        return set()
    sizes: dict[int, int] = {}
    for n in reversed(nodes):
        own = sum(len(c.strip()) if isinstance(c, str) else sizes[id(c)] for c in n.children)
        sizes[id(n)] = 0 if n.tag in DROPPED and n.tag not in ("form", "fieldset") else own
    least = max(WRAPPER, sizes[id(root)] / 2)
    return {id(n) for n in nodes if n.tag in ("form", "fieldset") and sizes[id(n)] >= least}


def prune(root: Node) -> None:
    wrappers = _wrappers(root)
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or node.tag in ARTICLE
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
            elif id(c) in wrappers or not _is_dropped(c, within):
                kept.append(c)
                todo.append((c, within))
        node.children = kept


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def score(root: Node) -> Node | None:
    """The container with the most points; None if no paragraph has any."""
    nodes = _order(root)
    linked: set[int] = set()
    for n in nodes:
        if n.tag == "a" or (n.parent is not None and id(n.parent) in linked):
            linked.add(id(n))
        texts = [" ".join(c.split()) for c in n.children if isinstance(c, str)]
        n.own, n.commas = sum(map(len, texts)), sum(len(re.findall("[,،、，]", t)) for t in texts)
        n.text, n.links = n.own, n.own if id(n) in linked else 0
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.links += n.links
            if n.tag not in BLOCK:  # a block's inline content is its own
                n.parent.own += n.own
                n.parent.commas += n.commas
    found: list[Node] = []
    for n in nodes:
        if n.tag in PARAGRAPHS and n.own >= LEAST:
            points = 1.0 + n.commas + min(n.own // 100, 3)
            up, level = n.parent if n.tag not in ("section", "div", "article", "main", "body") else n, 0
            while up is not None and up.parent is not None and level < 5:
                if up.tag in BLOCK or up.tag in ("td", "th"):
                    if not up.points:
                        found.append(up)
                    up.points += points / (1, 2, 6, 9, 12)[level]
                    level += 1
                up = up.parent
    if not found:
        return None
    return max(found, key=lambda n: n.points * (1 - n.links / max(1, n.text)))


def kept_nodes(root: Node) -> list[Node | str]:
    """What is kept, in page order. A page without a paragraph that counts is kept whole, or its largest article or main."""
    best = score(root)
    if best is None:
        for tag in ("article", "main", "body"):
            named = [n for n in _order(root) if n.tag == tag]
            if named:
                return [max(named, key=lambda n: n.text)]
        return [root]
    worth = lambda n: n.points * (1 - n.links / max(1, n.text))
    least = max(10.0, worth(best) * 0.2)

    def fits(c: Node | str, article: bool, beside: bool) -> bool:
        if isinstance(c, str) or c.tag not in BLOCK:
            return article or beside
        if worth(c) >= least:
            return True
        density = c.links / max(1, c.text)
        if article:
            return density < 0.5 or c.tag in ("p", "pre", "blockquote")
        return beside and density < (0.5 if c.tag in HEADINGS else 0.25)

    above, up = set(), best
    while up is not None:
        above.add(id(up))
        up = up.parent
    article = next((n for n in _order(root) if id(n) in above and n.tag in ARTICLE), None)
    kept: list[Node | str] = [best]
    node, inside, beside = best, article is not None and best is not article, True
    while node.parent is not None and node.tag != "body":
        parent = node.parent
        at = next(k for k, c in enumerate(parent.children) if c is node)
        fit = [fits(c, inside, beside or parent.tag in WHOLE or node.tag in ("tr", "tbody", "thead", "tfoot")) for c in parent.children]
        kept = [c for c, f in zip(parent.children[:at], fit, strict=False) if f] + kept + [c for c, f in zip(parent.children[at + 1 :], fit[at + 1 :], strict=True) if f]
        node, beside = parent, False
        inside = inside and node is not article
    return kept


def blocks(nodes: list[Node | str]) -> list[str]:
    """Text of each block, in page order: references decoded, white space as one space, empty ones left out."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now and (text := " ".join(html.unescape("".join(now)).split())):
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            now.append(n)
        elif n.tag in ("br", "td", "th", "wbr", "img"):
            now.append("" if n.tag == "wbr" else " ")
            todo += reversed(n.children)
        elif n.tag in BLOCK:
            end()
            todo.append(None)
            todo += reversed(n.children)
        else:
            todo += reversed(n.children)
    end()
    return out


def main_text(page: str | None) -> str:
    root = parse(page or "")
    prune(root)
    return "\n".join(blocks(kept_nodes(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text outside of what is left out, give an empty text. Pages are read whole,
    whatever their length or damage. Repeated rows give repeated results, an empty table an empty one; other columns are
    ignored.
    """
    bounded_batches(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
