"""Main text of web pages by the containers that the pages of a host agree on.

Each page is parsed into containers (block elements with their path of generalised tags and classes: numbers in class names are one
sign). Every container is scored by the text of the blocks directly inside it, half as much for its parent, links counting nothing.
From the best one the page climbs to the article or main part around it, or without one to the parents as long as they add text that is
mostly not linked (to the body only if it has such text directly), and votes for that path. Votes are added up by host and path; the path with the highest sum wins the host.
Then each page is read again and its text taken from the containers on the winning path. A page that has none there, or less than
``LEAST_SHARE`` of the text of its own best container, gives that one.

Left out inside and outside of containers: menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, hidden
parts and reader comments, told by tag, role, or a class or id that says nothing else. An element of these kinds is kept all the same
if it holds most of the page's unlinked text, or is a form around an article, or holds the only article and that is longer than all
that is left (hidden parts, reader comments and cookie notices are not); labels, buttons, notices and the like inside an article are
kept if most of their text is not linked. A page that would have no text is read without regard to classes and ids. Character references are decoded, white space in a block
becomes one space, blocks are joined by an empty line; nothing else is dropped.

Null or empty pages give an empty text; a null or odd URL belongs to the host ''. Repeated rows vote and are read each by itself; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import slices, step

LEAST_SHARE = 0.3

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Up to the closing tag, or the end of the page, there is no markup.
_RAW = frozenset("script style textarea title".split())
#: An opening tag that is closed nowhere further on opens nothing.
_UNSURE = frozenset("noscript template iframe svg math object annotation annotation-xml".split())
_CONTAINER = frozenset("html body main article section div td center blockquote details".split())
_BLOCK = _CONTAINER | frozenset(
    "address aside caption dd dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li menu nav ol "
    "p pre search summary table tbody tfoot th thead tr ul".split()
)
_SPACE = frozenset("br td th img wbr option".split()) - {"wbr"}
#: Tags that an open element of the kind ends at.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_LEFT_OUT = frozenset(
    "nav footer aside form button select dialog menu head search label input noscript template iframe svg object annotation annotation-xml".split()
)
_LEFT_OUT_ALWAYS = frozenset("head select svg annotation annotation-xml".split())
#: Kept inside an article, like the classes below, if most of the text is not linked.
_ARTICLE_TAGS = frozenset("label button dialog".split())
_ARTICLE_WORDS = frozenset("notice related".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notification newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments "
    "commentlist disqus respond social share sharing related recommended popup modal overlay widget toolbar pagination pager login signup "
    "paywall skip".split()
)
#: Left out unless they lie in an article.
_PAGE_WORDS = frozenset("header banner topbar".split())
#: Left out however much they hold: they can be longer than the article.
_NEVER_WORDS = frozenset("comment comments commentlist disqus respond cookie cookies consent gdpr".split())
#: Parts of a name that say only what kind of box it is; with others, as in no-sidebar or ad-free, a name says something else.
_BOX_WORDS = frozenset(
    "area bar bottom box block body btn button buttons column container content desktop footer form group header icon icons inline inner item "
    "items left link links list main mobile outer page panel post posts primary reply right row secondary section site slot text thread title "
    "top unit wrap wrapper".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "parent", "path", "out", "article", "score", "link", "size", "own", "direct", "cause", "words", "text", "plain", "holds")

    def __init__(self, tag: str, parent: _Node | None, path: str, out: bool, article: bool, link: bool):
        self.tag, self.parent, self.path, self.out, self.article, self.link = tag, parent, path, out, article, link
        self.score, self.size, self.own, self.direct = 0.0, 0, 0, 0
        #: Why it is left out by itself, the words of its classes that say so, its characters, those not linked, an article inside.
        self.cause, self.words, self.text, self.plain, self.holds = "", frozenset(), 0, 0, False


def _left_out_words(value: str, article: bool) -> set[str]:
    """The words for which names in a class or id are left out."""
    listed, found = _WORDS if article else _WORDS | _PAGE_WORDS, set()
    for name in value.split():
        parts = {x for x in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if x and not x.isdigit()}
        if not parts.isdisjoint(listed) and parts <= _WORDS | _PAGE_WORDS | _BOX_WORDS:
            found |= parts & listed
    return found


def _open(tag: str, attributes: str, parent: _Node, by_words: bool, kept: bool) -> _Node:
    classes, cause, words = "", "", set()
    article = parent.article or tag in ("article", "main")
    if tag in _LEFT_OUT:
        cause = "always" if tag in _LEFT_OUT_ALWAYS else "tag"
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name == "class":
                classes = ".".join(sorted(_NUMBER.sub("#", c) for c in value.lower().split()))
            if name in ("class", "id"):
                if by_words and tag not in ("html", "body", "main", "article"):
                    words |= _left_out_words(value, article)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                cause = "always"
            elif name == "style" and "display:none" in value.lower().replace(" ", ""):
                cause = "always"
            elif name == "role" and value.lower() in _ROLES:
                cause = cause or "tag"
    if tag == "header" and not article:
        cause = cause or "tag"
    if tag == "dialog" and not re.search(r"(?<![\w-])open(?![\w-])", attributes or "", re.I):
        cause = "closed" if cause != "always" else cause
    cause = cause or ("words" if words else "")
    path = parent.path
    if tag in _CONTAINER:
        path = f"{path}>{tag}.{classes}" if classes else f"{path}>{tag}"
    node = _Node(tag, parent, path, parent.out or bool(cause) and not kept, article, parent.link or tag == "a")
    node.cause, node.words = cause, frozenset(words)
    return node


def _kept(every: list[_Node]) -> frozenset[int]:
    """The numbers of elements that are left out by themselves, but hold too much for that."""
    if not any(n.cause for n in every):
        return frozenset()
    root, kept = every[0], set()
    visible = sum(n.plain for n in every if not n.out)
    article = any(n.article and n.plain and not n.out for n in every)
    fixed = [n.cause == "always" or not n.words.isdisjoint(_NEVER_WORDS) for n in every]
    for node, always in zip(reversed(every), reversed(fixed), strict=True):
        if node.parent is not None and not always:
            node.parent.text += node.text
            node.parent.plain += node.plain
            node.parent.holds |= node.holds or node.tag in ("article", "main")
    for at, node in enumerate(every):
        if not node.cause or fixed[at]:
            continue
        edge = node.tag in ("nav", "footer", "aside")
        light = node.tag in _ARTICLE_TAGS and node.cause != "closed" or node.cause == "words" and node.words <= _ARTICLE_WORDS
        if (
            2 * node.plain > root.plain and not (edge and article)
            or node.holds and (node.tag == "form" or not article and node.plain > visible)
            or light and node.parent.article and 2 * node.plain > node.text
        ):
            kept.add(at)
    return frozenset(kept)


def parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """Containers, and the blocks of text that are not left out with the element each lies in and their unlinked length."""
    for by_words in (True, False):
        nodes, blocks, kept = _read(page, by_words, frozenset())
        if kept:
            nodes, blocks, _ = _read(page, by_words, kept)
        if blocks:
            break
    return nodes, blocks


def _read(page: str, by_words: bool, kept: frozenset[int]) -> tuple[list[_Node], list[tuple[_Node, str, int]], frozenset[int]]:
    """The same with the elements in ``kept`` (by their number) not left out, and those that should not be."""
    root = _Node("", None, "", False, False, False)
    stack, nodes, blocks, every = [root], [], [], [root]
    pieces: list[str] = []
    at, size, linked = 0, len(page), 0
    closed: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                owner = stack[-1]
                while owner.tag not in _BLOCK and owner.parent is not None:
                    owner = owner.parent
                own = max(0, len(text) - linked)
                blocks.append((owner, text, own))
                near = owner
                while near.parent is not None and near.tag not in _CONTAINER:
                    near = near.parent
                near.score += own
                near.direct += own
                far = near.parent
                while far is not None and far.parent is not None and far.tag not in _CONTAINER:
                    far = far.parent
                if far is not None:
                    far.score += own / 2
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if not raw:
            return
        length = len(raw.strip())
        top.text += length
        top.plain += 0 if top.link else length
        if not top.out:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if top.link:
                linked += len(text)

    def close(tag: str, scope: frozenset | set = frozenset()) -> None:
        """Up to and with the innermost open element of the kind, if one is open in scope."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                if any(x.tag in _BLOCK for x in stack[i:]):
                    flush()
                elif tag in _SPACE:
                    pieces.append(" ")
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            close(tag)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _BLOCK:
            flush()
            close("p", _CONTAINER - {"center", "blockquote", "details"})
        for kind in _ENDS.get(tag, ()):
            close(kind, _SCOPE[tag])
        if tag in _SPACE:
            pieces.append(" ")
        if tag in _VOID:
            continue
        if tag in _UNSURE:
            if found[3].endswith("/"):
                continue
            if tag not in closed:
                last = None
                for last in re.finditer(rf"</{tag}\s*>", page, re.I):
                    pass
                closed[tag] = last.start() if last else -1
            if closed[tag] < at:
                continue
        node = _open(tag, found[3], stack[-1], by_words, len(every) in kept)
        every.append(node)
        if not found[3].endswith("/") or tag in _BLOCK:
            stack.append(node)
        if tag in _CONTAINER and not node.out:
            nodes.append(node)
    flush()
    for owner, text, own in blocks:
        while owner is not None:
            owner.size += len(text)
            owner.own += own
            owner = owner.parent
    return nodes, blocks, kept or _kept(every)


def best(nodes: list[_Node]) -> _Node | None:
    """The container with most text of its own; of equals the first."""
    return max(nodes, key=lambda n: n.score, default=None) if any(n.score for n in nodes) else None


def whole(top: _Node) -> _Node:
    """The container that holds all of the article that ``top`` is the longest part of."""
    around, node = [], top
    while node is not None:
        around.append(node)
        node = node.parent
    articles = [n for n in around if n.tag == "article"]
    mains = [n for n in around if n.tag == "main"]
    if articles:
        # A heading or lead may lie in the main part, above the article.
        return mains[-1] if mains and mains[-1].direct else articles[-1]
    if mains:
        return mains[-1]
    for parent in around[1:]:
        if parent.tag not in _CONTAINER or parent.tag == "html":
            continue
        if parent.tag == "body" and not parent.direct:
            break
        more = parent.size - top.size
        if more and 2 * (parent.own - top.own) <= more:
            break
        if more:
            top = parent
    return top


def vote(page: str) -> tuple[str, float] | None:
    """Path and weight of the best container: the share of the scores it has."""
    nodes, _ = parse(page)
    top = best(nodes)
    return None if top is None else (whole(top).path, top.score / sum(n.score for n in nodes))


def extract(page: str, path: str | None) -> str:
    nodes, blocks = parse(page)
    top = best(nodes)
    chosen = {id(n) for n in nodes if n.path == path}
    if top is not None:
        top = whole(top)
        there = sum(n.size for n in nodes if id(n) in chosen and not _inside(n.parent, chosen))
        if there < LEAST_SHARE * top.size:
            chosen = {id(top)}
        return "\n\n".join(text for owner, text, _ in blocks if _inside(owner, chosen))
    return "\n\n".join(text for _, text, _ in blocks)


def _inside(node: _Node | None, chosen: set[int]) -> bool:
    while node is not None:
        if id(node) in chosen:
            return True
        node = node.parent
    return False


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        rows = [(h, *found) for h, p in zip(part["host"].to_pylist(), part["html"].to_pylist(), strict=True) if (found := vote(p or ""))]
        yield pa.RecordBatch.from_pydict(
            {"host": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()), "weight": pa.array([r[2] for r in rows], pa.float64())}
        )


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [extract(h or "", p) for h, p in zip(part["html"].to_pylist(), part["path"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part["path"]],
            ["page_id", "url", "text", "n_chars", "host_path"],
        )


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: the path that wins each host."""
    read = pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    votes = read.mapInArrow(_vote_rows, "host string, path string, weight double").groupBy("host", "path").agg(F.sum(F.round("weight", 6)).alias("weight"))
    return step(votes.groupBy("host").agg(F.max_by("path", F.struct(F.round("weight", 3), "path")).alias("path")), "host-paths")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, host_path`` for every page."""
    paths = host_paths(pages, url_col, html_col)
    read = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), _host(F.col(f"`{url_col}`")).alias("host")
    )
    kind = pages.schema[id_col].dataType.simpleString()
    return read.join(paths, "host", "left").drop("host").mapInArrow(_text_rows, f"page_id {kind}, url string, text string, n_chars long, host_path string")
