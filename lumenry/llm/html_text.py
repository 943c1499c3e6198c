"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host.

Each page is parsed into elements; the hash of a subtree covers its tags, classes and words, and its slot is the path of
tags and classes down to it. Spark counts on how many different pages of a host, and of its registered domain, each
subtree is. A subtree on ``many`` pages or more, and on ``share`` of the site's pages, is template. So is all that stands
in a slot of which ``recurring`` of the subtrees are on another page too, since adverts and notices come from a stock of
which a page shows one; this takes ``few`` pages.

Inside an article nothing that holds prose, list items or table cells is template, since articles repeat sentences.
Elements that say by tag or role what they are (menus, forms, scripts and such) go anyway, and so do reader comments by
their names, because their words differ from page to page. Where both host and domain have fewer than ``few`` pages,
too little recurs to tell; there the text is that of the article, without elements whose names say that they're none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import materialize, pieces
from lumenry.llm.texts import packed_texts, unpack

#: Pages that a template subtree is on at least; the share of the site's pages; pages for a judgement of slots; and the
#: share of a slot's subtrees that are on another page.
MANY_PAGES, SHARE, FEW_PAGES, RECURRING = 10, 0.02, 50, 0.4
#: Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption tr td th".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input label map menu nav noscript object option script select style svg template textarea title audio video".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "tbody", "thead", "tfoot", "tr"}
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table select body html article main section div".split())
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination paywall popup promo promoted promotion related replies reply respond share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "marks", "role", "children", "key", "prose", "slot", "can")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.children, self.key, self.prose, self.slot, self.can = tag, [], 0, False, 0, False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        self.marks = f"{found.get('class', '')} {found.get('id', '')}".lower()
        self.role = found.get("role", "").lower()

    def outside(self, in_article: bool) -> bool:
        """Whether the element says by its tag or role, or as reader comments, that it's no article text."""
        if self.tag in NEVER or self.role in ROLES or self.tag == "header" and not in_article:
            return True
        return self.tag not in ("html", "body", "main") and self.marks != " " and not COMMENTS.isdisjoint(_WORD.findall(self.marks))

    def named(self) -> bool:
        """Whether its names say so."""
        return self.tag not in ("html", "body", "article", "main") and self.marks != " " and not MARKS.isdisjoint(_WORD.findall(self.marks))


def parse(page: str) -> Element:
    """The page's elements; what isn't closed ends with its parent, as browsers do."""
    root = Element("html", "")
    stack = [root]
    at, size, low = 0, len(page), None
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("body", "html", "main", "article"):
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1 and tag == "html":
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in HOLDERS:
                    break
        own = Element(tag, m[3])
        stack[-1].children.append(own)
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            end = size if end < 0 else end
            if tag != "script" and tag != "style":
                own.children.append(page[at:end])
            at = page.find(">", end) + 1 or size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(own)
    if at < size:
        stack[-1].children.append(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", page[at:]))  # a tag cut off at the end
    return root


def walk(root: Element) -> Iterator[Element]:
    """Elements from the leaves up, with their keys and slots set, and whether they can be template (``can``)."""
    order: list[tuple[Element, bool, bool, bool]] = []
    todo = [(root, False, False, 0)]
    article = False
    while todo:
        node, inside, gone, above = todo.pop()
        inside = inside or node.tag in ("article", "main")
        article = article or inside
        out = node.outside(inside)
        node.slot = xxhash.xxh3_64_intdigest(f"{node.tag}\x02{node.marks}", above)
        order.append((node, inside, gone, out))
        gone = gone or out
        todo += [(c, inside, gone, node.slot) for c in node.children if isinstance(c, Element)]
    for node, inside, gone, out in reversed(order):
        node.prose = not out and (node.tag in PROSE or any(isinstance(c, Element) and c.prose for c in node.children))
        words = " ".join(f"\x01{c.key}" if isinstance(c, Element) else " ".join(c.split()) for c in node.children)
        node.key = xxhash.xxh3_64_intdigest(f"{node.tag}\x02{node.marks}\x02{words}") - (1 << 63)
        node.can = bool(node.children) and not (gone or out) and node.tag not in ("html", "body", "head", "article", "main", "br", "hr", "img", "wbr") and not (inside and (node.prose or node.tag not in BLOCK))
        if node.prose and (inside or not article):
            node.slot = None  # what differs from page to page there may be the text itself
        yield node


def text_of(root: Element, template: set[int], judged: bool = False) -> str:
    """Blocks that are left, joined by line ends. Unless the site's slots were ``judged``, only those of the article (of
    the body where there is none), without elements named otherwise."""
    tops = [root] if judged else _tops(root, ("article",), template) or _tops(root, ("main",), template) or [root]
    blocks: list[list[str]] = [[]]
    for top in tops:
        blocks.append([])
        todo: list = [(top, not judged)]
        while todo:
            node, inside = todo.pop()
            if node is None:
                blocks.append([])
            elif isinstance(node, str):
                blocks[-1].append(entities.unescape(node) if "&" in node else node)
            elif node is top or not (node.outside(inside) or node.can and node.key in template or (inside or not judged) and node.named()):
                block = node.tag in BLOCK
                inside = inside or node.tag in ("article", "main")
                if node.tag in ("br", "td", "th"):
                    blocks[-1].append(" ")
                if block:
                    blocks.append([])
                    todo.append((None, False))
                todo += [(c, inside) for c in reversed(node.children)]
        blocks.append([])
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def _tops(root: Element, tags: tuple[str, ...], template: set[int]) -> list[Element]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and (node.outside(False) or node.named() or node.can and node.key in template):
            continue
        if node.tag in tags or tags == ("main",) and node.role == "main":
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Element)]
    return found


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/")[0].split("?")[0].split("@")[-1].split(":")[0].lower()


def domain_of(host: str) -> str:
    """The registered domain: the last two labels, three where the last two are as short as ``co.uk``."""
    labels = host.split(".")
    if host.replace(".", "").isdigit() or len(labels) < 3:
        return host
    return ".".join(labels[-3:] if len(labels[-1]) == 2 and len(labels[-2]) <= 3 else labels[-2:])


def subtree_rows(pages: DataFrame) -> DataFrame:
    """(page_id, body, host, domain, k, slot) for each distinct subtree of a page that could be template, and one row with
    null k and slot for the page itself. All but page_id are hashes; body is that of the page's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "body", "host", "domain", "k", "slot")
        for piece in pieces(batches, 64):
            out: list[tuple] = []
            for page, url, text in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                root = parse(text or "")
                found = {(node.key, node.slot) for node in walk(root) if node.can}
                host = host_of(url)
                own = (page, xxhash.xxh3_64_intdigest(text_of(root, set())) - (1 << 63), *(xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in ("h " + host, "d " + domain_of(host))))
                out.append((*own, None, None))
                out += ((*own, k, None if slot is None else slot - (1 << 63)) for k, slot in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=list(names))

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, body bigint, host bigint, domain bigint, k bigint, slot bigint")


def site_templates(rows: DataFrame, many: int, share: float, few: int, recurring: float) -> DataFrame:
    """Per page with any: page_id, ``template`` (its subtrees that are template) and ``judged``.

    Counts are of different pages: those with the same text before template goes are one, so copies of a page don't make
    its text template. All are partial sums by key; nothing is gathered but a page's own keys.
    """
    two = rows.withColumn("site", F.explode(F.array("host", "domain"))).drop("host", "domain")
    sizes = two.filter("k is null").select("site", "body").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    sizes = materialize(sizes, "site-sizes")
    elements = two.filter("k is not null")
    again = elements.select("site", "k", "body").distinct().groupBy("site", "k").agg(F.count("*").alias("on")).filter("on > 1")
    again = materialize(again.join(sizes, "site"), "recurring")
    keys = again.filter(F.col("on") >= F.greatest(F.lit(many), share * F.col("pages"))).select("site", "k")
    in_slots = elements.filter("slot is not null").select("site", "slot", "k", "body").distinct().join(again.select("site", "k", "on"), ["site", "k"], "left")
    slots = in_slots.groupBy("site", "slot").agg(F.count("*").alias("all"), F.count("on").alias("again")).filter((F.col("all") >= few) & (F.col("again") >= recurring * F.col("all"))).select("site", "slot")
    slots = materialize(slots, "slots")
    gone = elements.join(keys, ["site", "k"], "left_semi").select("page_id", "k").union(elements.join(slots, ["site", "slot"], "left_semi").select("page_id", "k"))
    judged = two.filter("k is null").join(sizes.filter(F.col("pages") >= few), "site", "left_semi").select("page_id", F.lit(None).cast("bigint").alias("k"))
    found = gone.withColumn("judged", F.lit(False)).union(judged.withColumn("judged", F.lit(True))).distinct()
    return found.groupBy("page_id").agg(F.collect_set("k").alias("template"), F.max("judged").alias("judged"))


def extract(pages: DataFrame, many: int = MANY_PAGES, share: float = SHARE, few: int = FEW_PAGES, recurring: float = RECURRING) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars; null html is empty, no url is a host.

    Rows of one page_id share what is found to be template on any of them. Other columns of ``pages`` play no part.
    """
    rows = materialize(subtree_rows(pages), "subtrees")
    own = site_templates(rows, many, share, few, recurring)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 64):
            texts = []
            for blob, template, judged in zip(*(piece.column(c).to_pylist() for c in ("blob", "template", "judged")), strict=True):
                root = parse(unpack(blob).decode("utf-8", "replace"))
                for _ in walk(root):
                    pass
                texts.append(text_of(root, set(template or ()), bool(judged)))
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    packed = packed_texts(pages, "page_id", "html", "url")
    return packed.join(own, "page_id", "left").select("page_id", "url", "blob", "template", "judged").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
