"""Main text of web pages, with site template removal.

A page is walked once, tag by tag, in time that grows with its length. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments go by their
tags, roles and whole class names (or ids; not those of headings and sections in the
main region). A header in an article or ``main`` is a part of it. All articles are the main region if they hold most of the text, else all of
``main``, without one the page.
The hash of each remaining block element's subtree is counted over the pages of
its host in Spark, copies of a page as one; a subtree that is on most of a host's
pages is its template and is deleted, unless it is the whole main region.

Defined results: a null or empty page has no text; a null url has no host and no
template; rows with null ids and repeated rows are handled one by one (pages of
a host with the same text count as one); a tag that isn't closed is text, one with
a quote that isn't ends at the next ">"; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from crossbook.llm._common import stored

#: A template is on so many pages of the host, and on this share of them.
MIN_PAGES, MIN_SHARE = 10, 0.5
#: Hosts whose templates are sent to every task, at most, and hashes of templates (8 bytes each) of all of them.
SENT_HOSTS, SENT_TREES = 20_000, 4_000_000

# Neither gives back what it has matched, so a failure costs one look at the rest.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas", "audio", "video"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "label", "big",
}
_CLASSES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "notice", "banner", "alert", "popup", "modal",
    "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar", "widget", "masthead",
}
#: Words that make a class name of these longer without changing what it means.
_PLAIN = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "wrapper", "container", "box", "bar", "block", "list", "area", "inner", "outer", "links", "items", "item", "buttons", "button", "icons", "form", "section", "posts", "articles",
    "stories", "policy", "slot", "unit", "media", "user", "reader", "thread", "body", "text", "content",
}
_HEADERS = {"site-header", "page-header", "global-header", "top-header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
_TITLED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _names_unwanted(value: str, in_region: bool) -> bool:
    for name in value.lower().split():
        parts = {p for p in re.split("[-_]+", name) if p}
        if not parts.isdisjoint(_CLASSES) and parts <= _CLASSES | _PLAIN or (name in _HEADERS and not in_region):
            return True
    return False


def _unwanted(tag: str, attrs: str, in_region: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_region):
        return True
    if not attrs.strip() or tag in ("body", "html", "article", "main"):
        # An article in a list of comments is one as well.
        return tag == "article" and bool(re.search(r"""class\s*=\s*["']?[^"'>]*\bcomment""", attrs))
    spared = in_region and tag in _TITLED
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if (name == "class" or (name == "id" and not spared)) and _names_unwanted(value, in_region):
            return True
        value = value.lower()
        if (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


class _Open:
    """An open element: what it is, whether its text goes, its block children so far."""

    __slots__ = ("tag", "gone", "region", "start", "parts")

    def __init__(self, tag: str, gone: bool, region: int, start: int):
        self.tag, self.gone, self.region, self.start, self.parts = tag, gone, region, start, []


def _digest(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def walk(page: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The blocks of the main region, and the subtrees in it as (hash, first block, end)."""
    blocks: list[tuple[int, str]] = []
    trees: list[tuple[int, int, int, int]] = []
    stack, text, regions, in_main, at = [_Open("", False, 0, 0)], [], 0, set(), 0
    # Places of the block elements in the stack, and how many elements of each name are open.
    holders, opened, last_end = [0], Counter(), page.rfind(">")

    def flush():
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                blocks.append((stack[-1].region, " ".join(words)))
                stack[holders[-1]].parts.append(blocks[-1][1])

    def close(to: int):
        while len(stack) > to:
            top = stack[-1]
            if top.tag not in _INLINE:
                flush()
                holders.pop()
            stack.pop()
            opened[top.tag] -= 1
            if top.tag not in _INLINE and top.parts:
                value = _digest(f"{top.tag}\0" + "\0".join(top.parts))
                trees.append((value, top.region, top.start, len(blocks)))
                stack[holders[-1]].parts.append(str(value))

    while True:
        begin = page.find("<", at)
        if not stack[-1].gone:  # a reference ends at a tag, so each run is decoded by itself
            text.append(entities.unescape(page[at : begin if begin >= 0 else len(page)]))
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), begin) and begin < last_end:
            at = page.find(">", begin) + 1
            continue
        found = (_TAG.match(page, begin) or _NAME.match(page, begin)) if begin < last_end else None
        if not found:
            text.append("<") if not stack[-1].gone else None
            at = begin + 1
            continue
        if found.re is _TAG:
            at, attrs = found.end(), found[3]
        else:
            at = page.find(">", found.end()) + 1
            attrs = page[found.end() : at - 1]
            if not at:
                text.append("<") if not stack[-1].gone else None
                at = begin + 1
                continue
        tag = found[2].lower()
        if found[1]:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag == "br":
            text.append(" ") if not stack[-1].gone else None
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in _INLINE:
            flush()
            if len(holders) > 1 and stack[holders[-1]].tag in _CLOSED_BY.get(tag, {"p"}):
                close(holders[-1])
        top = stack[-1]
        region = top.region
        if not top.gone and tag in ("article", "main") and not (region and region % 2 == 1):
            regions += 1
            region = 2 * regions + (1 if tag == "article" else 0)
            if tag == "main" or top.region in in_main:
                in_main.add(region)
        gone = top.gone or _unwanted(tag, attrs, bool(region))
        if tag not in _INLINE:
            if gone and not top.gone:
                flush()
            holders.append(len(stack))
        stack.append(_Open(tag, gone, region, len(blocks)))
        opened[tag] += 1
    close(1)
    flush()
    # All articles if they hold most of the text; else all of main; without one, the page.
    sizes: Counter = Counter()
    for region, words in blocks:
        sizes[region] += len(words)
    articles, mains = {r for r in sizes if r % 2}, in_main.intersection(sizes)
    kept = mains or set(sizes)
    if 2 * sum(sizes[r] for r in articles) > sum(sizes[r] for r in articles | kept):
        kept = articles
    places = {i: k for k, i in enumerate(i for i, (r, _) in enumerate(blocks) if r in kept)}
    mine = [(v, places[s], places[e - 1] + 1) for v, r, s, e in trees if r in kept and s in places and e - 1 in places and places[e - 1] - places[s] == e - 1 - s]
    return [b for r, b in blocks if r in kept], mine


def _subtrees(batches):
    """(host, tree, page): each subtree of each page's text, and one row without a subtree."""
    held: set = set()

    def out():
        items = list(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in items], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["host", "tree", "page"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host:
                blocks, trees = walk(page)
                own = _digest("\n".join(blocks))
                held.update((host, t, own) for t in [None, *(t for t, _, _ in trees)])
        if len(held) > 200_000:
            yield out()
    yield out()


def _extract(batches):
    for batch in batches:
        texts = []
        for page, known in zip(batch.column("html").to_pylist(), batch.column("trees").to_pylist(), strict=True):
            blocks, trees = walk(page)
            known = set(known or ())
            gone = {i for t, a, b in trees if t in known and b - a < len(blocks) for i in range(a, b)} if known else ()
            texts.append("\n".join(b for i, b in enumerate(blocks) if i not in gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def html_extraction(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"), host.alias("host"),
    )
    counted = rows.select("host", "html").mapInArrow(_subtrees, "host string, tree long, page long").distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    counted = stored(counted, "subtrees")
    hosts = counted.filter("tree is null").select("host", F.col("n").alias("pages"))
    templates = counted.filter("tree is not null").join(hosts, "host").filter(F.col("n") >= min_share * F.col("pages"))
    templates = stored(templates.groupBy("host").agg(F.collect_list("tree").alias("trees"), F.max("pages").alias("pages")), "templates")
    return _with_templates(rows, templates).select("page_id", "url", "html", "trees").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def _with_templates(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """The pages with ``trees``, the templates of their host.

    Those of the hosts with most pages are sent to the pages; only pages of other hosts are dealt by
    host, so no task gets more of a host than has less than 1 / SENT_HOSTS of all pages.
    """
    none = F.lit(None).cast("array<long>")
    first = stored(templates.orderBy(F.desc("pages"), "host").limit(SENT_HOSTS), "large-hosts")
    so_far = F.sum(F.size("trees")).over(W.orderBy(F.desc("pages"), "host"))  # SENT_HOSTS rows at most
    sent = stored(first.withColumn("so_far", so_far).filter(F.col("so_far") <= SENT_TREES).select("host", "trees"), "sent-templates")
    hot = F.broadcast(sent)
    if sent.count() == templates.count():
        return rows.join(hot, "host", "left") if not sent.isEmpty() else rows.withColumn("trees", none)
    names = F.broadcast(sent.select("host"))
    others = templates.select("host", "trees").join(names, "host", "left_anti")
    return rows.join(hot, "host").unionByName(rows.join(names, "host", "left_anti").join(others, "host", "left"))
