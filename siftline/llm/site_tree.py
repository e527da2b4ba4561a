"""Main text of pages by a site style tree.

The element trees of a host's pages are merged by path.  A path's importance comes from
two entropies over the pages: how many ways its children are laid out, and how much its
text differs from page to page.  Paths of low importance are template branches; they go,
inside articles too, together with the elements whose tag or class names a part that is
no article.  Of what is left, a marked article outweighs the text around it unless that is
several times as long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import cut_lineage

#: Weight of a path's own layout against that of what it holds, per layout seen.
GAMMA = 0.9
LEAST_IMPORTANCE = 0.3
#: Paths are judged from this many different pages on, and only if they hold a minor part
#: of the host's text.
LEAST_PAGES = 5
MAJOR_SHARE = 0.2
#: Text around a marked article counts once it is more than so many times as long.
ARTICLE_WEIGHT = 2

# fixed values: elements by their role in HTML
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "label",
}
#: Elements without text of their own that may stand inside a line of text.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "audio", "video", "button", "select", "map"}
QUIET = INLINE | SILENT
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote", "td", "th", "li", "nav", "aside", "footer", "header", "form"}
NOISE_TAGS = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "head", "fieldset"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NOISE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
DENIALS = {"no", "not", "with", "without", "has"}
ARTICLE = {"article", "main"}
WHOLE = {"html", "body", "article", "main"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'/>=][^\s/>=]*)\s*(?:=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
IN_ARTICLE = re.compile(r">(?:article|main)(?:[.>]|$)")
NAME_PART = re.compile(r"[a-z]+")


def digest(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _label(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Tag with its classes, digits left out, and whether its names say that it is no article."""
    noise, names = tag in NOISE_TAGS, ""
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "role":
                noise = noise or value in NOISE_ROLES
            elif name == "aria-hidden":
                noise = noise or value == "true"
            elif name == "hidden":
                noise = True
            elif name in ("class", "id"):
                parts = NAME_PART.findall(value)
                if tag not in WHOLE and not any(p in DENIALS for p in parts):
                    noise = noise or any(p in NOISE_NAMES and not (inside and p == "header") for p in parts)
                if name == "class":
                    names = ".".join(parts)
    return (f"{tag}.{names}" if names else tag), noise


class Page:
    """Blocks of a page in order, each with its path; and the layout of every path."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str]] = []
        self.layouts: dict[str, list[str]] = {}
        self._open: list[tuple[str, str, bool, bool]] = []  # tag, path, noise, in article
        self._count: dict[str, int] = {}
        self._run: list[str] = []
        at = 0
        while (match := TOKEN.search(html, at)) is not None:
            if match.start() > at:
                self._text(html[at:match.start()])
            at = match.end()
            closing, tag, attributes = (match[2], match[3], match[4]) if match[3] else (match[5], match[6], match[7])
            if match[1]:
                self._run_text(match[1])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            else:
                self._start(tag, attributes)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                    at = end.start() if end else len(html)
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _text(self, text: str) -> None:
        self._run_text(unescape(text) if "&" in text else text)

    def _run_text(self, text: str) -> None:
        if not (self._open and self._open[-1][2]):
            self._run.append(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split()) if self._run else ""
        self._run = []
        if text:
            self.blocks.append((self._open[-1][1] if self._open else "", text))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE or tag == "br":
            if tag == "br":
                self._run.append(" ")
                return
            if tag in VOID or not _label(tag, attributes, True)[1]:
                return
        elif tag not in SILENT:
            self._flush()
        if tag in VOID:
            return
        if self._count.get("p") and tag not in QUIET:
            self._close_to({"p"}, SCOPES)
        if tag in CLOSED_BY:
            self._close_to(CLOSED_BY[tag], {"ul", "ol", "dl", "table"})
        above = self._open[-1] if self._open else ("", "", False, False)
        label, noise = _label(tag, attributes, above[3])
        inside = above[3] or tag in ARTICLE
        if tag == "header":
            noise = noise or not above[3]
        path = f"{above[1]}>{label}"
        if not above[2]:
            self.layouts.setdefault(above[1], []).append(label)
        self._open.append((tag, path, above[2] or noise or tag in RAW, inside))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag not in QUIET:
            self._flush()
        if self._count.get(tag):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        if self._open[-1][0] not in QUIET:
            self._flush()
        tag = self._open.pop()[0]
        self._count[tag] -= 1
        return tag

    def _close_to(self, tags: set[str], scopes: set[str]) -> None:
        """Close the innermost open element of ``tags`` unless a scope lies between."""
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self._open[depth][0]
            if tag in tags:
                while len(self._open) > depth:
                    self._pop()
                return
            if tag in scopes:
                return


def main_blocks(blocks: list[tuple[str, str]], drop: set[str]) -> list[str]:
    """The texts of a page without the paths in ``drop``; where some of them stand in an
    article or main element, only those, unless the others are over ARTICLE_WEIGHT times
    as long."""
    left = [(IN_ARTICLE.search(path) is not None, text) for path, text in blocks if path not in drop]
    inside = [text for within, text in left if within]
    size, whole = sum(map(len, inside)), sum(len(text) for _, text in left)
    return inside if inside and whole - size <= ARTICLE_WEIGHT * size else [text for _, text in left]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _rows(pages: DataFrame, html: str, url: str, *keep: str) -> DataFrame:
    return pages.select(*keep, host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))


def tree_rows(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, kind, value, page, size): what each page adds to its host's tree.

    kind 0 is the layout of a path's children, kind 1 a text block; ``page`` is a hash of
    the page, so that copies count once.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, html_value in zip(batch.column("host").to_pylist(), batch.column("html")):
                text = html_value.as_py()
                page, mark = Page(text), digest(text)
                for path, labels in page.layouts.items():
                    runs = [x for i, x in enumerate(labels) if not i or labels[i - 1] != x]
                    out.append((host, path, 0, digest(*runs), mark, 0))
                for path, block in page.blocks:
                    out.append((host, path, 1, digest(block), mark, len(block)))
            if out:
                types = (pa.string(), pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["host", "path", "kind", "value", "page", "size"])

    return _rows(pages, html, url).mapInArrow(add, "host string, path string, kind tinyint, value bigint, page bigint, size bigint")


def low_branches(rows: DataFrame, least: float = LEAST_IMPORTANCE, pages: int = LEAST_PAGES, major: float = MAJOR_SHARE) -> DataFrame:
    """(host, paths): the paths of low importance of each host.

    With ``m`` pages that have the path, the layout importance is the entropy of the
    layouts to base ``m``; the content importance is one less the mean of ``log_m`` of the
    number of pages that share a text block.  A path with ``l`` layouts weighs them as
    ``1 - GAMMA ** l`` to ``GAMMA ** l``.

    Paths in articles go only where the host's articles tell pages apart (mean importance
    by size of ``least`` or more) or where the text of importance around them is over
    ARTICLE_WEIGHT times as long; elsewhere the marks are all there is to go by.
    """
    seen = rows.groupBy("host", "path", "kind", "value").agg(F.count_distinct("page").alias("c"), F.sum("size").alias("size"))
    each = rows.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("m"))
    sums = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("c") * F.log("c")).otherwise(0.0)).alias("layout_clogc"),
        F.sum(F.when(F.col("kind") == 0, F.col("c")).otherwise(0)).alias("layout_c"),
        F.count_if(F.col("kind") == 0).alias("l"),
        F.sum(F.when(F.col("kind") == 1, F.log("c")).otherwise(0.0)).alias("text_log"),
        F.count_if(F.col("kind") == 1).alias("blocks"), F.sum("size").alias("size"),
    )
    base = F.log("m")
    layout = F.when((F.col("l") == 0) | (F.col("m") <= 1), 1.0).otherwise((F.log("layout_c") - F.col("layout_clogc") / F.col("layout_c")) / base)
    content = F.when((F.col("blocks") == 0) | (F.col("m") <= 1), 1.0).otherwise(1 - F.col("text_log") / F.col("blocks") / base)
    gamma = F.pow(F.lit(GAMMA), F.col("l"))
    judged = sums.join(each, ["host", "path"]).withColumn("importance", (1 - gamma) * layout + gamma * content)
    judged = cut_lineage(judged.where("blocks > 0").select("host", "path", "m", "size", "importance", F.col("path").rlike(IN_ARTICLE.pattern).alias("within")), "importance")
    whole = judged.groupBy("host").agg(
        F.sum("size").alias("all_size"), F.sum(F.when(F.col("within"), F.col("size")).otherwise(0)).alias("inner_size"),
        F.sum(F.when(F.col("within"), F.col("size") * F.col("importance")).otherwise(0.0)).alias("inner"),
        F.sum(F.when(~F.col("within") & (F.col("importance") >= least), F.col("size")).otherwise(0)).alias("outer_size"),
    )
    telling = (F.col("inner") >= F.col("inner_size") * least) | (F.col("outer_size") > F.col("inner_size") * ARTICLE_WEIGHT)
    low = judged.join(whole, "host").where((F.col("m") >= pages) & (F.col("importance") < least) & (F.col("size") < F.col("all_size") * major) & (~F.col("within") | telling))
    return low.groupBy("host").agg(F.collect_set("path").alias("paths"))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", **limits) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one row each.

    Blocks are joined by a line break, white space within a block is one space.  A null
    html counts as empty, a page without main text has an empty text, a page without host
    belongs to the host ''.  Repeated rows are extracted alike; other columns are not read.
    """
    low = cut_lineage(low_branches(tree_rows(pages, html, url), **limits), "low-branches")
    rows = _rows(pages, html, url, F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    marked = rows.join(low, "host", "left").select("page_id", "url", "html", "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, paths in zip(batch.column("html"), batch.column("paths")):
                drop = set(paths.as_py() or ())
                texts.append("\n".join(main_blocks(Page(value.as_py()).blocks, drop)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return marked.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint")
