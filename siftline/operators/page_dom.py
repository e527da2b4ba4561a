"""One-pass page parser used inside the extraction tasks (per-row helper).

A page becomes flat lists in document order instead of a node graph: element
``i`` owns elements ``i+1 .. last[i]-1`` and text pieces ``lo[i] .. hi[i]-1``.
Finding an element, its text or its descendants is then a range lookup.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from urllib.parse import urljoin

# ---------------------------------------------------------------- fixed values
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# text below these never counts as text of an enclosing element
SILENT_TAGS = frozenset("script style template rt rp".split())
CONTENT_TAGS = ("article", "main", "div", "section")
CONTENT_CLASSES = ("content", "article", "post", "entry", "story", "text", "body")
DROPPED_TAGS = frozenset(("script", "style", "noscript", "iframe", "svg"))
IGNORED_WORDS = (
    "nav", "navbar", "menu", "header", "footer", "sidebar",
    "comment", "ad", "advertisement", "social", "share", "related",
)
TITLE_SEPARATORS = (" | ", " - ", " – ", " — ", " :: ", " // ")
META_DATE_KEYS = ("publishdate", "pubdate", "date", "published", "article:published_time")
DATE_CLASSES = ("date", "time", "published", "pub-date", "post-date")
DATE_ATTRIBUTES = ("datetime", "date-time", "date")
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_PATTERNS = tuple(
    re.compile(p)
    for p in (
        r"\d{4}-\d{1,2}-\d{1,2}",
        r"\d{1,2}/\d{1,2}/\d{4}",
        MONTHS + r"[a-z]* \d{1,2},? \d{4}",
        MONTHS + r" \d{1,2},? \d{4}",
    )
)
MIN_PARAGRAPH = 40
# ----------------------------------------------------------------------------

_NEWLINES = re.compile(r"\n{2,}")
_BLANKS = re.compile(r"[ \t]{2,}")


def clean(text: str) -> str:
    """X7 for one string."""
    squeezed = _BLANKS.sub(" ", _NEWLINES.sub("\n\n", text))
    return "\n".join(s for s in map(str.strip, squeezed.splitlines()) if s)


def first_date(text: str) -> str | None:
    for pattern in DATE_PATTERNS:
        found = pattern.search(text)
        if found:
            return found.group(0)
    return None


class Page(HTMLParser):
    """Parsed page.  Unclosed elements stay open until an enclosing end tag; an
    end tag without an open partner is ignored."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attr = [], []
        self.last, self.lo, self.hi = [], [], []
        self.text, self.silent = [], []
        self._open, self._quiet = [], 0
        self._waiting = {}  # open elements per tag
        self.feed(html)
        self.close()
        self._close_down_to(0)
        self.alive = [True] * len(self.tag)
        self.kept = [True] * len(self.text)

    # -- building
    def handle_starttag(self, tag, attrs):
        self.tag.append(tag)
        self.attr.append({k: v or "" for k, v in attrs})
        self.last.append(0)
        self.lo.append(len(self.text))
        self.hi.append(0)
        self._open.append(len(self.tag) - 1)
        self._waiting[tag] = self._waiting.get(tag, 0) + 1
        self._quiet += tag in SILENT_TAGS
        if tag in VOID_TAGS:
            self._close_down_to(len(self._open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_down_to(len(self._open) - 1)

    def unknown_decl(self, data):
        # the text of a CDATA section is text
        if data.startswith("CDATA["):
            self.handle_data(data[len("CDATA["):])

    def handle_endtag(self, tag):
        if not self._waiting.get(tag):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            if self.tag[self._open[depth]] == tag:
                self._close_down_to(depth)
                return

    def _close_down_to(self, depth):
        while len(self._open) > depth:
            i = self._open.pop()
            self._waiting[self.tag[i]] -= 1
            self.last[i] = len(self.tag)
            self.hi[i] = len(self.text)
            self._quiet -= self.tag[i] in SILENT_TAGS

    def handle_data(self, data):
        self.text.append(data)
        self.silent.append(self._quiet > 0)

    # -- reading
    def elements(self, *tags):
        """Live elements with one of the tags, in document order."""
        return (i for i, t in enumerate(self.tag) if self.alive[i] and t in tags)

    def text_of(self, i) -> str:
        silent, kept, text = self.silent, self.kept, self.text
        return "".join(
            text[k] for k in range(self.lo[i], self.hi[i]) if kept[k] and not silent[k]
        )

    def has_word(self, i, word) -> bool:
        """Class attribute contains the word (any case, as a substring)."""
        return word in self.attr[i].get("class", "").lower()

    def drop_where(self, test):
        """Remove matching elements with everything below them."""
        for i in range(len(self.tag)):
            if self.alive[i] and test(i):
                for j in range(i, self.last[i]):
                    self.alive[j] = False
                for k in range(self.lo[i], self.hi[i]):
                    self.kept[k] = False


def is_ignored(page: Page, i: int) -> bool:
    """Class or id contains an ignored word."""
    marks = (page.attr[i].get("class", "") + "\n" + page.attr[i].get("id", "")).lower()
    return marks != "\n" and any(word in marks for word in IGNORED_WORDS)


def title_of(page: Page) -> str:
    """X1."""
    headings = list(page.elements("h1"))
    for i in range(len(page.tag)):
        if page.tag[i] in ("article", "main") or page.attr[i].get("role") == "main":
            at = bisect_right(headings, i)
            if at < len(headings) and headings[at] < page.last[i]:
                return page.text_of(headings[at]).strip()
    if headings:
        return page.text_of(headings[0]).strip()
    for i in page.elements("title"):
        full = page.text_of(i).strip()
        cut = next((s for s in TITLE_SEPARATORS if s in full), None)
        return full.partition(cut)[0].strip() if cut else full
    return ""


def publish_date_of(page: Page) -> str | None:
    """X2."""
    stamp = next((page.attr[i].get("datetime") for i in page.elements("time")), None)
    if stamp:
        return stamp
    metas = [page.attr[i] for i in page.elements("meta")]
    for key in META_DATE_KEYS:
        named = [m for m in metas if m.get("name") == key] or [
            m for m in metas if m.get("property") == key
        ]
        if named and named[0].get("content"):
            return named[0]["content"]
    for word in DATE_CLASSES:
        holder = next((i for i in range(len(page.tag)) if page.has_word(i, word)), None)
        found = first_date(page.text_of(holder).strip()) if holder is not None else None
        if found:
            return found
    for name in DATE_ATTRIBUTES:
        for attrs in page.attr:
            if first_date(attrs.get(name, "")):
                return attrs[name]
    return None


def content_of(page: Page, min_length: int) -> str:
    """X3-X5; reduces the page, so title, date and links are read before."""
    page.drop_where(lambda i: page.tag[i] in DROPPED_TAGS or is_ignored(page, i))
    known: dict[int, str] = {}

    def body(i):
        if i not in known:
            known[i] = clean(page.text_of(i))
        return known[i]

    for tag in CONTENT_TAGS:
        marked = [i for i in page.elements(tag) if page.attr[i].get("class")]
        for word in CONTENT_CLASSES:
            for i in marked:
                if page.has_word(i, word) and len(body(i)) >= min_length:
                    return body(i)
    role = next(
        (i for i in range(len(page.tag)) if page.alive[i] and page.attr[i].get("role") == "main"), None
    )
    if role is not None and len(body(role)) >= min_length:
        return body(role)
    paragraphs = list(page.elements("p"))
    most, holder = 2, None
    for tag in CONTENT_TAGS:
        for i in page.elements(tag):
            inside = bisect_left(paragraphs, page.last[i]) - bisect_right(paragraphs, i)
            if inside > most:
                most, holder = inside, i
    if holder is not None and len(body(holder)) >= min_length:
        return body(holder)
    texts = (page.text_of(p).strip() for p in paragraphs)
    return clean("\n\n".join(t for t in texts if len(t) >= MIN_PARAGRAPH))


def links_of(page: Page, base: str) -> list[str]:
    """All anchor targets resolved against the page url, in document order."""
    out = []
    for i in page.elements("a"):
        if "href" in page.attr[i]:
            try:
                out.append(urljoin(base, page.attr[i]["href"]))
            except ValueError:
                continue
    return out
