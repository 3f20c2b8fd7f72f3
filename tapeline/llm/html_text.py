"""Main text of web pages by composite text density.

A page becomes a tree of elements. Per element: characters and tags below it, and those of them in links.
Its composite density is characters per tag, lowered by the share of links: the logarithm of (characters /
link characters) * (tags / link tags) to a base that grows with the links' weight. The element whose
children's densities add up to most is the core of the article; the smallest density on the path from it up
to body is the threshold, and other elements that reach it give their own densest subtree too. A core within
an `article` or `main` element is widened to it. Elements that are never article text (scripts, menus,
adverts and such) are left out before anything is counted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeline.llm.common import by_size

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Element kinds of HTML, and names that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
NEVER = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select "
                  "input textarea dialog menu audio video title".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td "
                  "tfoot th thead tr ul caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
SHUT_P = BLOCK - {"li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html"} | {"li", "dd", "dt"}
HOLDS_P = frozenset("td th table caption button object html body article section div blockquote".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                  "cookie cookies consent disqus dropdown footer masthead menu menubar modal nav navbar navigation newsletter "
                  "notice notices pager pagination popup promo promoted promotion related respond share sharing sidebar signup "
                  "skip social sponsor sponsored subscribe subscription toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())


def _noise(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden or has the role of clutter, is named like clutter in part, and wholly."""
    part = whole = False
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True, False, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False
        if name in ("class", "id"):
            part = part or any(w in NOISE for w in re.split(r"[\s_\-]+", value))
            whole = whole or any(w in NOISE for w in value.split())
    return False, part, whole


class _Page:
    """Elements in page order with parents before children, and the texts and block edges between them."""

    def __init__(self, html: str, lenient: bool = False) -> None:
        self.tag, self.parent, self.out = ["#"], [-1], [False]
        self.named: list[tuple[int, bool]] = []                   # elements with names of clutter; a whole name is one
        self.events: list[tuple[int, str | None]] = []            # (element, text) or (element, None) at block edges
        stack, at = [0], 0
        while at < len(html):
            m = TOKEN.search(html, at)
            if m is None:
                self._text(stack[-1], html[at:])
                break
            if m.start() > at:
                self._text(stack[-1], html[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            if name == "br":
                self._text(stack[-1], " ")
                continue
            self._implied(stack, name)
            self.tag.append(name)
            self.parent.append(stack[-1])
            attributes = m[3] or m[6] or ""
            own = len(self.tag) - 1
            hidden, part, whole = _noise(attributes) if attributes and name not in ("html", "body", "article", "main") else (False,) * 3
            self.out.append(self.out[stack[-1]] or hidden or name in NEVER and not (lenient and name == "form")
                            or name == "header" and not lenient and not self._inside(stack, ("article", "main")))
            if part:
                self.named.append((own, whole))
            if name in BLOCK:
                self.events.append((own, None))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif name not in VOID and not attributes.endswith("/"):
                stack.append(own)
        self._leave_out()

    def _leave_out(self) -> None:
        """Elements named like clutter go, but for those that hold the article (the `article` or `main` with the most text,
        of those under no element wholly named so) or, on pages without, most of the text; inside an article only by their
        whole name, or if most of their text is in links."""
        if not self.named:
            return
        n = len(self.tag)
        chars, links, linked, inside, under = [0] * n, [0] * n, [False] * n, [False] * n, [False] * n
        wholly = {e for e, whole in self.named if whole}
        for e in range(1, n):
            p = self.parent[e]
            linked[e], under[e] = linked[p] or self.tag[e] == "a", under[p] or e in wholly
            inside[e] = inside[p] or self.tag[e] in ("article", "main")
        for e, text in self.events:
            if text is not None and not self.out[e]:
                size = len(text.strip())
                chars[e] += size
                links[e] += size * linked[e]
        for e in range(n - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
            links[self.parent[e]] += links[e]
        units = [e for e in range(1, n) if self.tag[e] in ("article", "main") and not self.out[e] and not under[e]]
        held, e = set(), max(units, key=lambda e: chars[e] - links[e], default=0)
        while e > 0:
            held.add(e)
            e = self.parent[e]
        for e, whole in self.named:
            most = not units and 2 * chars[e] > chars[0]
            if e not in held and not most and (whole or not inside[e] or 2 * links[e] > chars[e]):
                self.out[e] = True
        for e in range(1, n):
            self.out[e] = self.out[e] or self.out[self.parent[e]]
        self.events = [(e, text) for e, text in self.events if text is None or not self.out[e]]

    def _text(self, element: int, text: str) -> None:
        if not self.out[element]:
            self.events.append((element, unescape(text)))

    def _inside(self, stack: list[int], names: tuple[str, ...]) -> bool:
        return any(self.tag[e] in names for e in stack)

    def _implied(self, stack: list[int], name: str) -> None:
        """End tags that the start tag `name` implies."""
        if name in SHUT_P:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] == "p":
                    self._pop(stack, i)
                    break
                if self.tag[stack[i]] in HOLDS_P:
                    break
        shut = CLOSES.get(name)
        if shut:
            low = None
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in SCOPE[name]:
                    break
                if self.tag[stack[i]] in shut:
                    low = i
            if low is not None:
                self._pop(stack, low)

    def _close(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                self._pop(stack, i)
                return
            if name not in BLOCK and self.tag[stack[i]] in BLOCK:
                break                                               # a stray end tag does not close blocks
        if name == "p":
            self.events.append((stack[-1], None))

    def _pop(self, stack: list[int], to: int) -> None:
        for e in reversed(stack[to:]):
            if self.tag[e] in BLOCK:
                self.events.append((e, None))
        del stack[to:]

    def chosen(self) -> list[bool]:
        """Which elements give text."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for e, text in self.events:
            if text is not None:
                chars[e] += len(text.strip())
        in_link = [False] * n
        for e in range(1, n):
            in_link[e] = self.tag[e] == "a" or in_link[self.parent[e]]
        for e in range(n - 1, 0, -1):
            if self.out[e]:
                continue
            p = self.parent[e]
            if in_link[e]:
                link_chars[e], link_tags[e] = chars[e], tags[e] + (self.tag[e] == "a")
            chars[p] += chars[e]
            tags[p] += tags[e] + 1
            link_chars[p] += link_chars[e]
            link_tags[p] += link_tags[e]
        body = next((e for e in range(1, n) if self.tag[e] == "body"), 0)
        whole, ratio = max(chars[body], 1), link_chars[body] / max(chars[body], 1)
        density, total = [0.0] * n, [0.0] * n
        for e in range(n):
            if chars[e] and not self.out[e]:
                c, lc, t, lt = chars[e], link_chars[e], max(tags[e], 1), link_tags[e]
                base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e) if whole else 1.0
                density[e] = c / t * max(math.log((c / max(lc, 1)) * (t / max(lt, 1)) + 1e-9, max(base, 1.0 + 1e-9)), 0.0)
        for e in range(n - 1, 0, -1):
            total[self.parent[e]] += density[e]
        # the densest subtree at or below each element; leaves count by their own density
        best = list(range(n))
        score = [max(total[e], density[e]) if not self.out[e] else -1.0 for e in range(n)]
        top = score[:]
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            if top[e] > top[p]:
                top[p], best[p] = top[e], best[e]
        core = best[body] if chars[body] else best[0]
        threshold, e = density[core], core
        while e > 0:
            threshold = min(threshold, density[e])
            if e == body:
                break
            e = self.parent[e]
        marked = [False] * n
        for e in range(n):
            if chars[e] and not self.out[e] and density[e] >= threshold:
                marked[best[e]] = True
        marked[core] = True
        wide, e = core, core
        while e > 0:
            if self.tag[e] in ("article", "main"):
                wide = e
                break
            e = self.parent[e]
        if wide != core or self.tag[core] in ("article", "main"):
            marked = [False] * n                                    # the article is the unit, all of it and no more
            marked[wide] = True
        for e in range(1, n):
            marked[e] = (marked[e] or marked[self.parent[e]]) and not self.out[e]
        return marked


def main_text(html: str) -> str:
    """Blocks of the article, white space made single, joined by an empty line; '' if there are none. A page that has
    text in forms and headers alone gives that."""
    return _text_of(_Page(html)) or _text_of(_Page(html, lenient=True))


def _text_of(page: _Page) -> str:
    marked, blocks, now = page.chosen(), [], []
    for e, text in page.events:
        if text is None:
            blocks.append("".join(now))
            now = []
        elif marked[e]:
            now.append(text)
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """`keep`, text, n_chars (code points) for every row; a null html is empty and gives ''."""
    schema = pages.select(*keep).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, len(keep), 4_000_000):
            made = [main_text(h.decode()) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())],
                                             [*keep, "text", "n_chars"])

    return pages.select(*keep, F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b"")).alias("__h")).mapInArrow(run, schema)
