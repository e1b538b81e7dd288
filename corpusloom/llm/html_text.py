"""HTML extraction by tag-path ratios.

A page is cut into blocks of text: runs without a block tag between them. Each block has a tag path, from the root to
its leaf, of tag names with their class. Per path the text length (less its links) and the punctuation of its blocks are added up and set
against the number of its tags. The two ratios are smoothed over neighbouring blocks in page order and
fused by their geometric mean; a path's score is the logarithm of its fused ratio over the mean of the page's text, between -3 and 3.
Paths whose score is above the threshold, zero, are content; so are headings, lists and short paragraphs that stand among them.

What the markup says weighs in on the score, it doesn't decide: a path in an article or main gains INSIDE, one outside of those that the page
has loses OUTSIDE, and names in class or id with a word of a list lose WEAK or STRONG. So a paragraph of text in an
article stays under a name like "related" or "notice". Links are text like other where they stand in the article, under no such name, and in headings; elsewhere
they are taken off. A name doesn't count
where the element holds the page's article or main (as much of their text as stands outside such elements, or, within one, nine tenths of it) or,
without any of that outside, most of the plain text.

Some parts are told by their structure, whatever their names: elements side by side with the same path that each have a short line with a date or
time, after a quarter of the page's text (reader comments, with the element that holds little else), and elements that stand around a button or field with at most
NOTICE characters and less than half of the page's text (notices, sign-ups). Those lose BESIDE. Elements that HTML defines as no part of the text (nav, form, script and the like, and the
page's own header and footer) are left out before.

Edge cases: a null or empty page, or one without text, gives an empty text. Unclosed tags are closed by the rules for p, li,
td and the like, or at their parent's end; a tag that never ends is text, and from there on quotes don't hide the end of a tag. Elements
nested deeper than DEPTH count as at that depth. Text in broken markup is kept. Very long pages are read whole, in a time in proportion to their length; rows
keep their multiplicity, equal ones have equal texts, and other columns are not read; one named like the result is replaced. An empty
table gives an empty result. Equal scores are no tie to break: each path is judged by itself.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import column_of

_HEAD = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_REMARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
#: A quote hides the end of a tag only after an equals sign.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([^\s=/"'>]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A date or time in figures.
_DATE = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d{2}\b|\b\d{1,2}\.? [^\W\d]+ \d{4}\b|\b[^\W\d]+ \d{1,2}, \d{4}\b")
_MARK = re.compile(r"[.,;:!?。，；：！？…]")
#: Elements whose content is no markup.
_RAW = frozenset(("script", "style", "noscript", "textarea", "template", "iframe", "svg", "math", "title", "xmp", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that don't begin a block of their own.
_INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
#: Elements that are never part of an article; and those that are not where they stand outside of one.
_NOISE_TAGS = frozenset(("nav", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video", "map", "fieldset"))
_PAGE_TAGS = frozenset(("header", "footer", "aside"))
#: Names of parts that are seldom text, and of parts that may well be.
_NOISE_WORDS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "overlay", "pagination", "popup", "replies", "reply", "respond", "sidebar", "signup",
    "sponsor", "sponsored", "subscribe", "toolbar",
))
_WEAK_WORDS = frozenset(("banner", "header", "notice", "promo", "related", "share", "sharing", "social", "widget"))
_NOISE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"))
#: Open elements that a start tag closes, up to one of the third column's.
_P_ENDERS = frozenset((
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
))
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_P_STOPS = frozenset(("article", "aside", "blockquote", "body", "button", "div", "dd", "li", "main", "section", "table", "td", "th", "nav", "footer", "header", "form", "object"))

#: Elements that may stand among paragraphs of text.
_AMONG = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption"))

#: Neighbours on either side over which a block's ratios are smoothed, and the share of the page's mean at which a path's score is zero.
RADIUS = 1
SHARE = 0.6
#: What the markup weighs, as logarithms.
INSIDE, OUTSIDE, WEAK, STRONG, BESIDE = 2.0, 1.0, 1.5, 3.5, 8.0
#: Characters of a line that may be a comment's head, and of a notice.
LINE, NOTICE = 80, 400
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a user acts on; elements that are the page's text or hold it; tags that a comment may have; parts that no notice has.
_FIELDS = frozenset(("button", "input", "select", "textarea", "form"))
_WHOLE = frozenset(("", "html", "body", "main", "article"))
_ITEMS = frozenset(("li", "div", "section", "article", "dd", "tr", "blockquote"))
_SOLID = frozenset(("pre", "table", "figure", "h1"))
DEPTH = 256


class _Blocks:
    """Reads one page into blocks: (path, text, linked characters, tags)."""

    def __init__(self, page: str) -> None:
        self.stack: list[tuple[str, str, bool, tuple[int, ...], bool, int]] = []  # tag, path without inline elements, noise, elements named like noise, in an article, block element
        self.raw: list[tuple[str, list, int]] = []
        self.parts: list[tuple[str, bool, tuple[int, ...], bool, int]] = []
        # Of each block element: the one around it, tag, path, and whether a field, a date or a solid part stands in it.
        self.above, self.tag_of, self.path_of = [-1], [""], [""]
        self.field, self.dated, self.solid = set(), set(), set()
        self.named = 0
        self.tags = 0
        self.open_tags: dict[str, int] = defaultdict(int)
        self.weight: list[float] = []
        self.within: list[bool] = []
        at, end, tag_of = 0, len(page), _TAG
        while at < end:
            head = _HEAD.search(page, at)
            if head is None:
                break
            self.text(page[at : head.start()])
            at = head.start()
            if m := _REMARK.match(page, at):
                at = m.end()
                continue
            m = tag_of.match(page, at)
            if m is None:
                if tag_of is _PLAIN_TAG:
                    break
                tag_of = _PLAIN_TAG
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.open(tag, m[3] or "")
            if tag in _RAW and not (m[3] or "").rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
                self.close(tag)
        self.text(page[at:])
        self.flush()
        self.found = self.judged()

    def noisy(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def text(self, raw: str) -> None:
        if raw and not self.noisy():
            named, article, element = self.stack[-1][3:] if self.stack else ((), False, 0)
            self.parts.append((html.unescape(raw) if "&" in raw else raw, any(x[0] == "a" for x in self.stack[-3:]), named, article, element))

    def flush(self) -> None:
        if self.parts:
            line = "".join(x[0] for x in self.parts) if sum(len(x[0]) for x in self.parts) <= 2 * LINE else ""
            if len(line.strip()) <= LINE and _DATE.search(line):
                self.dated.add(self.parts[0][4])
            self.raw.append((self.stack[-1][1] if self.stack else "", self.parts, self.tags + 1))
            self.parts = []
        self.tags = 0

    def judged(self) -> list[tuple[str, float, str, int, int]]:
        """(path, what the markup weighs, text, linked characters, tags) of each block with text."""
        plain, article = np.zeros(self.named), np.zeros(self.named)
        total = outside = within = 0
        for _, parts, _ in self.raw:
            for x, link, named, inside, _ in parts:
                n = 0 if link else len(_SPACE.sub(" ", x).strip())
                total += n
                within += n * inside
                outside += n * (inside and not named)
                for k in named:
                    plain[k] += n
                    article[k] += n * inside
        # A part of the article counts unless it holds nearly all of its text; another unless it holds the article, or most of a page without one.
        part = np.array(self.within, dtype=bool)
        counts = np.where(part, 10 * article <= 9 * within, ((2 * plain <= total) | (outside > 0)) & ((article == 0) | (article < outside)))
        found = []
        beside = self.beside()
        for path, parts, tags in self.raw:
            lost = [max((self.weight[k] for k in named if counts[k]), default=0.0) for _, _, named, _, _ in parts]
            weights = [(INSIDE if inside else -OUTSIDE if within else 0.0) - max(w, BESIDE * beside[element]) for (_, _, _, inside, element), w in zip(parts, lost)]
            # The block weighs what most of its text does; an inline element with a strong name goes by itself.
            main = max(zip((len(x[0]) for x in parts), weights))[1]
            heading = path.rpartition("/")[2].partition(".")[0] in _HEADINGS
            # Links of the article itself, and in headings, are its text.
            parts = [(x[0], x[1] and not heading and (bool(lost[k]) or not x[3])) for k, x in enumerate(parts) if weights[k] > main - STRONG]
            text = _SPACE.sub(" ", "".join(x[0] for x in parts)).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", x[0]).strip()) for x in parts if x[1])
                found.append((path, main, text, min(linked, len(text)), tags))
        return found

    def beside(self) -> list[bool]:
        """Whether a block element is one of a list of dated parts or stands around a button or field, or within such a one."""
        n = len(self.above)
        size, before, text_before = [0] * n, [0] * n, 0
        for _, parts, _ in self.raw:
            for x, _, _, _, element in parts:
                before[element] = before[element] or text_before + 1
                m = len(x.strip())
                size[element] += m
                text_before += m
        dated, solid = [k in self.dated for k in range(n)], [k in self.solid for k in range(n)]
        for k in range(n - 1, 0, -1):
            up = self.above[k]
            size[up] += size[k]
            dated[up] |= dated[k]
            solid[up] |= solid[k]
            if before[k] and (not before[up] or before[k] < before[up]):
                before[up] = before[k]
        total, marked = size[0], [False] * n
        alike: dict[tuple[int, str], list[int]] = defaultdict(list)
        for k in range(1, n):
            if size[k] and self.tag_of[k] in _ITEMS:
                alike[self.above[k], self.path_of[k]].append(k)
        for (up, _), own in alike.items():
            if len(own) > 1 and all(dated[k] for k in own) and 2 * sum(size[k] for k in own) <= total and 4 * before[own[0]] > total:
                whole = self.tag_of[up] not in _WHOLE and 2 * sum(size[k] for k in own) >= size[up]
                for k in [up] if whole else own:
                    marked[k] = True
        for k in self.field:
            while k and not size[k]:
                k = self.above[k]
            if self.tag_of[k] not in _WHOLE and size[k] <= NOTICE and 2 * size[k] < total and not solid[k]:
                marked[k] = True
        for k in range(1, n):
            marked[k] |= marked[self.above[k]]
        return marked

    def open(self, tag: str, attributes: str) -> None:
        self.tags += 1
        if tag == "br" or tag not in _INLINE:
            if tag == "br":
                self.flush()
                return
            self.flush()
        if tag in _P_ENDERS:
            self.close_until(("p",), _P_STOPS)
        if tag in _CLOSES:
            self.close_until(*_CLOSES[tag])
        named, article, element = self.stack[-1][3:] if self.stack else ((), False, 0)
        if tag in _FIELDS and 'type="hidden"' not in attributes:
            self.field.add(element)
        if tag in _VOID:
            return
        if len(self.stack) >= DEPTH:
            return
        if tag == "time":
            self.dated.add(element)
        name, noise = tag, self.noisy() or tag in _NOISE_TAGS or tag in _RAW or (tag in _PAGE_TAGS and not article)
        if tag in _PAGE_TAGS and article:
            named = self.name(named, STRONG if tag == "aside" else WEAK)
        if attributes:
            given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            if cls := given.get("class", ""):
                name += "." + ".".join(sorted(cls.split()))
            if not noise and (tag not in ("html", "body", "article", "main") or (article and tag == "article")):
                noise = given.get("role", "").lower() in _NOISE_ROLES or given.get("aria-hidden") == "true" or "hidden" in re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes).lower().split()
                words = [x.lower() for x in _NAME.findall(f"{cls} {given.get('id', '')}")]
                if not noise and not (strong := _NOISE_WORDS.isdisjoint(words)) or not _WEAK_WORDS.isdisjoint(words):
                    named = self.name(named, WEAK if strong else STRONG)
        above = self.stack[-1][1] if self.stack else ""
        path = above if tag in _INLINE else f"{above}/{name}" if above else name
        if tag not in _INLINE and not noise:
            self.above.append(element)
            self.tag_of.append(tag)
            self.path_of.append(path)
            element = len(self.above) - 1
            if tag in _SOLID:
                self.solid.add(element)
        self.stack.append((tag, path, noise, named, article or tag in ("article", "main"), element))
        self.open_tags[tag] += 1

    def name(self, named: tuple[int, ...], weight: float) -> tuple[int, ...]:
        self.weight.append(weight)
        self.within.append(bool(self.stack) and self.stack[-1][4])
        self.named += 1
        return (*named, self.named - 1)

    def drop(self, at: int, end: int | None = None) -> None:
        for x in self.stack[at:end]:
            self.open_tags[x[0]] -= 1
        del self.stack[at:end]

    def close(self, tag: str) -> None:
        self.tags += 1
        if tag not in _INLINE:
            self.flush()
        if not self.open_tags[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in _INLINE and any(x[0] not in _INLINE for x in self.stack[k:]):
                    # An inline end tag doesn't close blocks: only the inline element is taken out.
                    self.drop(k, k + 1)
                else:
                    self.drop(k)
                return
            if self.stack[k][0] in ("article", "body", "td", "nav", "footer", "aside", "header") and tag in ("p", "li", *_INLINE):
                return

    def close_until(self, tags: tuple[str, ...], stops) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                # Inline elements left open go on in the next block.
                kept = [x for x in self.stack[k + 1 :] if x[0] in _INLINE][-3:]
                self.drop(k)
                above = self.stack[-1][1] if self.stack else ""
                for tag, _, *rest in kept:
                    self.open_tags[tag] += 1
                    self.stack.append((tag, above, *rest))
                if len(tags) == 1:
                    return
            elif self.stack[k][0] in stops:
                return


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, RADIUS, mode="edge")
    return np.mean([padded[k : k + len(x)] for k in range(2 * RADIUS + 1)], axis=0)


def main_text(page: str | None) -> str:
    """Main text of one page: blocks in page order, joined by ends of lines."""
    blocks = _Blocks(page or "").found
    if not blocks:
        return ""
    length, marks, linked, tags = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float)
    for path, _, text, link, n in blocks:
        length[path] += len(text)
        marks[path] += len(_MARK.findall(text))
        linked[path] += link
        tags[path] += n
    plain = {p: max(0.0, length[p] - 1.5 * linked[p]) for p in length}
    text_ratio = _smooth(np.array([plain[p] / tags[p] for p, *_ in blocks]))
    mark_ratio = _smooth(np.array([(marks[p] + 1) / tags[p] * (plain[p] > 0) for p, *_ in blocks]))
    fused = np.sqrt(text_ratio * mark_ratio)
    weight = np.array([len(b[2]) for b in blocks], dtype=float)
    by_path: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for (path, *_), f, w in zip(blocks, fused.tolist(), weight.tolist()):
        by_path[path][0] += f * w
        by_path[path][1] += w
    value = {p: (a / b if plain[p] > 0 else 0.0) for p, (a, b) in by_path.items()}
    level = SHARE * float(np.average([value[b[0]] for b in blocks], weights=weight))
    score = {p: max(-3.0, min(3.0, math.log(v / level))) if v > 0 and level > 0 else -9.0 for p, v in value.items()}
    content = {(p, m) for p, m, *_ in blocks if score[p] + m >= 0}
    # Headings, lists and short paragraphs that stand among content of the same weight.
    homes = {(_container(p), m) for p, m in content}
    return "\n".join(text for path, m, text, _, _ in blocks if (path, m) in content or (plain[path] > 0 and (_container(path), m) in homes))


def _container(path: str) -> str:
    """The path without the elements at its end that stand among paragraphs, one at least."""
    head, _, leaf = path.rpartition("/")
    while head and leaf.partition(".")[0] in _AMONG and (above := head.rpartition("/"))[2].partition(".")[0] in _AMONG:
        head, _, leaf = above[0], "/", above[2]
    return head if leaf.partition(".")[0] in _AMONG else path


def extract(pages: DataFrame, page: str = "html", to: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns keep) with the main text of the column page."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != to.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = [main_text(x) for x in column_of(rows, page).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(column_of(rows, c) for c in kept), pa.array(texts, pa.string())], [*kept, to])

    source = pages.select(*kept, page) if page not in kept else pages.select(*kept)
    return source.mapInArrow(run, T.StructType([*(pages.schema[c] for c in kept), T.StructField(to, T.StringType())]))
