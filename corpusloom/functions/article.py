"""The article body of a page without <article>: blocks score their ancestors, the best element wins and takes fitting siblings along.

A block is an element's text without that of block elements in it. One of LEAST characters or more scores 1, one more for each mark between clauses and for each
100 characters (three at most), less the share of its links. Its parent gets the score, the next above a half, and so on with 1 / (2 * level) over LEVELS levels. Of all
elements the one of the highest score, less the share of its links, is the body; of equal ones the first. Of its siblings those join that score a
fifth of it and 2 or more, paragraphs of few links that are long or whole sentences, and headings before it. Lists and containers within that are mostly links are left out.

Elements with a name of a list, and what they hold, take no part unless the page has nothing else. Without any block of LEAST characters all blocks count; without text the body is empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LEAST, LEVELS = 25, 5
#: Elements that don't begin a block.
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset(("div", "section", "ul", "ol", "dl", "table", "form", "fieldset"))
#: Open elements that a start tag ends; a paragraph is ended by all blocks.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class and id of parts that are seldom an article's.
UNLIKELY = frozenset(("ad", "ads", "advert", "banner", "comment", "comments", "cookie", "footer", "menu", "nav", "promo", "related", "share", "sidebar", "social", "sponsor", "widget"))
_WORD = re.compile(r"[a-z]+")
_CLAUSE = re.compile(r"[,;:，、；：]")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)]*$")


@dataclass
class Tree:
    """Block elements in the order of their start tags; 0 is the page. Texts are (order, element, text, in a link)."""

    above: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, str, bool]] = field(default_factory=list)

    beside: set[int] = field(default_factory=set)

    def open(self, tag: str, at: int, names: str = "") -> int:
        """The new element, in the element at or, where its tag ends that unsaid, in the one around it."""
        ends = _ENDS.get(tag, ())
        while at and (self.tags[at] == "p" or self.tags[at] in ends):
            at = self.above[at]
        self.above.append(at)
        self.tags.append(tag)
        if at in self.beside or (names and not UNLIKELY.isdisjoint(_WORD.findall(names.lower()))):
            self.beside.add(len(self.tags) - 1)
        return len(self.tags) - 1

    def body(self) -> list[str]:
        """The texts of the article, in page order."""
        n = len(self.tags)
        own: list[list[str]] = [[] for _ in range(n)]
        size, linked = [0] * n, [0] * n
        for element, text, link in self.texts:
            own[element].append(text)
            size[element] += len(text)
            linked[element] += len(text) * link
        if not any(size):
            return []
        blocks = [(k, " ".join(own[k])) for k in range(n) if own[k]]
        share = [linked[k] / size[k] if size[k] else 0.0 for k in range(n)]
        likely = [b for b in blocks if b[0] not in self.beside]
        found = [b for b in likely if len(b[1]) >= LEAST and self.tags[b[0]] not in _HEADINGS] or likely or blocks
        score = [0.0] * n
        for k, text in found:
            s = (1 + len(_CLAUSE.findall(text)) + min(len(text) // 100, 3)) * (1 - share[k])
            up, level = self.above[k] if k else 0, 0
            while up >= 0 and level < LEVELS:
                score[up] += s / max(1, 2 * level)
                up, level = self.above[up], level + 1
        block_share, block_size = share, size[:]
        # From here on sizes and shares are of whole subtrees: an element stands after the one around it.
        for k in range(n - 1, 0, -1):
            size[self.above[k]] += size[k]
            linked[self.above[k]] += linked[k]
        share = [linked[k] / size[k] if size[k] else 0.0 for k in range(n)]
        value = [score[k] * (1 - share[k]) for k in range(n)]
        top = max(range(n), key=lambda k: (value[k], -k))
        chosen = {top}
        before = True
        texts = dict(blocks)
        for k in range(1, n):
            if self.above[k] != self.above[top] or not top or (k in self.beside and k != top):
                continue
            if k == top:
                before = False
                continue
            text = texts.get(k, "")
            whole = self.tags[k] == "p" and text and ((len(text) > 80 and block_share[k] < 0.25) or (block_share[k] == 0 and _SENTENCE.search(text)))
            if whole or value[k] >= max(2.0, 0.2 * value[top]) or (before and self.tags[k] in _HEADINGS and share[k] < 1):
                chosen.add(k)
        inside = [False] * n
        for k in range(n):
            away = k in self.beside and top not in self.beside
            inside[k] = k in chosen or (k > 0 and inside[self.above[k]] and not away and not (share[k] > 0.5 and self.tags[k] in _CONTAINERS and size[k] > block_size[k] * block_share[k] / 2))
        return [text for element, text, _ in self.texts if inside[element]]
