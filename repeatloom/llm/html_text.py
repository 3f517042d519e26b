"""Main text of HTML pages by tag-path ratios.

A page is read as a sequence of text blocks, each at the end of a path of tags from the
root; containers are told apart by their class too. Per path, the length of text, its
punctuation and link text are summed over its blocks. These are fused into one ratio, the
length of a block times its punctuation times what is no link times the root of the path's
share of all text. Ratios are smoothed over paths that follow each other under one parent,
and paths below a threshold are left out. Of the rest, the element that holds most of it is
the content; blocks outside of it stay only if they weigh as much as a good part of it.
Headings and list items next to kept blocks go with them.

Elements and class names weigh a path's ratio by fixed factors, no more: names that mark
half of a page's text or more as side matter are not believed.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

BLOCK_BYTES = 4_000_000
THRESHOLD = 0.15  # of the largest fused ratio
CONTENT, SIDE = 2, 1 / 64  # weights of content and of each of up to two side elements around a block
INSIDE = 0.7  # share of the selected text that an element holds if the content lies in it
OUTSIDE = 0.3  # of the content's text, what an element outside must hold to stay

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^"'>])*+|[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements of HTML by how they are read.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "head"}
WRAPS = {"form", "dialog", "fieldset", "header"}  # of these, those that may stand around the main text
NEAR = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "pre"}
LEAVES = {"p", "br", "tr", "tbody", "thead", "summary", "address", *NEAR}  # too small to be the content by themselves
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "address", "fieldset", "menu"}
PLAIN_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|sidebar|side|widget|menu|nav\w*|footer|foot|masthead|breadcrumbs?|comments?|commentlist|disqus|replies|respond|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|popup|modal|overlay|search|pagination|pager|tags?|toolbar|skip|copyright|legal|contentinfo|complementary|navigation|header|top-?bar)(?:$|[\s_-])",
    re.I,
)
NEVER_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|footer|foot|copyright|legal|related|recommend\w*|nav|navigation)(?:$|[\s_-])", re.I)
MILD_HINT = re.compile(r"(?:^|[\s_-])(?:header|top-?bar|banner|masthead|notice|alert|side|tags?)(?:$|[\s_-])", re.I)  # no hint within an article
CONTENT_HINT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story|body-?text|text|maincontent)(?:$|[\s_-])", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。、，！？؟…]")


class Page:
    """The blocks of a page, its elements and its paths; elements and paths point to their parents."""

    def __init__(self):
        # Of each element: parent, path, nearest side element around it (itself included).
        self.parent, self.path, self.side = [-1], [0], [-1]
        # Of each path: parent, tag; and its number by (parent, label).
        self.above, self.tag, self.known = [-1], [""], {}
        # Of each side element: the next one around it, and whether it can never hold the main text.
        self.outer, self.never = [], []
        # Of each block: text, link characters, element, whether in content.
        self.text, self.links, self.at, self.content = [], [], [], []

    def path_of(self, parent: int, label: str, tag: str) -> int:
        key = parent, label
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.above)
            self.above.append(parent)
            self.tag.append(tag)
        return found


def read_page(html_text: str) -> Page:
    """Blocks in page order, with the elements and paths they stand in."""
    page = Page()
    stack: list[tuple[str, int, bool]] = []  # tag, element, in content
    words: list[str] = []
    links, link_depth, at, n = 0, 0, 0, len(html_text)

    def flush():
        nonlocal links
        text = " ".join("".join(words).split())
        if text:
            _, element, content = stack[-1] if stack else ("", 0, False)
            page.text.append(text)
            page.links.append(min(links, len(text)))
            page.at.append(element)
            page.content.append(content)
        words.clear()
        links = 0

    match = TOKEN.match
    while at < n:
        m = match(html_text, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            text = html.unescape(text)  # a character reference does not go on behind a tag
        elif m["cdata"] is not None:
            text = m["cdata"]
        if text is not None:
            words.append(text)
            if link_depth:
                links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m["close"]:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html_text, at)
                at = end.end()
            continue
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if m["close"] else 1
            continue
        flush()
        link_depth = 0
        if tag in VOID:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        _, parent, content = stack[-1] if stack else ("", 0, False)
        names = " ".join(filter(None, (x for g in NAMED.findall(m["rest"] or "") for x in g)))
        own = tag in ("article", "main") or (bool(names) and tag not in ("html", "body") and bool(CONTENT_HINT.search(names)))
        side = tag in ASIDE or (tag == "header" and not content)
        never = tag in ASIDE and tag not in WRAPS
        if names and tag not in ("html", "body", "article", "main") and PLAIN_HINT.search(MILD_HINT.sub(" ", names) if content else names):
            side = True
            never = never or bool(NEVER_HINT.search(names))
        around = page.side[parent]
        if tag == "main":
            around = -1
        elif tag == "article":
            while around >= 0 and not page.never[around]:
                around = page.outer[around]
        if side:
            page.outer.append(around)
            page.never.append(never)
            around = len(page.outer) - 1
        label = f"{tag}.{names.split(' ')[0]}" if names and tag not in NEAR and tag != "p" else tag
        page.parent.append(parent)
        page.path.append(page.path_of(page.path[parent], label, tag))
        page.side.append(around)
        stack.append((tag, len(page.parent) - 1, content or (own and around < 0)))
    flush()
    return page


def path_sums(page: Page) -> dict[int, list[int]]:
    """Of each path with text, in page order: blocks, characters, punctuation, link characters."""
    sums: dict[int, list[int]] = {}
    for text, links, at in zip(page.text, page.links, page.at):
        own = sums.setdefault(page.path[at], [0, 0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(PUNCTUATION.findall(text))
        own[3] += links
    return sums


def fused_ratios(page: Page, sums: dict[int, list[int]]) -> dict[int, float]:
    """One ratio for each path, smoothed over the paths before and after it under the same parent."""
    most = max(s for _, s, _, _ in sums.values())
    raw = {path: (s / n) * (1 + p / n) * (1 - links / s) * math.sqrt(s / most) for path, (n, s, p, links) in sums.items()}
    order = list(raw)
    out = {}
    for i, path in enumerate(order):
        near = [raw[q] for q in order[max(i - 1, 0) : i] + order[i + 1 : i + 2] if page.above[q] == page.above[path]]
        smooth = (6 * raw[path] + sum(near)) / (6 + len(near))
        out[path] = min(smooth, 2 * raw[path])
    return out


def weights(page: Page) -> list[float]:
    """The weight of each block by hints; a side element that holds half of a page's unlinked text or more is not believed."""
    loose = [len(t) - x for t, x in zip(page.text, page.links)]
    held = [0] * len(page.outer)
    for at, chars in zip(page.at, loose):
        if page.side[at] >= 0:
            held[page.side[at]] += chars
    for k in range(len(held) - 1, -1, -1):  # inner ones come after outer ones
        if page.outer[k] >= 0:
            held[page.outer[k]] += held[k]
    total, counted = sum(loose), []
    for k, outer in enumerate(page.outer):
        counted.append((counted[outer] if outer >= 0 else 0) + (page.never[k] or 2 * held[k] < total))
    sides = [counted[page.side[at]] if page.side[at] >= 0 else 0 for at in page.at]
    return [(CONTENT if content else 1) * SIDE ** min(n, 2) for content, n in zip(page.content, sides)]


def content_of(page: Page, mass: list[float]) -> list[bool]:
    """Whether each block lies in the content: the innermost element that holds INSIDE of all mass, or beside it with OUTSIDE as much."""
    held = [0.0] * len(page.parent)
    for at, m in zip(page.at, mass):
        held[at] += m
    for k in range(len(held) - 1, 0, -1):  # an element comes after its parent
        held[page.parent[k]] += held[k]
    root, k, total = 0, 0, held[0]
    for k in range(1, len(held)):  # descends, as of two elements with INSIDE of the mass one holds the other
        if page.parent[k] == root and held[k] >= INSIDE * total:
            root = k
    while root and page.tag[page.path[root]] in LEAVES:
        root = page.parent[root]
    around = [False] * len(held)
    k = root
    while k >= 0:
        around[k], k = True, page.parent[k]
    # Of each element: whether it or one around it is the content, or stands beside with enough.
    kept = [False] * len(held)
    for k in range(len(held)):
        beside = not around[k] and page.tag[page.path[k]] not in LEAVES and held[k] >= OUTSIDE * held[root]
        kept[k] = k == root or beside or (k > 0 and kept[page.parent[k]])
    return [kept[at] for at in page.at]


def main_text(html_text: str) -> str:
    """The main text of a page: white space in a block becomes one space, blocks are joined by one."""
    page = read_page(html_text)
    if not page.text:
        return ""
    ratio = fused_ratios(page, path_sums(page))
    weight = weights(page)
    paths = [page.path[at] for at in page.at]
    value = [ratio[p] * w for p, w in zip(paths, weight)]
    most = max(value)
    if not most:
        return ""
    passing = [v >= THRESHOLD * most for v in value]
    inside = content_of(page, [(len(t) - x) * w if p else 0.0 for t, x, w, p in zip(page.text, page.links, weight, passing)])
    passing = [p and i for p, i in zip(passing, inside)]
    first, last = _spans(page.above)
    kept = list(passing)
    for order in (range(len(kept)), range(len(kept) - 1, -1, -1)):
        before = None  # the block before in this order, if it is kept
        for i in order:
            if before is not None and not passing[i] and weight[i] >= weight[before] and _beside(page, i, before, first, last):
                kept[i] = True
            before = i if kept[i] else None
    return " ".join(t for t, k in zip(page.text, kept) if k)


def _spans(above: list[int]) -> tuple[list[int], list[int]]:
    """Of each path, the first and the last place of the paths under it in an order by parents."""
    size = [1] * len(above)
    for k in range(len(above) - 1, 0, -1):
        size[above[k]] += size[k]
    first, free = [0] * len(above), [1] * len(above)
    for k in range(1, len(above)):
        first[k] = free[above[k]]
        free[above[k]] += size[k]
        free[k] = first[k] + 1
    return first, [f + n for f, n in zip(first, size)]


def _beside(page: Page, block: int, kept: int, first: list[int], last: list[int]) -> bool:
    """Whether a heading or list item goes with a kept block next to it: one's parent path is the other's or around it."""
    own, other = page.path[page.at[block]], page.path[page.at[kept]]
    if page.tag[own] not in NEAR or page.links[block] >= 0.8 * len(page.text[block]):
        return False
    under = lambda p, q: first[q] <= first[p] < last[q]
    return under(own, max(page.above[other], 0)) or under(other, max(page.above[own], 0))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the main text of every page in ``text`` and its code points in ``n_chars``.

    A null or empty page has an empty text; repeated rows give repeated rows; a page without
    any tag is all text; columns named text or n_chars are replaced, others kept; an empty
    table gives an empty result. Very long pages are read whole.
    """
    rest = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    page = "__page"
    while page in rest:
        page += "_"
    rows = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{column}`").cast("string").alias(page))

    def run(batches):
        for block in X.text_blocks(batches, BLOCK_BYTES, page):
            texts = [main_text(p or "") for p in block.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    schema = rows.select(*(F.col(f"`{c}`") for c in rest), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(run, schema)
