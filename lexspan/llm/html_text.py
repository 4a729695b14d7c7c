"""Main text of web pages from flat text blocks.

A page is read as a flat run of text blocks, parted by block-level tags. Each block has its
word count and link density, those of its neighbours, and whether an enclosing tag, class or
id names a part of the page (menus, adverts and the like, or the article). A decision tree,
trained here on a small labelled table, decides which blocks are main text; what pages call
their parts is one of its seven features, and where they call them nothing, or names speak
for both, the text of a block and of its neighbours decides.

A null or empty page gives an empty text. Broken markup is no error: a tag cut off at the
end of the page is markup, an unclosed script or comment runs to the end, an unclosed form
control to the next block. A form that holds more than ``WRAPPER`` words of text besides links is
a page's wrapper, and no furniture. Time grows with the page's length, whatever its tags. Rows are
independent; columns besides ``html`` pass through; ``text`` and ``n_chars`` replace input
columns of these names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tags whose content is no text at all, up to their end; and those that a block ends too.
SILENT = {"script", "style", "noscript", "template", "svg", "head", "title", "iframe", "textarea"}
CONTROLS = {"select", "button", "canvas", "audio", "video", "map"}
#: Tags that may stand in a control.
IN_CONTROL = {"option", "optgroup", "source", "track", "param", "area"}
#: Tags that run within a line; every other tag parts blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "object", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags of formulas run within a line too.
INLINE |= {"math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "semantics", "annotation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags of page furniture, and of the article.
FURNITURE = {"nav", "footer", "aside", "menu", "dialog"}
ARTICLE = {"article", "main"}
#: Words outside links that make a form a wrapper of the page.
WRAPPER = 60
#: Words in class, id or role that name furniture, and the article.
FURNITURE_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|side-?bar|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar|comments?|commentlist|respond|replies|reply|disqus|related\w*|recommend\w*|share\w*|sharing|social\w*|newsletter|subscribe|signup|sign-up|login|search\w*|pagination|pager|tags?|tagcloud|copyright|legal|disclaimer|skip\w*|complementary|contentinfo|navigation|form)(?=$|[\s_-])", re.I)
ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|post|post-?(?:body|content|text)|entry|entry-?content|story\w*|main|main-?content|content|body-?text|prose)(?=$|[\s_-])", re.I)

#: Names of layouts: they say what stands beside the article, not what they hold.
LAYOUT_WORDS = re.compile(r"(?:^|[\s_-])(?:with|has|no|without|layout|page|site|wrapper|container|grid|row|columns?)(?=$|[\s_-])", re.I)
#: Furniture in which even an element that is named an article is none.
CLOSED_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|respond|replies|reply|disqus|related\w*|recommend\w*)(?=$|[\s_-])", re.I)

#: Furniture that a layout's name beside it doesn't excuse; headers only outside an article.
_PLAIN_FURNITURE = re.compile(r"notice|cookie|consent|share|social|footer|nav|menu", re.I)
_HEADERS = re.compile(r"header|banner|masthead", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPACE = re.compile(r"\s+")

#: What stands before and after a block: words and link density of both.
BESIDE = [(60, 0.0, 70, 0.0), (40, 0.0, 0, 0.0), (0, 0.0, 50, 0.0), (2, 1.0, 3, 1.0), (60, 0.0, 2, 1.0), (3, 1.0, 45, 0.0), (1, 0.0, 4, 0.0), (5, 0.0, 80, 0.0), (0, 0.0, 0, 0.0), (12, 0.2, 9, 0.1)]
#: Labelled blocks that are what they are beside each of these: words, link density, part of
#: the page (-1 furniture, 0 unnamed, 1 article), and whether the block is main text.
ALONE = [
    # in an article: prose of any length, but no lists of links
    (1, 0.0, 1, 1),
    (3, 0.0, 1, 1),
    (8, 0.0, 1, 1),
    (12, 0.1, 1, 1),
    (30, 0.4, 1, 1),
    (45, 0.1, 1, 1),
    (80, 0.0, 1, 1),
    (150, 0.05, 1, 1),
    (1, 1.0, 1, 0),
    (2, 1.0, 1, 0),
    (4, 1.0, 1, 0),
    (8, 0.95, 1, 0),
    (20, 0.9, 1, 0),
    # furniture of any length
    (1, 1.0, -1, 0),
    (3, 0.0, -1, 0),
    (9, 0.0, -1, 0),
    (30, 0.0, -1, 0),
    (60, 0.0, -1, 0),
    (120, 0.1, -1, 0),
    (250, 0.0, -1, 0),
    # unnamed: long blocks without many links are prose, links are none
    (16, 0.0, 0, 1),
    (20, 0.1, 0, 1),
    (25, 0.0, 0, 1),
    (40, 0.3, 0, 1),
    (60, 0.1, 0, 1),
    (80, 0.0, 0, 1),
    (120, 0.05, 0, 1),
    (1, 1.0, 0, 0),
    (2, 1.0, 0, 0),
    (6, 0.6, 0, 0),
    (9, 0.7, 0, 0),
    (15, 1.0, 0, 0),
    (20, 0.9, 0, 0),
    (30, 0.6, 0, 0),
    (45, 0.8, 0, 0),
]
#: Labelled short blocks in no named part, which their neighbours tell apart: words, link
#: density, words and link density of the block before and after, and the label.
BETWEEN = [
    # short ones between prose, or before it: headings, answers, captions
    (6, 0.0, 50, 0.0, 60, 0.0, 1),
    (1, 0.0, 80, 0.0, 80, 0.0, 1),
    (4, 0.0, 60, 0.0, 40, 0.0, 1),
    (3, 0.0, 25, 0.0, 25, 0.0, 1),
    (12, 0.0, 12, 0.0, 25, 0.0, 1),
    (5, 0.0, 3, 1.0, 60, 0.0, 1),
    (2, 0.0, 1, 1.0, 30, 0.0, 1),
    (8, 0.0, 0, 0.0, 45, 0.0, 1),
    (5, 0.0, 60, 0.0, 14, 0.0, 1),
    (10, 0.0, 5, 0.0, 70, 0.0, 1),
    (9, 0.0, 40, 0.1, 20, 0.1, 1),
    (6, 0.0, 50, 0.0, 8, 0.0, 1),
    (10, 0.0, 30, 0.0, 6, 0.0, 1),
    (3, 0.0, 45, 0.0, 5, 0.0, 1),
    (8, 0.0, 28, 0.1, 12, 0.0, 1),
    (4, 0.0, 80, 0.0, 10, 0.1, 1),
    # short ones beside links: labels of menus and lists
    (3, 0.0, 2, 1.0, 2, 1.0, 0),
    (5, 0.0, 4, 1.0, 3, 1.0, 0),
    (2, 0.0, 60, 0.0, 4, 1.0, 0),
    (4, 0.0, 40, 0.0, 12, 1.0, 0),
    (7, 0.0, 30, 0.0, 6, 0.8, 0),
    (6, 0.0, 3, 1.0, 5, 0.0, 0),
    (9, 0.0, 2, 1.0, 3, 0.0, 0),
    (7, 0.0, 3, 0.0, 2, 0.5, 0),
    (11, 0.0, 15, 1.0, 15, 1.0, 0),
    (2, 0.0, 60, 0.0, 15, 1.0, 0),
    (4, 0.0, 50, 0.0, 25, 0.95, 0),
    (3, 0.0, 4, 1.0, 30, 0.9, 0),
    (1, 0.0, 20, 1.0, 20, 1.0, 0),
    (9, 0.0, 30, 0.0, 18, 0.8, 0),
    (6, 0.0, 50, 0.8, 8, 0.0, 0),
    (5, 0.0, 30, 0.9, 9, 0.0, 0),
    (3, 0.0, 24, 1.0, 4, 0.0, 0),
    # short ones among short ones, or last: labels, notices
    (4, 0.0, 3, 0.0, 5, 0.0, 0),
    (8, 0.2, 50, 0.0, 0, 0.0, 0),
    (2, 0.0, 60, 0.0, 0, 0.0, 0),
    (6, 0.0, 4, 1.0, 0, 0.0, 0),
    (5, 0.0, 6, 0.0, 0, 0.0, 0),
    (9, 0.0, 8, 0.0, 4, 0.0, 0),
    (3, 0.0, 0, 0.0, 3, 0.0, 0),
]


class Tree:
    """A binary decision tree by Gini impurity, small and exact."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12):
        self.label = int(labels.mean() >= 0.5) if len(labels) else 0
        self.at: tuple[int, float] | None = None
        if depth == 0 or len(set(labels.tolist())) < 2:
            return
        best = (np.inf, 0, 0.0)
        for k in range(rows.shape[1]):
            values = np.unique(rows[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, k] <= cut
                score = sum(len(p) * p.mean() * (1 - p.mean()) for p in (labels[low], labels[~low]))
                best = min(best, (float(score), k, float(cut)))
        if best[0] == np.inf:
            return
        self.at = best[1:]
        low = rows[:, self.at[0]] <= self.at[1]
        self.low, self.high = Tree(rows[low], labels[low], depth - 1), Tree(rows[~low], labels[~low], depth - 1)

    def says(self, row: tuple) -> int:
        node = self
        while node.at:
            node = node.low if row[node.at[0]] <= node.at[1] else node.high
        return node.label


#: The training rows: words, density, those of the block before and after, part, label.
LABELLED = [(n, density, *beside, part, label) for n, density, part, label in ALONE for beside in BESIDE]
LABELLED += [(*r[:6], 0, r[6]) for r in BETWEEN]


def trained() -> Tree:
    table = np.array(LABELLED, dtype=float)
    return Tree(table[:, :-1], table[:, -1])


def is_hidden(attributes: str) -> bool:
    """Whether an element's own attributes hide it: ``hidden``, its style, or ``aria-hidden``."""
    if not _HIDDEN.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or name == "style" and _UNSEEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, part) of each text block, in page order. Tags are paired by
    a stack on which every tag is put and taken once."""
    found: list[tuple[str, int, float, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    # open tags with the part of the page they make: -2 is furniture for good, -1 furniture by
    # name alone, in which an article may still stand; and how many are open of each tag
    stack: list[tuple[str, int, int]] = []
    count: dict[str, int] = {}
    forms = [0]  # words outside links of each form, by its number; 0 is no form
    silent = ""
    links = 0

    def part() -> int:
        return stack[-1][1] if stack else 0

    def pop() -> str:
        tag = stack.pop()[0]
        count[tag] -= 1
        return tag

    here = form = 0

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                inside = len(_SPACE.sub(" ", entities.unescape(" ".join(linked))).split()) if linked else 0
                found.append((text, n, min(1.0, inside / n), max(here, -1), form))
                if here > -2:
                    forms[form] += max(0, n - inside)
            parts.clear()
            linked.clear()

    for m in _TOKEN.finditer(page):
        token, tag = m[0], m[2]
        if tag is None:
            if token[0] == "<" and len(token) > 1:
                continue  # comment or declaration
            if not silent:
                parts.append(token)
                if links:
                    linked.append(token)
            continue
        tag, closing = tag.lower(), bool(m[1])
        if silent:
            ended = closing and tag == silent
            if not ended and not (silent == "head" and tag == "body") and (silent in SILENT or tag in INLINE or tag in IN_CONTROL or tag in CONTROLS):
                continue
            silent = ""
            if ended:
                continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in SILENT or tag in CONTROLS:
            if not closing and not m[3].rstrip().endswith("/"):
                silent = tag
            if tag not in ("svg", "button", "select"):
                close()
                here, form = part(), stack[-1][2] if stack else 0
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            if closing or tag in VOID:
                if closing and count.get(tag):
                    if refused := here < 0:
                        close()
                    while pop() != tag:
                        pass
                    if refused:
                        here, form = part(), stack[-1][2] if stack else 0
                continue
            names = " ".join(x for g in _NAMES.findall(m[3]) for x in g) if m[3] else ""
            if not (names and FURNITURE_WORDS.search(names) or m[3] and is_hidden(m[3])):
                if count.get(tag):  # one of its kind is open as a block: ends must pair up
                    stack.append((tag, part(), stack[-1][2]))
                    count[tag] += 1
                continue
            # an inline tag that is hidden or names furniture is a block of its own
        close()
        links = 0
        if closing:
            if count.get(tag):
                while pop() != tag:
                    pass
        elif tag not in VOID:
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                pop()
            names = " ".join(x for g in _NAMES.findall(m[3]) for x in g) if m[3] else ""
            own, in_form = part(), stack[-1][2] if stack else 0
            root = tag in ("body", "html")
            named = bool(names) and not root and FURNITURE_WORDS.search(names) is not None
            both = named and ARTICLE_WORDS.search(names) is not None
            closed = named and not both and CLOSED_WORDS.search(names) is not None
            if named and not closed and LAYOUT_WORDS.search(names) and (own == 1 or tag in ("div", "section", "main", "article")) and not (_PLAIN_FURNITURE.search(names) or own != 1 and _HEADERS.search(names)):
                named = False
            if tag in FURNITURE or (tag == "header" and own != 1) or closed or m[3] and is_hidden(m[3]):
                own = -2
            elif both and tag not in ARTICLE:
                pass  # the names speak for both: what is inside decides
            elif named and not both:
                own = min(own, -1)
            elif own > -2 and tag in ARTICLE or own > -1 and names and ARTICLE_WORDS.search(names) and not root:
                own, in_form = 1, 0  # an article stays one in a form
            if tag == "form":
                forms.append(0)
                in_form = len(forms) - 1
            stack.append((tag, own, in_form))
            count[tag] = count.get(tag, 0) + 1
        here, form = part(), stack[-1][2] if stack else 0
    close()
    return [(text, n, density, -1 if f and forms[f] <= WRAPPER else p) for text, n, density, p, f in found]


def main_text(page: str | None, tree: Tree) -> str:
    if not page:
        return ""
    found = blocks(page)
    none = ("", 0, 0.0, 0)
    kept = []
    for i, (text, n, density, part) in enumerate(found):
        before = found[i - 1] if i else none
        after = found[i + 1] if i + 1 < len(found) else none
        if tree.says((n, density, before[1], before[2], after[1], after[2], part)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            columns = {f.name: batch.column(f.name) for f in kept}
            columns["text"] = pa.array(texts, pa.string())
            columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return pages.select(*[f"`{f.name}`" for f in kept], "html").mapInArrow(each, schema)
