"""HTML extraction by tag-path ratios.

A page is cut into text blocks, each with its path of tags from the root.  For every path
of a page the length of its text and its punctuation are added up and divided by the number
of its blocks; both ratios are smoothed over the tree of paths, where paths that differ in fewer
tags weigh more, and multiplied.  Paths above a share of the page's spread are content.  The
smallest element that holds nearly all of the content's text is the article: its blocks are
the text.

What a page says of itself comes first: elements that by tag or role are menus, headers,
footers, forms or scripts give no blocks.  A class or id that sounds like a sidebar, an advert,
a notice or comments may mean something else.  Where sentences in an article or main element, two
blocks of sentences of one path, or a tenth of all sentences lie outside of such names, what has them goes as well, however long it
is; else a name lowers the ratio of the paths within.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsdiff.llm.common import slices

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
NO_TEXT = frozenset(
    "head script style title noscript template nav aside footer form button select option textarea input iframe object svg canvas audio video "
    "dialog menu noembed noframes xmp".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
# A start of one of these ends an open p; an li, dt, dd, tr, td, th or option ends its like.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# All that a head may hold: the start of any other element ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table article section main aside nav div body html td th blockquote form footer header".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|"
    r"sidebar|side-bar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar|toolbar|comments?|"
    r"commentlist|disqus|replies|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|widget|"
    r"pagination|pager|copyright|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
# What such a name says is there, or is not, around the content.
_STATE = re.compile(r"(?:^|(?<=\s))(?:no|not|has|with|without|is|hide|show)[_-]\S*", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")
SMOOTHING = 1.0
SPREAD = 0.25
NAMED = 0.1       # share of its ratio that a path keeps within an element named like boilerplate
NEARLY_ALL = 0.9  # of the content's text, in the element taken for the article
FARTHEST = 6      # tags between paths that are smoothed together; farther ones would weigh less than one in 10 million
FEW_PATHS = 150   # up to which distances are taken pair by pair; the results are the same
SENTENCE = 25     # code points before the mark at a sentence's end, at least
_END = re.compile(r"[.!?…。！？]")


@dataclass
class Page:
    """Elements by number, parents first, 0 around the whole page; tag paths as a tree of their own; blocks of text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[int] = field(default_factory=lambda: [0])          # elements named like boilerplate, itself and around it
    in_article: list[bool] = field(default_factory=lambda: [False])
    path: list[int] = field(default_factory=lambda: [0])
    path_parent: list[int] = field(default_factory=lambda: [-1])
    path_number: dict[tuple[int, str, bool], int] = field(default_factory=dict)
    blocks: list[tuple[int, str]] = field(default_factory=list)    # (element, text) in page order

    def add(self, parent: int, tag: str, named: bool) -> int:
        key = (self.path[parent], tag, named)
        if key not in self.path_number:
            self.path_number[key] = len(self.path_parent)
            self.path_parent.append(self.path[parent])
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        self.names.append(self.names[parent] + named)
        self.in_article.append(self.in_article[parent] or tag in ("article", "main"))
        self.path.append(self.path_number[key])
        return len(self.parent) - 1


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NO_TEXT or (tag == "header" and not in_article):
        return True
    if "=" not in attributes:
        return bool(re.search(r"\bhidden\b", attributes))
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return bool(re.search(r"\bhidden\b", _ATTRIBUTE.sub("", attributes)))


def _sounds_like_boilerplate(tag: str, attributes: str) -> bool:
    if "=" not in attributes or tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    values = ("".join(values) for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
    return any(_BOILERPLATE.search(_STATE.sub("", value)) for value in values)


def parse(page: str) -> Page:
    """The text blocks of a page in order, without those of elements that are boilerplate by tag or role.

    Elements that are never closed end where HTML lets them end, or with the page.
    """
    out = Page()
    # element, tag, boilerplate: block elements and those left out or named
    stack: list[tuple[int, str, bool]] = [(0, "", False)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    at = 0

    def finish() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.blocks.append((stack[-1][0], text))

    def hidden() -> bool:
        return stack[-1][2]

    def has_open(*tags: str) -> bool:
        return any(opened.get(t) for t in tags)

    def cut(depth: int) -> None:
        for _, t, _ in stack[depth:]:
            opened[t] -= 1
        del stack[depth:]

    def end_head() -> None:
        """Ends a head that was never closed; its templates hold whatever they like."""
        if has_open("head") and not has_open("template"):
            cut(max(i for i, (_, t, _) in enumerate(stack) if t == "head"))

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside the raw text of a script or the like
            continue
        if m.start() > at and stack[-1][1] == "head" and not page[at:m.start()].isspace():
            end_head()
        if m.start() > at and not hidden():
            parts.append(page[at:m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "br":
                finish()
            if not has_open(tag):
                continue
            depth = len(stack) - 1
            while stack[depth][1] != tag:
                depth -= 1
            finish()
            cut(depth)
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("br", "hr"):
            finish()
            continue
        if tag in VOID:
            continue
        boilerplate = hidden() or _is_boilerplate(tag, attributes, has_open("article", "main"))
        named = _sounds_like_boilerplate(tag, attributes)
        # Inline elements are part of the text around them; a named one outside of paragraphs stands for itself.
        if tag in INLINE and (hidden() or not boilerplate and (not named or has_open("p", "blockquote", "pre", *HEADINGS))):
            continue
        if tag not in INLINE or not boilerplate:
            finish()
        ends = LIKE.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        depth = len(stack) - 1
        while has_open(*ends) and stack[depth][1] not in SCOPE and depth:
            if stack[depth][1] in ends:
                cut(depth)
                boilerplate = hidden() or _is_boilerplate(tag, attributes, has_open("article", "main"))
            depth -= 1
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append((out.add(stack[-1][0], tag, named), tag, boilerplate))
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page) and stack[-1][1] == "head" and not page[at:].isspace():
        end_head()
    if at < len(page) and not hidden() and not re.match(r"<[/a-zA-Z!]", page[at:at + 2]):
        parts.append(page[at:])
    finish()
    return out


def near_sums(parent: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """For each path the sums of all paths' ratios, weighed by their distance in the tree.

    Sums at a distance come from sums over what lies below each path and its ancestors.
    """
    n = len(parent)
    below = [ratios]
    for _ in range(FARTHEST):
        up = np.zeros_like(ratios)
        np.add.at(up, parent[1:], below[-1][1:])
        below.append(up)
    ancestors = [np.arange(n)]
    for _ in range(FARTHEST):
        ancestors.append(np.where(ancestors[-1] >= 0, parent[ancestors[-1]], -1))
    out = np.zeros_like(ratios)
    for apart in range(FARTHEST + 1):
        there = below[apart].copy()
        for up in range(1, apart + 1):
            one = ancestors[up] >= 0
            there[one] += below[apart - up][ancestors[up][one]]
            if apart - up:
                there[one] -= below[apart - up - 1][ancestors[up - 1][one]]
        out += np.exp(-(apart**2) / (2 * SMOOTHING**2)) * there
    return out


def near_sums_of_few(parent: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The same from all distances, which is faster for few paths."""
    n = len(parent)
    over = np.eye(n, dtype=np.float32)  # which paths are above each, itself included; parents come first
    for i in range(1, n):
        over[i] += over[parent[i]]
    depth = over.sum(axis=1)
    apart = depth[:, None] + depth[None, :] - 2 * (over @ over.T)
    return np.where(apart <= FARTHEST, np.exp(-(apart.astype(float)**2) / (2 * SMOOTHING**2)), 0) @ ratios


def path_scores(page: Page, blocks: list[tuple[int, str]]) -> np.ndarray:
    """Fused, smoothed ratio of each tag path; those without text have none (NaN)."""
    parent = np.array(page.path_parent)
    n = len(parent)
    at = np.array([page.path[e] for e, _ in blocks])
    length = np.bincount(at, [len(text) for _, text in blocks], n)
    marks = np.bincount(at, [len(_PUNCTUATION.findall(text)) for _, text in blocks], n)
    count = np.bincount(at, minlength=n)
    has = count > 0
    ratios = np.zeros((n, 3))
    ratios[has] = np.column_stack([length[has] / count[has], (marks[has] + 0.5) / count[has], np.ones(has.sum())])
    smooth = (near_sums_of_few if n <= FEW_PATHS else near_sums)(parent, ratios)
    out = np.full(n, np.nan)
    out[has] = np.prod(smooth[has, :2] / smooth[has, 2:], axis=1)
    return out


def told(page: Page) -> bool:
    """Whether the page has an article that nothing names like boilerplate: then all that is named so is."""
    plain = named = 0
    paths: set[int] = set()
    for element, text in page.blocks:
        if any(len(part) >= SENTENCE for part in _END.split(text)[:-1]):
            if page.names[element]:
                named += len(text)
            elif page.in_article[element] or page.path[element] in paths:
                return True
            else:
                paths.add(page.path[element])
                plain += len(text)
    return plain > 0 and plain >= (1 - NEARLY_ALL) * (plain + named)


def main_text(html_: str | None) -> str:
    """The article's blocks, one a line; empty if the page has no text."""
    page = parse(html_ or "")
    found = page.blocks
    if told(page):
        found = [(element, text) for element, text in found if not page.names[element]]
    if not found:
        return ""
    scores = path_scores(page, found)
    of = [float(scores[page.path[element]]) * (NAMED if page.names[element] else 1) for element, _ in found]
    values = np.array(list({page.path[element]: score for (element, _), score in zip(found, of, strict=True)}.values()))
    least = SPREAD * values.std()
    # One named like boilerplate is content only if even so it is not below any other path.
    plain = max((score for (element, _), score in zip(found, of, strict=True) if not page.names[element]), default=0.0)
    content = [score >= (max(least, plain) if page.names[element] else least) for (element, _), score in zip(found, of, strict=True)]
    # The deepest element with nearly all of the content, an article or main element first.
    inside = [0] * len(page.parent)
    for (element, text), is_content in zip(found, content, strict=True):
        inside[element] += len(text) * is_content
    total = sum(inside)
    for element in range(len(inside) - 1, 0, -1):
        inside[page.parent[element]] += inside[element]
    full = [e for e in range(1, len(inside)) if inside[e] >= NEARLY_ALL * total and inside[e]]
    articles = [e for e in full if page.tag[e] in ("article", "main")]
    wide = [e for e in full if page.tag[e] not in ("p", "li", "pre") and page.tag[e] not in HEADINGS | INLINE]
    holder = max(articles or wide, key=lambda e: page.depth[e], default=None)
    if holder is None or (not articles and page.tag[holder] in ("body", "html")):
        return "\n".join(text for (_, text), is_content in zip(found, content, strict=True) if is_content)
    # All that is in it, but what is named like boilerplate there and has a low ratio.
    within = [e == holder for e in range(len(inside))]
    for element in range(holder + 1, len(within)):
        within[element] = within[page.parent[element]]
    return "\n".join(
        text for (element, text), is_content in zip(found, content, strict=True)
        if within[element] and (is_content or page.names[element] == page.names[holder])
    )


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points).

    A null or empty page, or one without text, has the empty text.  Repeated rows give
    repeated results, an empty table an empty one.  Other columns are left out.
    """
    types = dict(pages.dtypes)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(
        texts, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    )
