"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path. For each path, text length
(outside links) and punctuation per block are aggregated; the two series are smoothed along the page and
fused into one score a path, and the paths above a threshold are content: all their blocks, wherever they
stand. What tags, roles and class names say of an element is a prior on its paths' scores, for or against;
where they say nothing the ratios decide alone. Only what is never text (scripts, styles, form controls,
the head, hidden elements) goes before.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never text of the page, whatever it holds.
NO_TEXT = frozenset("head form button select option menu dialog object audio video canvas map fieldset".split()) | RAW
FURNITURE = frozenset("nav footer aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Log priors of paths: through furniture, and through what names itself the content.
AGAINST, FOR = -20.0, 4.0
#: Of elements that authors write in: headings are short, paragraphs are the usual place of text.
OF_TAG = dict.fromkeys(HEADINGS, 1.5) | {"p": 1.0, "blockquote": 1.0, "pre": 1.0}
#: Share of the page's mean score that a content path reaches.
THRESHOLD = 0.4
#: Words in class or id that name what isn't the article.
NAMED = frozenset("""ad ads adv advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist
    disqus respond replies reply cookie cookies consent copyright footer gdpr menu menubar masthead modal nav navbar navigation navi newsletter notice notices
    discussion responses promoted aside adsbygoogle notification pager pagination popup popover promo promotion related recommended recommendations rail share sharing sidebar sidebars sidenav signup skip social
    sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets alert disclaimer paywall login header""".split())
CONTENT = frozenset("article body content entry main post story text".split())
NEVER = frozenset("ad ads advert adverts advertisement comment comments commentlist disqus cookie consent footer menu nav sidebar".split())
_WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Blocks end an open p; the listed tags end an open one of their kind, unless it stands outside the innermost of BOUNDS.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = ("ul", "ol", "table", "dl", "select")
#: Quotes count only where a value begins; one that never ends is a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|["']?))*+)>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']\S*)))?""")
_PUNCTUATION = re.compile(r"""[.,;:!?¿¡…。，、；：！？—–"'“”„«»()]""")


@dataclass(slots=True)
class Element:
    """path: the number of its tag path; prior: the log prior of that path; block: the nearest element that is no inline one."""

    tag: str
    path: int
    prior: float
    dropped: bool
    in_article: bool
    reader: bool = False
    block: Element | None = None


@dataclass(slots=True)
class Block:
    tag: str
    path: int
    prior: float
    text: str
    linked: int


def _attributes(raw: str) -> dict[str, str]:
    """Names and values; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def _judge(tag: str, raw: str, in_article: bool) -> tuple[bool, float, str, bool]:
    """Whether an element is never text, its log prior, its first class word for the path, whether it holds readers' words."""
    if tag in NO_TEXT:
        return True, 0.0, "", False
    prior = AGAINST if tag in FURNITURE or (tag == "header" and not in_article) else FOR if tag in ("article", "main") else 0.0
    if not raw.strip(" /\t\n\r\f"):
        return False, prior, "", False
    attrs = _attributes(raw)
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or "display:none" in style or attrs.get("aria-hidden", "").strip().lower() == "true":
        return True, 0.0, "", False
    if attrs.get("role", "").strip().lower() in ROLES:
        return False, AGAINST, "", False
    first, named, content, reader = "", set(), False, False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORD_OF_NAME.findall(name)]
        first = first or (words[0] if words else "")
        if {"with", "has", "no"}.intersection(words):
            continue  # has-sidebar says what else the page has
        named |= NAMED.intersection(words)
        content |= bool(words) and CONTENT.issuperset(words)
        reader |= any(w in name.lower() for w in ("comment", "respond", "repl", "disqus"))
    if tag in ("html", "body") or tag in HEADINGS:
        return False, prior, first, reader
    if named and not (tag == "main" or (content and not named & NEVER) or (in_article and named <= {"header"})):
        return False, AGAINST, first, reader
    return False, FOR if content else prior, first, reader


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, entities decoded, white space made one space; in time linear in the page, however deep it nests."""
    root = Element("", 0, 0.0, False, False)
    root.block = root
    stack, out, parts, linked, links = [root], [], [], 0, 0
    numbers: dict[tuple, int] = {}  # (path above, label, prior) -> path
    opened: dict[str, list[int]] = defaultdict(list)  # of each tag, where it stands in the stack
    endless: set[str] = set()  # raw elements without an end in the rest of the page
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            block = stack[-1].block
            out.append(Block(block.tag, block.path, block.prior, text, linked))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            e = stack.pop()
            opened[e.tag].pop()
            links -= e.tag == "a"

    def last(*tags: str) -> int:
        """Where the innermost open element of these stands; 0: there is none."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].dropped:
            text = entities.unescape(raw)
            parts.append(text)
            linked += len(text.strip()) if links else 0

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if tag not in INLINE:
            close()
        if m[1]:
            if k := last(tag):
                pop(k)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if not stop:
                endless.add(tag)
            at = stop.end() if stop else end if tag in ("script", "style") else at
            continue
        if tag not in INLINE:
            k = last("p", *HEADINGS)
            if k and (stack[k].tag == "p" or tag == "p" or tag in HEADINGS):
                pop(k)
            for kind in ENDS.get(tag, ()):
                if (k := last(kind)) > last(*BOUNDS):
                    pop(k)
        top = stack[-1]
        dropped, prior, name, reader = _judge(tag, attrs, top.in_article)
        if tag in ("article", "main") and not dropped and prior > 0 and (top.dropped or top.prior < 0) and not top.reader:
            pop(next(i for i, e in enumerate(stack) if e.dropped or e.prior < 0))  # furniture that was never closed
            top = stack[-1]
        if attrs.rstrip().endswith("/") and tag not in INLINE and dropped:
            continue
        prior = top.prior if top.prior < 0 or not prior else prior
        label = (tag, name, prior)
        path = top.path if tag in INLINE and prior == top.prior else numbers.setdefault((top.path, *label), len(numbers) + 1)
        e = Element(tag, path, prior, top.dropped or dropped, top.in_article or tag in ("article", "main"), top.reader or reader)
        e.block = e if tag not in INLINE or prior != top.prior else top.block
        opened[tag].append(len(stack))
        stack.append(e)
        links += tag == "a"
    close()
    return out


def _smooth(x: list[float]) -> list[float]:
    """Weights 1 2 1 along the page."""
    return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) / 4 for i in range(len(x))]


def path_scores(found: list[Block]) -> dict[int, float]:
    """Of each tag path the mean over its blocks of the fused series: smoothed text length times smoothed punctuation, as they are on the average of a path."""
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in found:
        length[b.path] += max(len(b.text) - b.linked, 0)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        count[b.path] += 1
    by_length = _smooth([length[b.path] / count[b.path] for b in found])
    by_marks = _smooth([marks[b.path] / count[b.path] for b in found])
    fused: dict[int, float] = defaultdict(float)
    for b, x, y in zip(found, by_length, by_marks, strict=True):
        fused[b.path] += x * (1 + y) / count[b.path]
    return fused


def select(found: list[Block], threshold: float = THRESHOLD) -> list[Block]:
    """Blocks of the content paths: score times prior reaches the threshold's share of the page's mean, where furniture hardly counts.

    A path that is mostly links is content only where nothing else is.
    """
    if not found:
        return []
    scores, size, linked = path_scores(found), defaultdict(int), defaultdict(int)
    for b in found:
        size[b.path] += len(b.text)
        linked[b.path] += b.linked
    weights = [len(b.text) * math.exp(min(b.prior, 0.0)) for b in found]
    bar = threshold * sum(scores[b.path] * w for b, w in zip(found, weights, strict=True)) / sum(weights)
    above = [b for b in found if scores[b.path] * math.exp(b.prior + OF_TAG.get(b.tag, 0.0)) >= bar]
    return [b for b in above if linked[b.path] < 0.8 * size[b.path]] or [b for b in above if b.prior >= 0]


def main_text(page: str | None) -> str:
    """Empty for null, empty and textless pages."""
    return " ".join(b.text for b in select(blocks(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages.

    The whole html is read, however long, however deep it nests and however it ends: cut pages give what
    they hold, and tags that never end or close cost no more than others. Null html is an empty page;
    repeated rows give equal rows; an empty table gives none; other columns are not read.
    """

    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    return pages.select("page_id", "url", texts(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
