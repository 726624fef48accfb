r"""HTML extraction by line-block distribution.

The page is cut into blocks at block-level markup; each block is a line. A line's weight
is its text length, or 0 if it is boilerplate: inside a menu, header, footer, sidebar,
advert, notice, form or comment (by element, role, or a name among its classes or id),
or, outside an article, mostly links. A name marks if its last word does (``page-footer``), or its first before
words like ``list`` (``comments-area``); an element that is marked by its name alone, but not as comments, and has more
than half of the page's text, and an article, main or h1 if there is one, is a wrapper, not boilerplate. Text in an article weighs ``FRAMED`` times as much. Weights
are summed over a sliding window of lines. Text surges where the sum passes the threshold and
dives where it falls to 0 or an article starts or ends; lines of weight above 0 from the start of
a surge's stretch to its dive are kept. Where the page's heaviest stretch is in an article, those
outside also need a ``FRAMED``-th of its sum, and the other way round. A page in which nothing
surges keeps its heaviest stretch. Only <main>, of which a page has one, is taken at its word: what
stands outside it weighs nothing.

Defined results: null or empty html gives the empty text and 0 characters; comments,
scripts, styles and templates are never text, unclosed ones reach to the end of the page;
character references follow the HTML rules, within one piece of text between tags; other columns are dropped; repeated rows give
repeated results; an empty table gives no rows. One page is parsed in memory, in time
linear in its length.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML elements by how they are treated.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select canvas audio video noembed noframes xmp".split())
BOILER = frozenset("nav footer aside form menu dialog search button fieldset".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " alert popup modal overlay comment comments disqus replies reply respond discussion share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager copyright legal skip".split()
)
REMARKS = frozenset("comment comments disqus replies reply respond discussion".split())
AFTER = frozenset("area bar block body box button buttons container content form group inner item items label link links list menu nav panel posts row section text thread trail widget widgets wrap wrapper".split())
BEFORE = frozenset("has is no not with without".split())
TITLES = frozenset("header banner masthead".split())

#: How much more a character in an article weighs than one outside.
FRAMED = 4

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(attrs: str) -> list[tuple[str, str]]:
    """Names, lowered, and values of a tag's attributes, one after another."""
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)]


def _name_marks(name: str, in_article: int) -> str:
    """The word by which a class or id marks boilerplate, or nothing."""
    words = [w for w in _SPLIT.split(name.lower() if name.isupper() else name) if w]
    words = [w.lower() for w in words]
    if not words or words[0] in BEFORE:
        return ""
    if words[-1] in WORDS and not (in_article and words[-1] in TITLES and len(words) > 1):
        return words[0] if words[0] in REMARKS else words[-1]
    return words[0] if words[0] in WORDS and all(w in AFTER or w in WORDS for w in words[1:]) else ""


#: How an element is boilerplate: not, by its name alone, or for certain.
NOT, NAMED, SURE = 0, 1, 2


def _marked(name: str, attrs: str, in_article: int) -> int:
    if name in BOILER or (name == "header" and not in_article):
        return SURE
    if not attrs or name in ("body", "html", "article", "main") and "comment" not in attrs.lower():
        return NOT
    found = NOT
    for key, value in _attributes(attrs):
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES:
            return SURE
        if key in ("class", "id"):
            for word in filter(None, (_name_marks(x, in_article) for x in value.split())):
                found = max(found, SURE if word in REMARKS else NAMED)
    return found


class _Scanner:
    """Finds the ends of markup in a page, in time linear in its length whatever quotes stay open."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.places: list[int] = []  # of quotes and ``>``, and where a tag that has come there ends; filled at the first open quote
        self.ends: list[int] = []

    def _measure(self) -> None:
        """The next ``>`` outside quotes from each quote or ``>`` on, or -1; in one pass from the end of the page."""
        self.places = [m.start() for m in _STOP.finditer(self.page)]
        self.ends = [-1] * (len(self.places) + 1)
        later: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            mark = self.page[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k]
            else:
                self.ends[k] = self.ends[later[mark] + 1] if mark in later else -1
                later[mark] = k

    def _tag(self, start: int) -> re.Match | None:
        if self.ends and self.ends[bisect_left(self.places, _NAME.match(self.page, start).end())] < 0:
            return None
        m = _TAG.match(self.page, start)
        if m is None:
            self._measure()
        return m

    def markup(self, start: int) -> tuple[int, re.Match | None] | None:
        """The end of the tag, comment or declaration that starts here, and a tag's match; None if it is only a ``<``."""
        page = self.page
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return (len(page) if end < 0 else end + 3), None
        after = page[start + 1 : start + 2]
        letter = page[start + 2 : start + 3] if after == "/" else after
        if after not in ("!", "?", "/") and not (letter.isascii() and letter.isalpha()):
            return None
        close = page.find(">", start)
        if close < 0:
            return len(page), None  # the end of the page cuts it off
        if not (letter.isascii() and letter.isalpha()):
            return close + 1, None
        m = self._tag(start + 1)
        if m is None:  # a quote that nothing closes
            return close + 1, _TAG.match(page[start + 1 : close].replace('"', " ").replace("'", " ") + ">")
        return m.end(), m


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters inside links, boilerplate, 1 inside an article or 2 inside main) of each block that has text or is boilerplate."""
    lines: list[tuple[str, int, bool, int, int]] = []
    around = [-1]  # of each element that its name alone marks, the one around it; number 0 is none
    framed: Counter = Counter()  # articles, main and h1 directly in each
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked = anchors = 0
    state = (False, 0, 0)  # boilerplate for certain, in an article or main, number of the marked element

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, linked, *state))
        parts.clear()
        linked = 0

    at, start, n = 0, -1, len(page)
    scanner = _Scanner(page)
    while at < n:
        start = page.find("<", max(at, start + 1))
        found = scanner.markup(start) if start >= 0 else (n, None)
        if found is None:
            continue
        text = _html.unescape(page[at : start if start >= 0 else n])
        if text:
            parts.append(text)
            linked += len(text) if anchors else 0
        at, m = found
        if m is None:
            continue
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name in BLOCKS:
                flush()
            elif name == "br" or name in RAW:
                parts.append(" ")
            if opened[name]:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                outer = stack[i - 1][1:] if i else (False, 0, 0)
                if outer != state:
                    flush()
                opened.subtract(x[0] for x in stack[i:])
                del stack[i:]
                state = outer
            continue
        if name in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if name == "a":
            anchors += 1
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] == name:
            opened[stack.pop()[0]] -= 1
            state = stack[-1][1:] if stack else (False, 0, 0)
        sure, article, marked = state
        mark = NOT if sure else _marked(name, attrs, article)
        if mark == NAMED:
            around.append(marked)
            marked = len(around) - 1
        now = sure or mark == SURE, max(article, 2 if name == "main" or "main" in attrs and ("role", "main") in _attributes(attrs) else int(name == "article")), marked
        if now != state:
            flush()
            if mark:
                lines.append(("", 0, now[0], article, marked))  # boilerplate leaves a gap even where it has no text
        state = now
        stack.append((name, *now))
        opened[name] += 1
        if name in ("article", "main", "h1") and not state[0]:
            framed[marked] += 1
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            anchors = 0
    flush()
    return _judged(lines, around, framed)


def _judged(lines: list[tuple[str, int, bool, int, int]], around: list[int], framed: Counter) -> list[tuple[str, int, bool, int]]:
    """Elements that a name marks are boilerplate unless they are wrappers: most of what isn't boilerplate for certain is in them."""
    inside, frames = [0] * len(around), [framed[k] for k in range(len(around))]
    for text, _, sure, _, marked in lines:
        inside[marked] += 0 if sure else len(text)
    total, any_frame = sum(inside), sum(frames)
    for k in range(len(around) - 1, 0, -1):
        inside[around[k]] += inside[k]
        frames[around[k]] += frames[k]
    bad = [False] * len(around)
    for k in range(1, len(around)):
        bad[k] = bad[around[k]] or 2 * inside[k] <= total or bool(any_frame) and not frames[k]
    return [(text, linked, sure or bad[marked], article) for text, linked, sure, article, marked in lines if text or sure or bad[marked]]


def extract(page: str, window: int = 3, surge: int = 80) -> str:
    """The main text, blocks joined by line ends."""
    if not page:
        return ""
    lines = lines_of(page)
    main = any(inside == 2 and not bad and text for text, _, bad, inside in lines)
    weights = []
    for text, linked, bad, inside in lines:
        gone = bad or not text or main and inside < 2 or not inside and 2 * linked >= len(text)
        weights.append(0 if gone else len(text) * (FRAMED if inside else 1))
    stretches: list[tuple[int, int, int]] = []  # peak of the window sum, first line, last line
    i, n = 0, len(weights)
    while i < n:
        if not weights[i]:
            i += 1
            continue
        peak, first, last = 0, i, i
        total = 0
        while i < n and (not weights[i] or bool(lines[i][3]) == bool(lines[first][3])):  # window sums along the stretch, until one is 0
            total += weights[i] - (weights[i - window] if i - window >= first else 0)
            if not total:
                break
            peak = max(peak, total)
            if weights[i]:
                last = i
            i += 1
        stretches.append((peak, first, last))
    if not stretches:
        return ""
    best, at, _ = max(stretches)
    least = min(surge, best)
    kept = [(first, last) for peak, first, last in stretches if peak >= least and (bool(lines[first][3]) == bool(lines[at][3]) or FRAMED * peak >= best)]
    return "\n".join(lines[k][0] for first, last in kept for k in range(first, last + 1) if weights[k])


def extract_pages(pages: DataFrame, window: int = 3, surge: int = 80) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x or "", window, surge) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", "html")
    kind = dict(pages.dtypes)
    return pages.mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
