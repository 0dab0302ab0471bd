"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one per block element. Each line has a weight: the
length of its text outside links, more where it ends a sentence, is a heading or
stands in the marked article, and nothing where it has no text outside links. The
weights are summed over sliding windows of lines. Where a sum reaches ``SURGE``
there is text; the stretch goes on to both sides until a sum dives below ``DIVE``,
as over a run of short lines. Short lines at the ends of a stretch are left out.
On pages that mark their article, tags decide more than windows do (below).

Tags cut lines and set weights. Lines inside menus, footers, asides, forms and what
a class or id names as advert, notice, comments and the like weigh nothing and are
passed over, so they neither start a stretch nor part one. A class or id that marks
nearly all text of a page (a wrapper) marks nothing, comments excepted. Where the
page marks its article, lines outside it are passed over; lines in it weigh more, so
its short paragraphs and lists don't dive, but runs of lines that are only links do.

Class and id mark a line by whole names (``cookie-notice``, not ``with-sidebar``). A
tag ends at the first > outside the quotes of its values, however long it is; after
a quote that nothing closes, tags of that page end at their first >.

A page without any surge keeps its lines that aren't passed over, so short articles
stay. Null and empty pages have an empty text; nulls in page_id and url stay.
Repeated rows are read each for itself, pages of any length whole. Other columns are
passed over, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, and the sums at which text surges and dives.
WINDOW, SURGE, DIVE = 3, 75, 45
#: What a sentence's end or a heading, and the marked article add to a line's weight; lighter lines don't end a stretch.
CLOSED, MARKED, LIGHT = 25, 30, 25
#: Share of a page's text from which on a class or id that holds it marks nothing.
WHOLE = 0.9

# Elements of the HTML standard.
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
_OUT = frozenset("nav footer aside form button select menu dialog head datalist fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# Names in class and id that mark something other than the article, and words that may stand beside them in one name.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended "
    "popup modal overlay widget widgets login paywall pagination pager toolbar skip".split()
)
_BESIDE = frozenset(
    "area articles bar block bottom box buttons container form icons inner item items link links list main mobile page posts primary "
    "secondary section site stories text top wrap wrapper".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())

_TAG = re.compile(r"<(?:!--|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
# The rest of a tag: quotes count only where a value begins.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>][^\s>]*)))?""")
_SPACE = re.compile(r"\s+")
_ENDS = frozenset(".!?:;\u2026\"'\u201d\u00bb")


@lru_cache(4096)
def _marks(names: str) -> frozenset[str]:
    """Words of the names in a class or id that as a whole mark something other than the article."""
    out: set[str] = set()
    for name in names.lower().split():
        words = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}
        if words & _OUT_WORDS and words <= _OUT_WORDS | _BESIDE:
            out |= words & _OUT_WORDS
    return frozenset(out)


def _attributes(inside: str) -> dict[str, str]:
    """Attributes of a tag by name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(inside):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _line(pieces: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(pieces))).strip()


@dataclass(frozen=True)
class Line:
    """``plain``: length outside links; ``out``: inside an element that isn't the article;
    ``marks``: (number, whether of comments) of the elements around it that a class or id marks."""

    text: str
    plain: int
    heading: bool
    out: bool
    marks: tuple[tuple[int, bool], ...]
    article: bool

    def weight(self) -> int:
        if not self.plain:
            return 0
        return self.plain + CLOSED * (self.heading or self.text[-1] in _ENDS) + MARKED * self.article


def lines_of(page: str) -> list[Line]:
    """Each line of the page, in order."""
    out: list[Line] = []
    piece: list[str] = []
    plain: list[str] = []  # the pieces outside links
    link = heading = linked = False  # inside a link, inside a heading, whether the line has link text
    away: list[list] = []  # open elements that don't count: [name, depth of that name, holds comments, number if a class or id marks it]
    article = serial = 0  # depth of article and main elements that count; marked elements so far

    def close() -> None:
        nonlocal linked
        text = _line(piece)
        if text:
            rest = _line(plain) if linked else text
            length = len(rest) if not linked or any(map(str.isalnum, rest)) else 0
            marks = tuple((a[3], a[2]) for a in away if a[3])
            out.append(Line(text, length, heading, len(marks) < len(away), marks, article > 0))
        piece.clear()
        plain.clear()
        linked = False

    def add(part: str) -> None:
        nonlocal linked
        piece.append(part)
        if link and not heading:
            linked = True
        else:
            plain.append(part)

    at, n, lower, odd = 0, len(page), None, False  # odd: a quote that nothing closes was met
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            at = n if stop < 0 else stop + 3
            continue
        stop = page.find(">", m.end())
        if stop < 0:
            break  # a tag that the page's end cuts off
        inside = page[m.end() : stop]
        if not m[1] and not odd and ('"' in inside or "'" in inside):
            if q := _REST.match(page, m.end()):
                stop, inside = q.end() - 1, page[m.end() : q.end() - 1]
            else:
                odd = True
        at = stop + 1
        if m[1]:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name in _BLOCK:
            close()
            if name in _HEADINGS:
                heading = not closing
        elif name == "a":
            link = not closing and "href" in _attributes(inside)
            continue
        if closing:
            if away and away[-1][0] == name:
                away[-1][1] -= 1
                if not away[-1][1]:
                    away.pop()
            elif any(a[0] == name for a in away):
                while away[-1][0] != name:
                    away.pop()
                away[-1][1] -= 1
                if not away[-1][1]:
                    away.pop()
            elif name in ("article", "main") and not away:
                article = max(0, article - 1)
            continue
        if name in _RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != n:  # a letter whose lower case is longer
                end = re.compile(rf"(?i)</{name}\b").search(page, at)
                end = end.start() if end else -1
            else:
                end = lower.find(f"</{name}", at)
            at = n if end < 0 else end
            continue
        if name in _VOID or inside.endswith("/"):
            continue
        has = _attributes(inside) if inside.strip() else {}
        marks = _marks(has.get("class", "")) | _marks(has.get("id", ""))
        role, hidden = has.get("role", "").strip().lower(), "hidden" in has
        talk = bool(marks & _COMMENT_WORDS)
        if name in ("article", "main") and not talk:
            if away and not any(a[2] for a in away):
                away.clear()  # an article is not part of a menu or an advert: that one was never closed
            if not away:
                article += 1
            continue
        if name == "body":
            away.clear()
        elif away and away[-1][0] == name:
            away[-1][1] += 1
        elif name in _OUT or role in _OUT_ROLES or hidden or name == "header" and not article:
            away.append([name, 1, talk, 0])
        elif marks & _OUT_WORDS:
            serial += 1
            away.append([name, 1, talk, serial])
    close()
    return out


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """(first, end) of the lines in windows around a surge, up to the dives; light lines at the ends are left out."""
    window = min(window, len(weights))
    sums = []
    total = sum(weights[: window - 1]) if window else 0
    for i in range(len(weights) - window + 1 if window else 0):
        total += weights[i + window - 1]
        sums.append(total)
        total -= weights[i]
    out, start, hot = [], 0, False
    for i, total in enumerate([*sums, -1]):
        if total >= dive:
            hot = hot or total >= surge
            continue
        if hot:
            a, b = start, i + window - 1
            while a < b and weights[a] < LIGHT:
                a += 1
            while a < b and weights[b - 1] < LIGHT:
                b -= 1
            out.append((a, b))
        start, hot = i + 1, False
    return out


def candidates(lines: list[Line]) -> list[Line]:
    """The lines that aren't passed over."""
    lines = [x for x in lines if not x.out]
    inside = [x for x in lines if x.article and not x.marks]
    if inside:
        return inside
    held: dict[tuple[int, bool], int] = {}
    for x in lines:
        for m in x.marks:
            held[m] = held.get(m, 0) + x.plain
    total = sum(x.plain for x in lines)
    whole = {m for m, n in held.items() if not m[1] and n >= WHOLE * total}
    return [x for x in lines if whole.issuperset(x.marks)]


def main_text(page: str | None) -> str:
    lines = candidates(lines_of(page or ""))
    kept = stretches([x.weight() for x in lines])
    some = sorted({i for a, b in kept for i in range(a, b)}) if kept else range(len(lines))
    return " ".join(lines[i].text for i in some)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Rows (page_id, url, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", html_column)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op7_html(pages: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
