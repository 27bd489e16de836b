"""Main text of web pages from streaming parser events and the text-to-tag ratio of their lines.

A line is the text between two block boundaries. Its ratio is its characters over the tags it took; ratios
are smoothed by a Gaussian along the page and split into two clusters by the threshold between their means.
The innermost container that holds most of the text of the upper cluster tells where the content is; the
region is the article or main around it, or else the container, the lowest one that holds all of that text.
All its lines are returned, short ones too, but for containers that markup names as menu, notice, advert and the like; inside an
article or main their ratio must be low as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPREAD = 1.5
REGION_SHARE = 0.6
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt rtc s samp small span "
    "strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("article main section div body td".split())
_HIDDEN = frozenset(
    "head title script style noscript template nav footer aside form button select textarea option iframe object svg canvas "
    "audio video menu dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement adsense banner banners sponsor sponsored promo cookie cookies consent gdpr notice notices "
    "popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer "
    "masthead comment comments commentlist disqus reply replies respond share sharing social related newsletter subscribe "
    "subscription login signup pagination pager skip".split())
# What a name of boilerplate may have besides such a word.
_FILLERS = frozenset(
    "area article articles banner bar block blocks body bottom box button buttons container content fixed form global group header "
    "icons inline inner item items left link links list main media message mobile out page panel posts primary reader right row "
    "secondary section site sticky story stories text thread title top unit user wrap wrapper x".split())
# Reader comments are not content, whatever their ratio.
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
_NAMED = frozenset("center dd div dl header li ol section table tbody td tr ul".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_boilerplate(name: str) -> bool:
    """Whether all parts of a class or id belong to a name of boilerplate."""
    parts = [part.lower() for part in _NAME_PARTS.findall(name)]
    return not _BOILERPLATE.isdisjoint(parts) and all(part in _BOILERPLATE or part in _FILLERS for part in parts)


def _names(attrs: list[tuple[str, str | None]]) -> list[str]:
    return [part for name, value in attrs if name in ("class", "id") and value for part in value.split()]


def _names_comments(name: str) -> bool:
    """Whether a class or id is one of boilerplate and says that it is of reader comments."""
    return _names_boilerplate(name) and not _COMMENTS.isdisjoint(part.lower() for part in _NAME_PARTS.findall(name))


def _is_hidden(tag: str, attrs: list[tuple[str, str | None]], in_content: bool) -> bool:
    if tag in _HIDDEN or tag == "header" and not in_content:
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return tag in _NAMED and any(map(_names_comments, _names(attrs)))


def _is_suspect(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    return tag in _NAMED and any(map(_names_boilerplate, _names(attrs)))


class _Lines(HTMLParser):
    """Lines of visible text with their tags, innermost container and the number of the open suspect element or 0.

    Containers are numbered as they open, so a parent has a smaller number than its children.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self._open: list[tuple[str, bool, bool]] = []
        self._counts: dict[str, int] = {}
        self._hidden = self._suspect = self._suspects = self._in_content = self._tags = 0
        self._containers: list[int] = [0]
        self.parents: list[int] = [0]
        self.depths: list[int] = [0]
        self.content: set[int] = set()
        self._text: list[str] = []

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                self.lines.append((text, self._tags, self._containers[-1], self._suspects if self._suspect else 0))
                self._tags = 0

    def _push(self, tag: str, hidden: bool, suspect: bool) -> None:
        self._open.append((tag, hidden, suspect))
        self._counts[tag] = self._counts.get(tag, 0) + 1
        self._hidden += hidden
        self._suspects += suspect and not self._suspect
        self._suspect += suspect
        if tag in _CONTAINERS:
            number = len(self.parents)
            self.parents.append(self._containers[-1])
            self.depths.append(len(self._containers))
            self._containers.append(number)
            if tag in ("article", "main"):
                self.content.add(number)
        self._in_content += tag in ("article", "main")

    def _pop(self) -> str:
        tag, hidden, suspect = self._open.pop()
        self._counts[tag] -= 1
        self._hidden -= hidden
        self._suspect -= suspect
        if tag in _CONTAINERS:
            self._containers.pop()
        self._in_content -= tag in ("article", "main")
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
            return
        if tag not in _INLINE:
            self._flush()
            # A body ends the head, and a block ends an open paragraph.
            if tag == "body":
                while self._counts.get("head"):
                    self._pop()
            if self._open and self._open[-1][0] == "p":
                self._pop()
        if tag not in _VOID:
            # Inside an article a name alone does not decide.
            suspect, inside = _is_suspect(tag, attrs), self._in_content > 0
            self._push(tag, _is_hidden(tag, attrs, inside) or suspect and not inside, suspect and inside)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash does not close an element of HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag not in _INLINE:
            self._flush()
        if self._counts.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._text.append(data)

    def finish(self) -> list[tuple[str, int, int, int]]:
        if self.rawdata.startswith("<!--"):
            # A comment that never ends runs to the end of the page.
            self.rawdata = ""
        self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    reach = int(np.ceil(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The border of two clusters: halfway between the means of what lies below and above it."""
    border = float(values.mean())
    for _ in range(50):
        upper = values >= border
        if upper.all() or not upper.any():
            return border
        new = (float(values[upper].mean()) + float(values[~upper].mean())) / 2
        if abs(new - border) < 1e-9:
            break
        border = new
    return border


def main_text(html: str) -> str:
    """The lines of the content region, joined by line feeds."""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    sizes = np.array([len(text) for text, _, _, _ in lines], float)
    ratios = smoothed(sizes / np.maximum(1, [tags for _, tags, _, _ in lines]))
    border = threshold(ratios)
    suspects = np.array([suspect for _, _, _, suspect in lines])
    if suspects.any():
        # A suspect element goes if the ratios of its lines lie in the lower cluster on the average.
        mean = np.bincount(suspects, ratios) / np.maximum(1, np.bincount(suspects))
        stays = (suspects == 0) | (mean[suspects] >= border)
        if stays.any():
            lines, sizes, ratios = [line for line, x in zip(lines, stays) if x], sizes[stays], ratios[stays]
    content = np.where(ratios >= border, sizes, 0.0)
    if not content.any():
        content = sizes
    parents, depths = parser.parents, parser.depths
    held = np.bincount([c for _, _, c, _ in lines], content, len(parents)).tolist()
    for c in range(len(parents) - 1, 0, -1):
        held[parents[c]] += held[c]
    core = max((c for c in range(len(parents)) if held[c] >= REGION_SHARE * held[0]), key=lambda c: (depths[c], held[c]))
    path = [core]
    while path[-1]:
        path.append(parents[path[-1]])
    # Of the articles and mains around it the lowest with as much as any; without them the lowest container with all.
    around = [c for c in path if c in parser.content] or path
    region = next(c for c in around if held[c] >= held[around[-1]])
    inside = [False] * len(parents)
    for c, parent in enumerate(parents):
        inside[c] = c == region or c > 0 and inside[parent]
    return "\n".join(text for text, _, c, _ in lines if inside[c])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The columns of the pages but the html, and the main text of each.

    A null or empty html, or one without visible text, gives an empty text. A page is one row in, one row
    out, so ties and repeated rows need no rule; a column named like the new one is replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    names = [*kept, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=names)

    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.select(html_col, *kept).mapInArrow(run, f"{fields}`{text_col}` string")
