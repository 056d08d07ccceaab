"""Element texts of HTML pages.

Regular expressions cannot pair nested tags, so this one step walks the tags in Python, batch
by batch inside tasks, and returns plain rows. Everything after it is column expressions.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("td", "th", "li", "p", "div", "span", "a")
PAGES_OUT = 256
CARD_CLASSES = {"accordion", "card", "cards"}
_TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+|<)")
_ATTRIBUTE = r"(?:^|\s){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_HREF, _CLASS = (re.compile(_ATTRIBUTE.format(n), re.I) for n in ("href", "class"))
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "form", "pre", "blockquote", "dl"}
# Opening one of these ends an open element of the second set, up to a boundary of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    **{b: ({"p"}, {"div", "td", "th", "li", "table", "body"}) for b in _BLOCKS},
}
SCHEMA = "kind string, ord int, row int, card boolean, href string, text string, row_text string"


def _value(pattern: re.Pattern, attributes: str) -> str | None:
    m = pattern.search(attributes)
    return None if m is None else entities.unescape(next(g for g in m.groups() if g is not None))


def walk(page: str, kinds: frozenset[str]) -> Iterator[tuple]:
    """(kind, ord, row, card, href, text) of every wanted element in document order."""
    texts: list[str] = []
    found: list[list] = []
    stack: list[tuple[str, list | None, bool, int]] = []  # tag, record, inside a card, table row
    rows = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            record = stack.pop()[1]
            if record is not None:
                record.append(len(texts))

    def innermost(tags: set[str], boundary: set[str]) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in boundary:
                return None
        return None

    for slash, tag, attributes, text in _TOKEN.findall(_HIDDEN.sub(" ", page)):
        if not tag:
            clean = " ".join(entities.unescape(text).split())
            if clean:
                texts.append(clean)
            continue
        tag = tag.lower()
        if slash:
            at = innermost({tag}, set())
            if at is not None:
                close(at)
            continue
        if tag in _ENDS:
            at = innermost(*_ENDS[tag])
            if at is not None:
                close(at)
        if tag in _VOID:
            continue
        card = bool(stack and stack[-1][2]) or bool(CARD_CLASSES & set((_value(_CLASS, attributes) or "").split()))
        row = stack[-1][3] if stack else 0
        if tag == "tr":
            rows += 1
            row = rows
        record = None
        if tag in kinds:
            record = [tag, len(found), row, card, _value(_HREF, attributes) if tag == "a" else None, len(texts)]
            found.append(record)
        stack.append((tag, record, card, row))
    close(0)
    for tag, order, row, card, link, start, end in found:
        yield tag, order, row, card, link, " ".join(texts[start:end])


def page_elements(
    pages: DataFrame, keep: list[str], html: str = "html", kinds: tuple[str, ...] = KINDS, containing: str | None = None
) -> DataFrame:
    """One row per element with the `keep` columns of its page; table cells also carry the text of
    their whole row. With `containing`, a pattern, only elements whose text has it come back."""
    chosen = _chooser(kinds, containing)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keep, "kind", "ord", "row", "card", "href", "text", "row_text"]
        for frame in frames:
            # A few pages at a time, so that a batch of large pages stays small on its way out.
            for at in range(0, len(frame), PAGES_OUT):
                out = [
                    (*ident, *element)
                    for *ident, page in frame[[*keep, html]].iloc[at:at + PAGES_OUT].itertuples(index=False, name=None)
                    if page
                    for element in chosen(page)
                ]
                yield pd.DataFrame(out, columns=names)

    source = pages.select(*keep, html)
    ident = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInPandas(batches, f"{ident}, {SCHEMA}")


def _chooser(kinds: tuple[str, ...], containing: str | None):
    """Page -> its wanted elements with the text of their table row."""
    wanted, needle = frozenset(kinds), re.compile(containing) if containing else None

    def chosen(page: str) -> list[tuple]:
        elements = list(walk(page, wanted))
        rows: dict[int, list[str]] = {}
        for kind, _, row, _, _, text in elements:
            if kind in ("td", "th") and row:
                rows.setdefault(row, []).append(text)
        joined = {row: " | ".join(cells) for row, cells in rows.items()}
        return [
            (*e, joined.get(e[2]) if e[0] in ("td", "th") else None)
            for e in elements
            if needle is None or needle.search(e[5])
        ]

    return chosen


def with_elements(
    pages: DataFrame, keep: list[str], html: str = "html", kinds: tuple[str, ...] = KINDS, containing: str | None = None
) -> DataFrame:
    """One row per page, pages without elements included: the `keep` columns and `elements`, an array
    of (kind, row, text)."""
    chosen = _chooser(kinds, containing)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PAGES_OUT):
                part = frame.iloc[at:at + PAGES_OUT]
                found = [[{"kind": e[0], "row": e[2], "text": e[5]} for e in chosen(page)] if page else [] for page in part[html]]
                yield part[keep].assign(elements=found)

    source = pages.select(*keep, html)
    ident = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInPandas(batches, f"{ident}, elements array<struct<kind:string,row:int,text:string>>")
