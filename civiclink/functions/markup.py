"""HTML text expressions that need no tree: comments, anchors, tag-free text, entities."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import col, collapse_ws, let, text_map

_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_ANCHOR = r"(?is)<a\s[^>]*>.*?(?:</a\s*>|(?=<a\s)|\z)"
_HREF = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_NAMED = {f"&{name};": chr(point) for name, point in name2codepoint.items() if name != "amp"}


def visible(html: Column | str) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(col(html), _HIDDEN, " ")


def unescape(c: Column | str) -> Column:
    """Named and numeric character references as characters, &amp; last."""
    def one(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        point = F.when(ref.rlike("^&#[xX]"), digits).when(ref.startswith("&#"), F.conv(digits, 10, 16))
        char = F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        return F.replace(acc, ref, F.coalesce(F.element_at(text_map(_NAMED), ref), char, ref))

    def decoded(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});)"), F.lit(1))
        plain = F.aggregate(F.array_distinct(found), text, one)
        return F.when(text.contains("&"), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(text)

    return let(col(c), decoded)


def plain_text(markup: Column | str) -> Column:
    """Text nodes joined by single spaces."""
    return collapse_ws(unescape(F.regexp_replace(col(markup), r"(?s)<[^>]*>", " ")))


def anchor_tags(html: Column | str) -> Column:
    """Array of anchor elements as markup."""
    return F.regexp_extract_all(visible(html), F.lit(_ANCHOR), F.lit(0))


def href(anchor: Column | str) -> Column:
    """Link target of an anchor element, null when it has none."""
    quoted = F.nullif(F.regexp_extract(col(anchor), _HREF, 1), F.lit(""))
    return unescape(F.regexp_replace(quoted, "^[\"']|[\"']$", ""))


def api_paths(script: Column | str) -> Column:
    """Distinct quoted /api/ paths in order."""
    double = F.regexp_extract_all(col(script), F.lit(r'"(/api/[^"]+)"'), F.lit(1))
    single = F.regexp_extract_all(col(script), F.lit(r"'(/api/[^']+)'"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(double, single)))
