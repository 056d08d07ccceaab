"""Rows out of landed web pages: round links, places, resources, PDF links and their status.

Input is a page table with a key column, `url` and `html`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions import markup
from civiclink.functions.filetypes import RESOURCE_EXTENSIONS, resource_type
from civiclink.functions.ids import round_id
from civiclink.functions.text import clip, collapse_ws, let, trim_name_tail, trim_ws
from civiclink.functions.urls import extension, page_link, resolve
from civiclink.operators.elements import page_elements, with_elements
from civiclink.operators.rows import keep_first

# The states, the name/state pattern, and the word every round link carries.
STATES = [
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA",
    "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
]
ROUND_HINT = "sorteio"
_NAME = r"A-Za-zÀ-ÿ0-9\s'`´\-\."
# A name starts at the beginning of a run of name characters or where the last hit ended, which
# finds the same hits as trying every position and stays linear on long texts.
PLACE = rf"(?:(?<![{_NAME}])|\G)([{_NAME}]+?)\s*(?:/|-)\s*([A-Z]{{2}})(?![\p{{L}}\p{{N}}_])"
_PLACE_TAIL = r"[/-]\s*[A-Z]{2}(?!\w)"
PLACE_KINDS = ("td", "th", "li", "p", "div", "span")
SNIPPET = 400


def anchors(pages: DataFrame, key: str, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, page_url, pos, href, text, link) of every anchor with a link target."""
    keys = [key, *(keep or [])]
    tags = pages.select(*keys, F.col(url).alias("page_url"), F.posexplode(markup.anchor_tags(html)).alias("pos", "_tag"))
    out = tags.select(*keys, "page_url", "pos", markup.href("_tag").alias("href"), markup.plain_text("_tag").alias("text"))
    return out.where(F.col("href").isNotNull()).withColumn("link", page_link("page_url", "href"))


def round_links(pages: DataFrame, key: str, hint: str = ROUND_HINT, url: str = "url", html: str = "html") -> DataFrame:
    """Links whose text or target carries the hint, first per address, links in cards before others."""
    source = pages.select(key, F.col(url).alias("page_url"), html)
    found = page_elements(source, [key, "page_url"], html, ("a",)).where(F.col("href").isNotNull())
    clean = found.select(
        key, "page_url", "ord", "card", collapse_ws("href").alias("href"), collapse_ws("text").alias("text")
    ).where(F.col("href") != "")
    hinted = clean.where(F.lower(F.concat_ws(" ", "text", "href")).rlike(hint))
    ordered = hinted.withColumn("link", page_link("page_url", "href")).withColumn("_late", (~F.col("card")).cast("int"))
    first = keep_first(ordered, [key, "link"], ["_late", "ord"])
    label = F.coalesce(F.nullif("text", F.lit("")), F.lit("round_link"))
    return first.select(
        key,
        F.col("page_url").alias("source_page_url"),
        F.col("link").alias("url"),
        label.alias("round_label"),
        round_id(label, "link").alias("round_id"),
        F.struct("_late", "ord").alias("position"),
    )


def place_hits(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Every name/state hit in cells, list items and text blocks, with its place in the page: the
    first hit of a cell or list item, all hits of a text block. Pages are walked once."""
    found = page_elements(pages, [key], html, PLACE_KINDS, _PLACE_TAIL)
    cell, item = F.col("kind").isin("td", "th"), F.col("kind") == "li"
    found = found.where(~cell | (F.col("row") > 0))
    hits = F.regexp_extract_all("text", F.lit(PLACE), F.lit(0))
    single = F.when(cell | item, F.slice(hits, 1, 1)).otherwise(hits)
    method = F.when(cell, "table").when(item, "li").otherwise("regex")
    phase = F.when(cell, 0).when(item, 1).otherwise(2)
    each = found.select(
        key, "ord", method.alias("parse_method"), phase.alias("phase"),
        F.when(cell | item, "high").otherwise("medium").alias("confidence"),
        clip(F.coalesce("row_text", "text"), SNIPPET).alias("source_snippet"),
        F.posexplode(single).alias("hit", "_hit"),
    )
    named = each.select(
        key, F.struct("phase", "ord", "hit").alias("position"), F.regexp_extract("_hit", PLACE, 1).alias("municipality_name_raw"),
        F.regexp_extract("_hit", PLACE, 2).alias("uf"), "source_snippet", "parse_method", "confidence",
    )
    return named.where(F.col("uf").isin(STATES))


def page_places(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Hits of a page without repeats: position of the first, content of the last of each
    (lower-case name, state, method)."""
    named = place_hits(pages, key, html).withColumn("municipality_name_clean", trim_name_tail("municipality_name_raw"))
    content = ["municipality_name_raw", "municipality_name_clean", "source_snippet", "confidence"]
    named = named.where(F.col("municipality_name_clean") != "").withColumn("_lower", F.lower("municipality_name_clean"))
    return (
        named.groupBy(key, "_lower", "uf", "parse_method")
        .agg(F.min("position").alias("position"), F.max_by(F.struct(*content), "position").alias("_c"))
        .select(key, "uf", "parse_method", "position", "_c.*")
    )


def round_places(places: DataFrame, key: str) -> DataFrame:
    """First row per page, clean name (case kept) and state."""
    return keep_first(places, [key, "municipality_name_clean", "uf"], "position")


def resource_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Links to documents and tables, first per address; a page never leaves its row until the end."""
    rows = pages.select(key, F.explode(_resources(html, url)).alias("_r"))
    return rows.select(key, "_r.link", "_r.ext", "_r.pos")


def _first_each(links: Column) -> Column:
    """First of the structs with each `link`, in their order. Equal links are found by sorting, so a page
    with very many links costs little more for each."""
    tagged = F.transform(links, lambda x, i: F.struct(x["link"].alias("link"), i.alias("at"), x.alias("row")))
    ordered = F.array_sort(F.filter(tagged, lambda x: x["link"].isNotNull()))
    firsts = let(ordered, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["link"] != x["link"])))
    in_place = F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["row"].alias("row"))))
    return F.transform(in_place, lambda x: x["row"])


def _resources(html: Column | str, url: Column | str) -> Column:
    """(pos, link, ext) of the document links of a page, within the row."""
    link = lambda a: page_link(F.col(url) if isinstance(url, str) else url, markup.href(a))
    every = F.transform(markup.anchor_tags(html), lambda a, i: F.struct(i.alias("pos"), link(a).alias("link")))
    typed = F.transform(every, lambda x: F.struct(x["pos"].alias("pos"), x["link"].alias("link"), extension(x["link"]).alias("ext")))
    return _first_each(F.filter(typed, lambda x: x["ext"].isin(*RESOURCE_EXTENSIONS)))


def _distinct_places(elements: Column) -> Column:
    """Distinct (lower-case name, state, method) of the hits of a page, within the row."""
    cell = lambda e: e["kind"].isin("td", "th")
    single = lambda e: cell(e) | (e["kind"] == "li")

    def hits(e: Column) -> Column:
        found = F.regexp_extract_all(e["text"], F.lit(PLACE), F.lit(0))
        method = F.when(cell(e), "table").when(e["kind"] == "li", "li").otherwise("regex").alias("method")
        name = lambda h: F.lower(trim_name_tail(F.regexp_extract(h, PLACE, 1))).alias("name")
        state = lambda h: F.regexp_extract(h, PLACE, 2).alias("uf")
        return F.transform(F.when(single(e), F.slice(found, 1, 1)).otherwise(found), lambda h: F.struct(name(h), state(h), method))

    every = F.flatten(F.transform(F.filter(elements, lambda e: ~cell(e) | (e["row"] > 0)), hits))
    return F.array_distinct(F.filter(every, lambda p: p["uf"].isin(*STATES) & (p["name"] != "")))


def page_status(pages: DataFrame, key: str, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Parse status of every page: parsed, needs_pdf_parse or no_municipalities_extracted. Places and
    resource links are found in one walk over the table, without a join."""
    keys = [key, *(keep or [])]
    first = F.try_element_at(_resources(html, url), F.lit(1))["ext"].alias("_ext")
    walked = with_elements(pages.select(*keys, html, first), [*keys, "_ext"], html, PLACE_KINDS, _PLACE_TAIL)
    out = walked.withColumn("parsed_municipalities_count", F.size(_distinct_places(F.col("elements"))).cast("long"))
    parsed, linked_only = F.col("parsed_municipalities_count") > 0, F.col("_ext").isNotNull()
    # States and reasons.
    return out.select(
        *keys,
        F.when(parsed, "parsed").when(linked_only, "needs_pdf_parse").otherwise("no_municipalities_extracted").alias("parse_status"),
        F.when(parsed, "")
        .when(linked_only, "round_links_to_external_resource_no_html_list")
        .otherwise("html_parsed_but_no_confident_matches")
        .alias("parse_reason"),
        F.when(~parsed & linked_only, resource_type("_ext")).otherwise("html").alias("primary_resource_type"),
        "parsed_municipalities_count",
    )


def resource_status(ext: Column | str) -> Column:
    """Status struct of a landed file that is no HTML page; null for HTML."""
    e = F.col(ext) if isinstance(ext, str) else ext
    return F.when(
        ~e.isin(".html", ".htm"),
        F.struct(
            F.lit("needs_pdf_parse").alias("parse_status"),
            F.concat(F.lit("non_html_resource:"), e).alias("parse_reason"),
            resource_type(e).alias("primary_resource_type"),
        ),
    )


def _numbered(hits: Column, phase: int) -> Column:
    return F.transform(
        hits, lambda hit, i: F.struct(F.lit(phase).alias("phase"), i.alias("pos"), hit.alias("hit"))
    )


def pdf_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """PDF addresses in order: anchors first, then addresses quoted anywhere in the page text.
    Chosen, resolved and freed of repeats within the row."""
    # Which addresses count.
    quoted = r"(?i){q}(/api/[^\"']*(?:download|arquivo|pdf)[^\"']*){q}"
    patterns = [(r"(?i)(https?://[^\"'\s>]+\.pdf)"), quoted.format(q='"'), quoted.format(q="'")]
    sources = [F.transform(markup.anchor_tags(html), lambda a: trim_ws(markup.href(a)))]
    sources += [F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns]
    hits = F.concat(*[_numbered(found, n) for n, found in enumerate(sources)])
    wanted = r"(?s)\.pdf\z|^(?=.*/api/).*(?:download|arquivo|pdf)"
    chosen = F.filter(hits, lambda h: (h["phase"] > 0) | F.lower(h["hit"]).rlike(wanted))
    full = lambda h: F.struct(h["phase"].alias("phase"), h["pos"].alias("pos"), resolve(F.col(url), h["hit"]).alias("link"))
    rows = pages.select(key, F.explode(_first_each(F.transform(chosen, full))).alias("_h"))
    return rows.select(key, "_h.phase", "_h.pos", "_h.link")


# Links of a detail page that count as its report: .pdf targets and API downloads.
REPORT_LINK = r"(?s)\.pdf\z|^(?=.*/api/).*download"


def detail_pdf_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Narrow rule for detail pages: addresses ending in .pdf, or API downloads."""
    full = lambda a, i: F.struct(i.alias("pos"), resolve(F.col(url), trim_ws(markup.href(a))).alias("link"))
    links = F.filter(F.transform(markup.anchor_tags(html), full), lambda x: F.lower(x["link"]).rlike(REPORT_LINK))
    return pages.select(key, F.explode(_first_each(links)).alias("_l")).select(key, "_l.link", "_l.pos")


def first_report_link(html: Column | str, url: Column | str) -> Column:
    """First link of a page under the narrow rule, within the row."""
    links = F.transform(markup.anchor_tags(html), lambda a: resolve(url, trim_ws(markup.href(a))))
    return F.try_element_at(F.filter(links, lambda u: F.lower(u).rlike(REPORT_LINK)), F.lit(1))


def script_paths(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Sorted distinct /api/ paths quoted in each page."""
    return pages.select(key, F.posexplode(markup.api_paths(html)).alias("pos", "path"))
