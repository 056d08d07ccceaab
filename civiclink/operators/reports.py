"""Report candidates from search answers and legacy pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.ids import candidate_id
from civiclink.functions.jsonx import filled_text, nested_items, nesting, parse
from civiclink.functions.markup import api_paths
from civiclink.functions.text import collapse_ws, let, query_key, trim_ws
from civiclink.functions.urls import resolve
from civiclink.operators.pages import anchors, first_report_link
from civiclink.operators.rows import keep_last
from civiclink.operators.skew import salted_join

CONTEXT = ["municipality_name", "uf", "ibge_municipality_code", "query_terms_used"]


def search_phrases(places: DataFrame, name: str = "municipality_name", uf: str = "uf") -> DataFrame:
    """Three search phrases per place: name/UF, name UF, name."""
    n, u = F.col(name), F.col(uf)
    phrases = F.array(F.concat_ws("/", n, u), F.concat_ws(" ", n, u), n)
    return places.select("*", F.posexplode(phrases).alias("query_order", "query_terms_used"))


def title_confidence(name: Column | str, title: Column | str) -> Column:
    """high when the place key occurs in the title key, else medium."""
    key = query_key(name)
    both = F.struct(key.alias("name"), query_key(title).alias("title"))
    named = lambda k: F.when((k["name"] != "") & F.contains(k["title"], k["name"]), "high").otherwise("medium")
    return let(both, named)


def search_items(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per item object of every search answer, with the other columns of the answer."""
    others = [c for c in answers.columns if c != payload]
    items = nested_items(parse(payload), nesting(F.col(payload)))
    return answers.select(*others, F.posexplode(items).alias("item_order", "item"))


def candidates_from_items(items: DataFrame, base_url: str, strategy: str, discovered_at_utc: str) -> DataFrame:
    """Candidate rows of search items; `items` has the context columns and an `item` variant."""
    item, base = F.col("item"), F.lit(base_url)
    keep = [c for c in items.columns if c not in ("item", *CONTEXT)]
    # Two steps: the texts are read from the item once, the rules then work on plain columns.
    # The keys of an item.
    texts = items.select(
        *keep,
        *CONTEXT,
        F.coalesce(trim_ws(filled_text(item, "id", "relatorioId", "codigo")), F.lit("")).alias("_id"),
        F.nullif(trim_ws(filled_text(item, "titulo", "relatorio", "nome")), F.lit("")).alias("title_text"),
        F.nullif(trim_ws(filled_text(item, "dataPublicacao", "data")), F.lit("")).alias("date_text"),
        filled_text(item, "pdfUrl", "urlPdf").alias("_pdf"),
        filled_text(item, "landingUrl", "url").alias("_landing"),
    )
    own_page = F.when(F.col("_id") != "", F.concat(base, F.lit("/relatorio/"), "_id")).otherwise(base)
    linked = texts.withColumn("_landing", F.coalesce("_landing", own_page))
    out = linked.select(
        *keep,
        *CONTEXT,
        F.lit(strategy).alias("source_strategy"),
        resolve(base, "_landing").alias("landing_url"),
        resolve(base, "_pdf").alias("pdf_url"),
        "title_text",
        "date_text",
        F.lit("json_result").alias("notes"),
        title_confidence("municipality_name", "title_text").alias("confidence"),
        F.lit(discovered_at_utc).alias("discovered_at_utc"),
        query_key("municipality_name").alias("normalized_muni_name"),
    )
    return out.withColumn("candidate_id", candidate_id("landing_url", "pdf_url", "municipality_name", "source_strategy"))


def candidates_from_pages(pages: DataFrame, key: str, strategy: str, discovered_at_utc: str) -> DataFrame:
    """Anchors of a legacy result page that name the place or carry its state.

    The state test is a two-letter substring and lets many unrelated links pass.
    """
    context = [c for c in CONTEXT if c in pages.columns]
    links = anchors(pages, key, keep=context)
    full = resolve("page_url", collapse_ws("href"))
    text = collapse_ws("text")
    found = links.withColumn("landing_url", full).withColumn("_key", query_key(F.concat_ws(" ", text, full)))
    name = query_key("municipality_name")
    found = found.where(F.contains("_key", name) | F.contains("_key", F.upper("uf")))
    out = found.select(
        key,
        "pos",
        *context,
        F.lit(strategy).alias("source_strategy"),
        "landing_url",
        F.when(F.lower("landing_url").endswith(".pdf"), F.col("landing_url")).alias("pdf_url"),
        F.nullif(text, F.lit("")).alias("title_text"),
        F.lit(None).cast("string").alias("date_text"),
        F.lit("legacy_html_parse").alias("notes"),
        F.lit("medium").alias("confidence"),
        F.lit(discovered_at_utc).alias("discovered_at_utc"),
        name.alias("normalized_muni_name"),
    )
    return out.withColumn("candidate_id", candidate_id("landing_url", "pdf_url", "municipality_name", "source_strategy"))


def fill_missing_pdf(candidates: DataFrame, detail_pages: DataFrame, base_url: str, **skew) -> DataFrame:
    """PDF of candidates without one from their detail page: its first PDF link, else the first
    API path that looks like a download. `detail_pages` has one row per landing_url."""
    looks_right = lambda p: F.lower(p).rlike(r"download|arquivo|\.pdf")
    first_path = F.try_element_at(F.filter(api_paths("html"), looks_right), F.lit(1))
    details = detail_pages.select(
        "landing_url", first_report_link("html", "landing_url").alias("_linked"), resolve(F.lit(base_url), first_path).alias("_quoted")
    )
    spread = F.struct("candidate_id", "query_terms_used")
    out = salted_join(candidates, details, ["landing_url"], spread, "left", **skew)
    lacks = F.coalesce(F.col("pdf_url"), F.lit("")) == ""
    note = F.when(lacks & F.col("_linked").isNotNull(), "pdf_from_detail").when(
        lacks & F.col("_quoted").isNotNull(), "pdf_api_candidate"
    )
    return out.withColumns(
        {
            "notes": F.concat_ws(";", "notes", note),
            "pdf_url": F.when(lacks, F.coalesce("_linked", "_quoted", "pdf_url")).otherwise(F.col("pdf_url")),
        }
    ).drop("_linked", "_quoted")


def unique_candidates(candidates: DataFrame, order_by: list[str]) -> DataFrame:
    """Last row per candidate id."""
    return keep_last(candidates, "candidate_id", order_by)


def report_index(candidates: DataFrame) -> DataFrame:
    return candidates.withColumnRenamed("candidate_id", "report_candidate_id")
