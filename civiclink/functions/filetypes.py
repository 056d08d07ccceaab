"""File kinds from names, content types and first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import col
from civiclink.functions.urls import extension

# Extensions taken from a URL as they are, and extensions of linked resources.
URL_EXTENSIONS = (".html", ".htm", ".pdf", ".csv", ".xls", ".xlsx", ".doc", ".docx")
RESOURCE_EXTENSIONS = (".pdf", ".doc", ".docx", ".csv", ".xls", ".xlsx")


def guess_extension(content_type: Column | str, url: Column | str) -> Column:
    """Extension by URL, else by content type, else .bin."""
    ctype, ext = F.lower(F.coalesce(col(content_type), F.lit(""))), extension(url)
    chain = F.when(ext.isin(*URL_EXTENSIONS), ext)
    for word in ("html", "pdf", "csv"):
        chain = chain.when(ctype.contains(word), F.lit("." + word))
    return chain.otherwise(F.lit(".bin"))


def resource_type(ext: Column | str) -> Column:
    e = col(ext)
    return F.when(e.isin(".html", ".htm"), "html").when(e == ".pdf", "pdf").otherwise("unknown")


def signature(content: Column | str, content_type: Column | str) -> Column:
    """File kind by leading bytes and content type: pdf, docx, doc, or bin when unknown."""
    head = F.hex(F.substring(col(content), 1, 4))
    ctype = F.lower(F.coalesce(col(content_type), F.lit("")))
    return (
        F.when((head == "25504446") | ctype.contains("pdf"), "pdf")
        .when(head == "504B0304", "docx")
        .when((head == "D0CF11E0") | ctype.contains("msword") | ctype.contains("officedocument"), "doc")
        .otherwise("bin")
    )


def signature_ok(content: Column | str, content_type: Column | str) -> Column:
    return signature(content, content_type) != "bin"


def disposition_filename(header: Column | str) -> Column:
    """File name of a Content-Disposition header, null when it names none."""
    name = F.regexp_extract(col(header), r"""(?i)filename\*?=(?:UTF-8'')?"?([^";]+)""", 1)
    clean = F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", "")
    return F.when(name != "", clean)
