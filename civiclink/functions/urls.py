"""URL expressions. The pieces come from the generic URI pattern, so an odd link never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import col, let, trim_ws

# scheme, authority, path, query, fragment
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

# Fixed address formats of the report portal.
REPORT_PAGE = "https://{host}.cgu.gov.br/relatorio/{id}"
REPORT_PAGE_ALT = "https://{host}.cgu.gov.br/relatorios/relatorio/{id}"
REPORT_DOWNLOAD = "https://{host}.cgu.gov.br/relatorios/download/{id}"
REPORTS_UI = "https://eaud.cgu.gov.br/relatorios"


def _piece(url: Column, n: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _URI, n)


def scheme(url: Column | str) -> Column:
    return F.lower(_piece(col(url), 1))


def path(url: Column | str) -> Column:
    return _piece(col(url), 3)


def origin(url: Column | str) -> Column:
    u = col(url)
    return F.concat(scheme(u), F.lit("://"), F.regexp_replace(_piece(u, 2), "^//", ""))


def drop_fragment(url: Column | str) -> Column:
    return F.regexp_replace(col(url), "(?s)#.*$", "")


def _without_dots(p: Column) -> Column:
    """Resolve './' and '../' steps of an absolute path."""
    def flat(here: Column) -> Column:
        ups = F.size(F.split(here, r"/\.\.(?=/|$)", -1)) - 1
        step = lambda acc, _: F.regexp_replace(
            F.regexp_replace(acc, r"^(/\.\.)+(?=/|$)", ""), r"/(?!\.\.(?:/|$))[^/]*/\.\.(?:/|$)", "/"
        )
        done = F.aggregate(F.sequence(F.lit(1), F.greatest(ups, F.lit(1))), here, step)
        return F.when(here.rlike(r"/\.\.(?:/|$)"), F.regexp_replace(done, r"^(/\.\.)+(?=/|$)", "")).otherwise(here)

    return let(F.regexp_replace(F.regexp_replace(p, r"/(?:\./)+", "/"), r"/\.$", "/"), flat)


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on the page `base`."""
    b, h = col(base), col(href)
    names = ("scheme", "host", "path", "query", "frag")
    pieces = F.struct(
        b.alias("base"),
        h.alias("href"),
        *[_piece(h, n).alias(name) for n, name in enumerate(names, 1)],
        *[_piece(b, n).alias("b_" + name) for n, name in enumerate(names[:3], 1)],
    )

    def joined(p: Column) -> Column:
        root = F.concat(p["b_scheme"], F.lit(":"), p["b_host"])
        folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(p["b_path"], r"[^/]*$", ""), "^/", ""))
        tail = F.concat(p["query"], p["frag"])
        whole = F.when(p["path"].startswith("/"), p["path"]).otherwise(F.concat(folder, p["path"]))
        return (
            F.when(p["href"] == "", p["base"])
            .when(p["scheme"] != "", p["href"])
            .when(p["host"] != "", F.concat(p["b_scheme"], F.lit(":"), p["href"]))
            .when(p["path"] != "", F.concat(root, _without_dots(whole), tail))
            .when(p["query"] != "", F.concat(root, p["b_path"], tail))
            .otherwise(F.concat(drop_fragment(p["base"]), p["frag"]))
        )

    return let(pieces, joined)


def page_link(base: Column | str, href: Column | str) -> Column:
    """Link target without its fragment."""
    return trim_ws(drop_fragment(resolve(base, trim_ws(href))))


def extension(url: Column | str) -> Column:
    """Lower-case extension of the last path part with its dot, or ''."""
    return F.lower(F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"(?:^|/)[^/]+(\.[^./]+)$", 1))


def _format(template: str, host: Column | str, ident: Column | str) -> Column:
    head, mid = template.split("{host}")
    mid, tail = mid.split("{id}")
    h = F.lit(host) if isinstance(host, str) else host
    return F.concat(F.lit(head), h, F.lit(mid), col(ident).cast("string"), F.lit(tail))


def report_page(ident: Column | str) -> Column:
    """Report page of a task; null where there is no task id."""
    i = col(ident).cast("string")
    return F.when(trim_ws(i) != "", _format(REPORT_PAGE, "eaud", i))


def download_urls(task: Column | str, audit: Column | str, host: Column) -> Column:
    """Array of (strategy, url) in trial order; the audit id only where it differs from the task id."""
    t, a = trim_ws(col(task).cast("string")), trim_ws(col(audit).cast("string"))
    entry = lambda word, i: F.struct(
        F.concat(F.lit(word), i).alias("strategy"), _format(REPORT_DOWNLOAD, host, i).alias("url")
    )
    # The strategy words.
    second = F.when((a != "") & (a != t), entry("download_idauditoria:", a))
    return F.array_compact(F.array(entry("download_idtarefa:", t), second))


def landing_urls(task: Column | str, host: Column) -> Column:
    t = col(task).cast("string")
    # The strategy words.
    return F.array(
        F.struct(F.lit("landing_relatorio").alias("strategy"), _format(REPORT_PAGE, host, t).alias("url")),
        F.struct(
            F.lit("landing_relatorios_relatorio").alias("strategy"),
            _format(REPORT_PAGE_ALT, host, t).alias("url"),
        ),
    )
