"""Scalar functions over whole tables and whole texts."""

import unicodedata

from pyspark.sql import functions as F

from civiclink.functions import dates, filetypes, ids, text, urls
from civiclink.plans import sqltext as q
from civiclink.plans.registry import query


def _digest(key, column):
    return [key, F.md5(column).alias("digest"), F.length(column).alias("n")]


def _digest_sql(expr, table="documents", key="doc_id", src="text"):
    return f"SELECT {key}, md5(v) AS digest, length(v) AS n FROM (SELECT {key}, {expr(src)} AS v FROM {{{table}}})"


@query("whitespace_collapsed", _digest_sql(q.collapse))
def _(t):
    return t("documents").select(*_digest("doc_id", text.collapse_ws("text")))


@query("accents_folded", _digest_sql(q.fold))
def _(t):
    return t("documents").select(*_digest("doc_id", text.fold_accents("text")))


# Characters from all over the code space, one per customer, with what is left of each.
_ODD = ["①", "㎡", "𝐀", "ｱ", "ﷺ", "가", "कु", "ß", "ﬁ", "Ǆ", "…", "ẛ̣"]
_PLAIN = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in _ODD]


def _one_of(values):
    return "CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("compatibility_characters_folded", f"SELECT c_custkey, c_name || {_one_of(_PLAIN)} AS folded FROM {{customer}}")
def _(t):
    return t("customer").select("c_custkey", text.fold_accents(F.expr(f"c_name || {_one_of(_ODD)}")).alias("folded"))


@query(
    "slugs",
    f"SELECT doc_id, {q.slug('text')} AS folded, {q.slug('text', False)} AS plain FROM {{documents}}",
)
def _(t):
    return t("documents").select(
        "doc_id", text.slug("text").alias("folded"), text.slug("text", fold=False).alias("plain")
    )


@query("match_keys", _digest_sql(q.match_key))
def _(t):
    return t("documents").select(*_digest("doc_id", text.match_key("text")))


@query("query_keys", _digest_sql(q.query_key))
def _(t):
    return t("documents").select(*_digest("doc_id", text.query_key("text")))


@query(
    "place_name_keys",
    f"""SELECT seq, uf, {q.match_key('municipality_name_clean')} AS match_key,
       {q.query_key('municipality_name_clean')} AS query_key FROM {{dirty_places}}""",
)
def _(t):
    return t("dirty_places").select(
        "seq", "uf", text.match_key("municipality_name_clean").alias("match_key"),
        text.query_key("municipality_name_clean").alias("query_key"),
    )


_TAILS = """SELECT c_custkey, c_name || CASE c_nationkey % 5 WHEN 0 THEN ' ,;' WHEN 1 THEN ' - . ' WHEN 2 THEN ':'
            WHEN 3 THEN '  x  ' ELSE '' END AS v FROM {customer}"""


@query(
    "name_tails_trimmed",
    f"SELECT c_custkey, regexp_replace({q.collapse('v')}, '[\\s,;:\\-.]+$', '') AS name FROM ({_TAILS})",
)
def _(t):
    src = t("customer").select(
        "c_custkey",
        F.expr("""c_name || CASE c_nationkey % 5 WHEN 0 THEN ' ,;' WHEN 1 THEN ' - . ' WHEN 2 THEN ':'
                  WHEN 3 THEN '  x  ' ELSE '' END""").alias("v"),
    )
    return src.select("c_custkey", text.trim_name_tail("v").alias("name"))


@query(
    "codes_padded",
    f"""SELECT o_orderkey, {q.pad('CAST(o_custkey AS VARCHAR)')} AS code,
       {q.pad("CAST(o_custkey + 99999000 AS VARCHAR)")} AS long_code FROM {{orders}}""",
)
def _(t):
    return t("orders").select(
        "o_orderkey", text.pad_code("o_custkey").alias("code"),
        text.pad_code(F.col("o_custkey") + 99999000).alias("long_code"),
    )


@query(
    "state_keys",
    """SELECT c_custkey, trim(upper(v)) AS full_key, substr(trim(upper(v)), 1, 2) AS uf
  FROM (SELECT c_custkey, ' ' || lower(substr(c_mktsegment, 1, 2)) || CASE WHEN c_nationkey % 3 = 0 THEN ';ba ' ELSE '' END AS v FROM {customer})""",
)
def _(t):
    v = F.expr("' ' || lower(substr(c_mktsegment, 1, 2)) || CASE WHEN c_nationkey % 3 = 0 THEN ';ba ' ELSE '' END")
    return t("customer").select("c_custkey", text.upper_key(v).alias("full_key"), text.uf_key(v).alias("uf"))


@query(
    "notes_joined",
    """SELECT o_orderkey, CASE WHEN a <> '' AND b <> '' THEN a || '; ' || b ELSE a || b END AS notes FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS a,
         CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN '' ELSE o_orderpriority END AS b FROM {orders})""",
)
def _(t):
    a = F.expr("CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END")
    b = F.expr("CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN NULL ELSE o_orderpriority END")
    return t("orders").select("o_orderkey", text.join_notes(a, b).alias("notes"))


_DATE_TEXT = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '31/02/2020' WHEN '2' THEN 'sem data'
  WHEN '3' THEN '2020-01-15' ELSE {fmt} END"""


@query(
    "dates_day_first",
    "SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day, year(d) AS year, strftime(d, '%Y-%m-%dT%H:%M:%S') AS iso FROM ("
    "SELECT o_orderkey, try_strptime(" + _DATE_TEXT.replace("{fmt}", "strftime(o_orderdate, '%d/%m/%Y')")
    + ", '%d/%m/%Y') AS d FROM {orders})",
)
def _(t):
    raw = F.expr(_DATE_TEXT.replace("{fmt}", "date_format(o_orderdate, 'dd/MM/yyyy')"))
    return t("orders").select("o_orderkey", dates.day_first(raw).alias("d")).select(
        "o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("day"), dates.year_of("d").cast("long").alias("year"),
        dates.iso_text("d").alias("iso"),
    )


@query(
    "page_url_parts",
    f"""SELECT page_id, {q.origin('url')} AS origin, regexp_replace(url, '#.*$', '') AS clean,
       {q.origin('url')} || '/files/x.PDF' AS from_root, regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]+(\\.[^./]+)/*$', 1) AS ext,
       regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'b.doc' AS from_folder
  FROM {{pages}}""",
)
def _(t):
    return t("pages").select(
        "page_id", urls.origin("url").alias("origin"), urls.drop_fragment("url").alias("clean"),
        urls.resolve("url", F.lit("/files/x.PDF")).alias("from_root"), urls.extension("url").alias("ext"),
        urls.resolve("url", F.lit("b.doc")).alias("from_folder"),
    )


_FILE_URL = """'http://x.org/d.1/f' || CAST(event_id AS STRING) || CASE event_type WHEN 'click' THEN '.PDF?v=.csv'
  WHEN 'view' THEN '.htm' WHEN 'error' THEN '.exe' WHEN 'signup' THEN '/' ELSE '' END"""


@query(
    "resource_types",
    f"""SELECT event_id, e AS ext, CASE WHEN e IN ('.html', '.htm') THEN 'html' WHEN e = '.pdf' THEN 'pdf' ELSE 'unknown' END AS kind FROM (
  SELECT event_id, CASE WHEN event_type = 'click' THEN '.pdf' WHEN event_type = 'view' THEN '.htm'
         WHEN event_id % 4 = 0 THEN '.html' WHEN event_id % 4 = 1 THEN '.csv' ELSE '.bin' END AS e FROM {{events}})""",
)
def _(t):
    ctype = F.expr("CASE event_id % 4 WHEN 0 THEN 'text/HTML' WHEN 1 THEN 'text/csv' WHEN 2 THEN '' END")
    ext = filetypes.guess_extension(ctype, F.expr(_FILE_URL))
    return t("events").select("event_id", ext.alias("ext")).withColumn("kind", filetypes.resource_type("ext"))


@query(
    "portal_urls",
    """SELECT seq, host, i AS ordinal, CASE i WHEN 0 THEN 'https://' || host || '.cgu.gov.br/relatorios/download/' || id_da_tarefa
         WHEN 1 THEN 'https://' || host || '.cgu.gov.br/relatorios/download/' || id_da_auditoria
         WHEN 2 THEN 'https://' || host || '.cgu.gov.br/relatorio/' || id_da_tarefa
         ELSE 'https://' || host || '.cgu.gov.br/relatorios/relatorio/' || id_da_tarefa END AS url,
       CASE i WHEN 0 THEN 'download_idtarefa:' || id_da_tarefa WHEN 1 THEN 'download_idauditoria:' || id_da_auditoria
         WHEN 2 THEN 'landing_relatorio' ELSE 'landing_relatorios_relatorio' END AS strategy
  FROM {audits}, (VALUES ('eaud'), ('ecgu')) AS h(host), (VALUES (0), (1), (2), (3)) AS n(i)
  WHERE i <> 1 OR id_da_tarefa <> id_da_auditoria""",
)
def _(t):
    hosts = t("audits").withColumn("host", F.explode(F.array(F.lit("eaud"), F.lit("ecgu"))))
    tries = hosts.select(
        "seq", "host",
        F.posexplode(urls.download_urls("id_da_tarefa", "id_da_auditoria", F.col("host"))).alias("ordinal", "u"),
    )
    pages = hosts.select("seq", "host", F.posexplode(urls.landing_urls("id_da_tarefa", F.col("host"))).alias("p", "u"))
    both = tries.unionByName(pages.select("seq", "host", (F.col("p") + 2).alias("ordinal"), "u"))
    return both.select("seq", "host", "ordinal", "u.strategy", "u.url")


@query(
    "short_ids",
    """SELECT seq, 'cand_' || substr(sha256('https://x/' || id_da_tarefa || '|' || coalesce(fef, 'None') || '|' || municipality_name_raw || '|eaud_api'), 1, 16) AS candidate_id,
       'round_' || substr(sha256(titulo_do_relatorio || '|https://x/' || id_da_tarefa), 1, 12) AS round_id FROM {audits}""",
)
def _(t):
    link = F.concat(F.lit("https://x/"), "id_da_tarefa")
    return t("audits").select(
        "seq", ids.candidate_id(link, "fef", "municipality_name_raw", F.lit("eaud_api")).alias("candidate_id"),
        ids.round_id("titulo_do_relatorio", link).alias("round_id"),
    )


@query(
    "file_signatures",
    """SELECT seq, ext, ext <> 'bin' AS ok FROM (SELECT seq, CASE WHEN head LIKE '%PDF%' OR content_type = 'application/pdf' THEN 'pdf'
  WHEN head LIKE 'PK%' THEN 'docx' ELSE 'bin' END AS ext FROM {attempts})""",
)
def _(t):
    body = F.encode("head", "UTF-8")
    return t("attempts").select(
        "seq", filetypes.signature(body, "content_type").alias("ext"),
        filetypes.signature_ok(body, "content_type").alias("ok"),
    )


@query(
    "disposition_filenames",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'f ' || CAST(event_id AS VARCHAR) || '.pdf'
  WHEN 'view' THEN 'r' || CAST(event_id AS VARCHAR) END AS filename FROM {events}""",
)
def _(t):
    header = F.expr("""CASE event_type WHEN 'click' THEN 'attachment; filename="f ' || CAST(event_id AS STRING) || '.pdf"; size=3'
      WHEN 'view' THEN 'attachment; FileName*=UTF-8\\'\\'r' || CAST(event_id AS STRING) WHEN 'error' THEN 'inline' END""")
    return t("events").select("event_id", filetypes.disposition_filename(header).alias("filename"))


@query(
    "texts_clipped_and_filled",
    """SELECT seq, substr(coalesce(fef, '<NA>'), 1, 2) AS clipped, CASE WHEN length(fef) >= 3 THEN fef ELSE grupoatividade END AS kept FROM {audits}""",
)
def _(t):
    return t("audits").select(
        "seq", text.clip(text.text_or("fef", "<NA>"), 2).alias("clipped"),
        text.keep_if("fef", F.length("fef") >= 3, F.col("grupoatividade")).alias("kept"),
    )
