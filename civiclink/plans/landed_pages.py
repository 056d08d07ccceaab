"""Pages, search answers and landed JSON."""

from pyspark.sql import functions as F

from civiclink.functions import filetypes
from civiclink.functions.ids import round_id
from civiclink.operators import pages, profile, reports
from civiclink.operators.fetchlog import pdf_eligible
from civiclink.operators.gates import discovery_gate, lottery_gates
from civiclink.plans import sqltext as q
from civiclink.plans import views  # noqa: F401
from civiclink.plans.registry import query
from civiclink.sources import landed

_ANCHORS = f"""(SELECT page_id, url AS page_url, h AS href, tx AS text, i - 1 AS pos, {q.origin('url')} || h AS link FROM
  (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS tx,
    unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) + 1)) AS i FROM {{pages}}))"""


@query("page_anchors", f"SELECT page_id, pos, href, text, link FROM {_ANCHORS}")
def _(t):
    return pages.anchors(t("pages"), "page_id").drop("page_url")


@query(
    "hinted_round_links",
    f"""SELECT page_id, page_url AS source_page_url, link AS url, text AS round_label, 'round_' || substr(sha256(text || '|' || link), 1, 12) AS round_id
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS r FROM {_ANCHORS} WHERE regexp_matches(lower(text || ' ' || href), 'th|qu')) WHERE r = 1""",
)
def _(t):
    return pages.round_links(t("pages"), "page_id", hint="th|qu").drop("position")


# One page per ten parts: names in table rows, list items and paragraphs.
_PLACE = """CASE p_size % 5 WHEN 0 THEN 'SP' WHEN 1 THEN 'BA' WHEN 2 THEN 'CE' WHEN 3 THEN 'MG' ELSE 'ZZ' END"""
_METHOD = "CASE p_partkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'li' ELSE 'regex' END"


# The same with no legal state on every third page.
_SPARSE = f"CASE WHEN p_partkey % 30 < 10 THEN 'ZZ' ELSE {_PLACE} END"


def _place_pages(t, state=_PLACE):
    piece = F.expr(f"""CASE p_partkey % 3
      WHEN 0 THEN '<table><tr><th>n</th><TD class="x">' || p_name || '/' || {state} || '</td><td> ' || CAST(p_partkey AS STRING) || '</td></tr></table>'
      WHEN 1 THEN '<ul><li><b>' || p_name || '</b>&nbsp;/ ' || {state} || ' no. ' || CAST(p_partkey AS STRING) || '</li></ul>'
      ELSE '<p>(' || CAST(p_partkey AS STRING) || ') ' || p_name || ' - ' || {state} || '. <span>fim</span></p>' END""")
    extra = F.expr("""CASE WHEN p_partkey % 10 = 9 THEN '<a href="/f/' || CAST(p_partkey AS STRING) || CASE p_partkey % 4
      WHEN 1 THEN '.PDF#x' WHEN 3 THEN '.docx' ELSE '' END || '">a</a><!-- <li>x/SP</li> --><script>"<li>y/SP</li>"</script>' ELSE '' END""")
    parts = t("part").select(F.floor(F.col("p_partkey") / 10).alias("page_id"), "p_partkey", F.concat(piece, extra).alias("piece"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "piece"))), lambda x: x["piece"]), "")
    return parts.groupBy("page_id").agg(F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html")).withColumn(
        "url", F.concat(F.lit("https://x.org/r/"), F.col("page_id").cast("string"))
    )


_HITS = f"""(SELECT CAST(p_partkey // 10 AS BIGINT) AS page_id, p_partkey, p_name AS name, {_PLACE} AS uf, {_METHOD} AS parse_method,
  CASE p_partkey % 3 WHEN 0 THEN 'n | ' || p_name || '/' || {_PLACE} || ' | ' || CAST(p_partkey AS VARCHAR)
    WHEN 1 THEN p_name || ' / ' || {_PLACE} || ' no. ' || CAST(p_partkey AS VARCHAR)
    ELSE '(' || CAST(p_partkey AS VARCHAR) || ') ' || p_name || ' - ' || {_PLACE} || '. fim' END AS source_snippet FROM {{part}})"""


@query(
    "places_from_pages",
    f"""SELECT page_id, municipality_name_clean, uf, parse_method, CASE parse_method WHEN 'regex' THEN 'medium' ELSE 'high' END AS confidence, source_snippet FROM
  (SELECT page_id, name AS municipality_name_clean, uf, parse_method, source_snippet,
    row_number() OVER (PARTITION BY page_id, lower(name), uf, parse_method ORDER BY p_partkey DESC) AS r FROM {_HITS} WHERE uf <> 'ZZ') WHERE r = 1""",
)
def _(t):
    src = _place_pages(t)
    out = pages.page_places(src, "page_id")
    return out.select("page_id", "municipality_name_clean", "uf", "parse_method", "confidence", "source_snippet")


@query(
    "round_places",
    f"SELECT DISTINCT page_id, name AS municipality_name_clean, uf FROM {_HITS} WHERE uf <> 'ZZ'",
)
def _(t):
    src = _place_pages(t)
    out = pages.round_places(pages.page_places(src, "page_id"), "page_id")
    return out.select("page_id", "municipality_name_clean", "uf")


_RES = """(SELECT CAST(p_partkey // 10 AS BIGINT) AS page_id, CASE p_partkey % 4 WHEN 1 THEN '.pdf' ELSE '.docx' END AS ext,
  'https://x.org/f/' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 4 WHEN 1 THEN '.PDF' ELSE '.docx' END AS link
  FROM {part} WHERE p_partkey % 10 = 9 AND p_partkey % 2 = 1)"""


@query("resource_links", f"SELECT page_id, link, ext FROM {_RES}")
def _(t):
    return pages.resource_links(_place_pages(t), "page_id").drop("pos")


def _status(t, keep=()):
    return pages.page_status(_place_pages(t, _SPARSE), "page_id", keep=list(keep))


_STATUS = f"""(SELECT g.page_id, CASE WHEN n > 0 THEN 'parsed' WHEN ext IS NOT NULL THEN 'needs_pdf_parse' ELSE 'no_municipalities_extracted' END AS parse_status,
  CASE WHEN n > 0 THEN '' WHEN ext IS NOT NULL THEN 'round_links_to_external_resource_no_html_list' ELSE 'html_parsed_but_no_confident_matches' END AS parse_reason,
  CASE WHEN n > 0 OR ext IS NULL THEN 'html' WHEN ext = '.pdf' THEN 'pdf' ELSE 'unknown' END AS primary_resource_type, n AS parsed_municipalities_count
  FROM (SELECT CAST(p_partkey // 10 AS BIGINT) AS page_id, count(DISTINCT CASE WHEN p_partkey % 30 >= 10 AND {_PLACE} <> 'ZZ' THEN p_name || {_PLACE} || {_METHOD} END) AS n FROM {{part}} GROUP BY 1) g
  LEFT JOIN {_RES} r ON g.page_id = r.page_id)"""


@query("page_parse_status", f"SELECT * FROM {_STATUS}")
def _(t):
    return _status(t)


_ROUNDS = f"""(SELECT 'round_' || substr(sha256('Sorteio ' || CAST(page_id AS VARCHAR) || '|https://x.org/r/' || CAST(page_id AS VARCHAR)), 1, 12) AS round_id,
  'Sorteio ' || CAST(page_id AS VARCHAR) AS round_label, 'https://x.org/r/' || CAST(page_id AS VARCHAR) AS url, page_id % 7 <> 0 AS download_ok, parse_status,
  parsed_municipalities_count AS municipality_count, primary_resource_type, '' AS error_message FROM {_STATUS})"""
_METRICS = f"""(SELECT *, round_download_failures / greatest(rounds_discovered, 1) AS fail_ratio FROM (SELECT count(*) AS rounds_discovered,
  count(*) FILTER (WHERE parse_status = 'parsed') AS rounds_parsed_successfully, CAST(sum(municipality_count) AS BIGINT) AS municipalities_extracted,
  count(*) FILTER (WHERE NOT download_ok) AS round_download_failures FROM {_ROUNDS}))"""


def _rounds(t):
    label = F.concat(F.lit("Sorteio "), F.col("page_id").cast("string"))
    return _status(t, ["url"]).select(
        round_id(label, "url").alias("round_id"), label.alias("round_label"), F.col("url").alias("round_url"),
        (F.col("page_id") % 7 != 0).alias("download_ok"), "parse_status", "parsed_municipalities_count",
        "primary_resource_type", F.lit(None).cast("string").alias("error_message"),
    )


@query("round_metrics", f"SELECT * FROM {_METRICS}")
def _(t):
    return profile.round_metrics(_rounds(t))


@query("round_summary", f"SELECT * FROM {_ROUNDS}")
def _(t):
    return profile.round_summary(_rounds(t))


@query(
    "lottery_gates",
    f"""WITH m AS {_METRICS} SELECT 'rounds_non_empty' AS gate, CAST(rounds_discovered AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS bound, rounds_discovered > 0 AS ok FROM m
  UNION ALL SELECT 'download_fail_ratio', fail_ratio, 0.5, fail_ratio <= 0.5 FROM m
  UNION ALL SELECT 'municipalities_low_warning', municipalities_extracted, 10, municipalities_extracted >= 10 FROM m
  UNION ALL SELECT 'success', CAST(rounds_discovered > 0 AND fail_ratio <= 0.5 AS INT), 1, rounds_discovered > 0 AND fail_ratio <= 0.5 FROM m""",
)
def _(t):
    return lottery_gates(profile.round_metrics(_rounds(t)))


@query(
    "non_html_status",
    """SELECT event_id, CASE WHEN e IN ('.html', '.htm') THEN NULL ELSE 'non_html_resource:' || e END AS parse_reason,
  CASE WHEN e IN ('.html', '.htm') THEN NULL WHEN e = '.pdf' THEN 'pdf' ELSE 'unknown' END AS primary_resource_type FROM
  (SELECT event_id, CASE event_type WHEN 'click' THEN '.pdf' WHEN 'view' THEN '.htm' WHEN 'error' THEN '.xlsx' ELSE '.bin' END AS e FROM {events})""",
)
def _(t):
    url = F.expr("""'http://x.org/f' || CAST(event_id AS STRING) || CASE event_type WHEN 'click' THEN '.pdf' WHEN 'view' THEN '.htm'
      WHEN 'error' THEN '.xlsx' ELSE '' END""")
    status = pages.resource_status(filetypes.guess_extension(F.lit(None).cast("string"), url))
    return t("events").select("event_id", status.alias("s")).select("event_id", "s.parse_reason", "s.primary_resource_type")


# One detail page per order with PDF links in five places.
def _detail(t):
    html = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN '<a href="/f/' || k || '.PDF">x</a><a href="/f/' || k || '.PDF">again</a>'
      WHEN 1 THEN replace('<a class="b" href=~/api/download/' || k || '?a=1&amp;b=2~>x</a>', '~', chr(39))
      WHEN 2 THEN '<script>var u = "/api/arquivo/' || k || '"; var v="/api/busca";</script>'
      WHEN 3 THEN replace('<p>https://y.org/d/' || k || '.pdf</p> ~/api/pdf/' || k || '~', '~', chr(39))
      ELSE '<p>nada</p><a href="/x">x</a>' END""")
    o = t("orders").withColumn("k", F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", html.alias("html"), F.concat(F.lit("https://z.org/relatorio/"), "k").alias("url"))


_PDF = """SELECT o_orderkey, 0 AS phase, 'https://z.org/f/' || CAST(o_orderkey AS VARCHAR) || '.PDF' AS link FROM {orders} WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 0, 'https://z.org/api/download/' || CAST(o_orderkey AS VARCHAR) || '?a=1&b=2' FROM {orders} WHERE o_orderkey % 5 = 1
  UNION ALL SELECT o_orderkey, 3, 'https://z.org/api/download/' || CAST(o_orderkey AS VARCHAR) || '?a=1&amp;b=2' FROM {orders} WHERE o_orderkey % 5 = 1
  UNION ALL SELECT o_orderkey, 2, 'https://z.org/api/arquivo/' || CAST(o_orderkey AS VARCHAR) FROM {orders} WHERE o_orderkey % 5 = 2
  UNION ALL SELECT o_orderkey, 1, 'https://y.org/d/' || CAST(o_orderkey AS VARCHAR) || '.pdf' FROM {orders} WHERE o_orderkey % 5 = 3
  UNION ALL SELECT o_orderkey, 3, 'https://z.org/api/pdf/' || CAST(o_orderkey AS VARCHAR) FROM {orders} WHERE o_orderkey % 5 = 3"""


@query("pdf_links", _PDF)
def _(t):
    return pages.pdf_links(_detail(t), "o_orderkey").select("o_orderkey", "phase", "link")


@query("detail_pdf_links", f"SELECT o_orderkey, link FROM ({_PDF}) WHERE phase = 0")
def _(t):
    return pages.detail_pdf_links(_detail(t), "o_orderkey").select("o_orderkey", "link")


@query(
    "script_api_paths",
    """SELECT o_orderkey, '/api/arquivo/' || CAST(o_orderkey AS VARCHAR) AS path FROM {orders} WHERE o_orderkey % 5 = 2
  UNION ALL SELECT o_orderkey, '/api/busca' FROM {orders} WHERE o_orderkey % 5 = 2
  UNION ALL SELECT o_orderkey, '/api/pdf/' || CAST(o_orderkey AS VARCHAR) FROM {orders} WHERE o_orderkey % 5 = 3
  UNION ALL SELECT o_orderkey, '/api/download/' || CAST(o_orderkey AS VARCHAR) || '?a=1&amp;b=2' FROM {orders} WHERE o_orderkey % 5 = 1""",
)
def _(t):
    return pages.script_paths(_detail(t), "o_orderkey").drop("pos")


# Search answers: one per document, items nested in three shapes.
def _answers(t):
    item = F.expr("""'{"id":' || CASE WHEN doc_id % 9 = 0 THEN '0' ELSE CAST(doc_id AS STRING) END || ',"titulo":"Relatorio ' || source || ' ' || lang
      || '","pdfUrl":' || CASE WHEN doc_id % 2 = 0 THEN '"/files/' || CAST(doc_id AS STRING) || '.pdf"' ELSE 'null' END || ',"data":"01/02/2020"}'""")
    payload = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), item, F.lit(",[{\"nome\":\"sem id\"}],7]")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"data":{"items":['), item, F.lit(']}}')))
        .otherwise(item)
    )
    return t("documents").select(
        "doc_id", payload.alias("payload"), F.initcap("source").alias("municipality_name"), F.upper("lang").alias("uf"),
        F.lpad(F.col("doc_id").cast("string"), 7, "0").alias("ibge_municipality_code"), F.col("source").alias("query_terms_used"),
    )


_ITEMS = """(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS rid, 'Relatorio ' || source || ' ' || lang AS title, source, lang,
    CASE WHEN doc_id % 2 = 0 THEN 'https://z.org/files/' || CAST(doc_id AS VARCHAR) || '.pdf' END AS pdf, '01/02/2020' AS d FROM {documents}
  UNION ALL SELECT doc_id, '', 'sem id', source, lang, NULL, NULL FROM {documents} WHERE doc_id % 3 = 0)"""
_CAND = f"""(SELECT doc_id, CASE WHEN rid = '' THEN 'https://z.org' ELSE 'https://z.org/relatorio/' || rid END AS landing_url, pdf AS pdf_url, title AS title_text,
  d AS date_text, CASE WHEN title = 'sem id' THEN 'medium' ELSE 'high' END AS confidence, upper(source) AS normalized_muni_name, upper(source[1]) || substr(source, 2) AS name FROM {_ITEMS})"""


@query("search_items", "SELECT doc_id, count(*) AS items FROM " + _ITEMS + " GROUP BY 1")
def _(t):
    return reports.search_items(_answers(t)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))


# An answer that is an item itself, holds another one, and a third 60 levels down.
@query(
    "nested_item_order",
    """SELECT doc_id, i AS item_order, CASE i WHEN 0 THEN 'inner ' || source WHEN 1 THEN 'deep ' || lang ELSE 'outer' END AS title FROM {documents}, (VALUES (0), (1), (2)) AS n(i)""",
)
def _(t):
    payload = F.expr("""'{"id":1,"titulo":"outer","data":' || repeat('{"data":', 60) || '{"id":1,"titulo":"deep ' || lang || '"}' || repeat('}', 60)
      || ',"items":[{"id":1,"titulo":"inner ' || source || '"}]}'""")
    items = reports.search_items(t("documents").select("doc_id", payload.alias("payload")))
    return items.select("doc_id", "item_order", F.try_variant_get("item", "$.titulo", "string").alias("title"))


def _candidates(t):
    return reports.candidates_from_items(reports.search_items(_answers(t)), "https://z.org", "eaud_api", "2026-01-01T00:00:00Z")


@query(
    "search_candidates",
    f"""SELECT doc_id, landing_url, pdf_url, title_text, date_text, confidence, normalized_muni_name,
  'cand_' || substr(sha256(landing_url || '|' || coalesce(pdf_url, 'None') || '|' || name || '|eaud_api'), 1, 16) AS candidate_id FROM {_CAND}""",
)
def _(t):
    return _candidates(t).select(
        "doc_id", "landing_url", "pdf_url", "title_text", "date_text", "confidence", "normalized_muni_name", "candidate_id"
    )


@query(
    "candidates_with_detail_pdf",
    f"""SELECT doc_id, landing_url, title_text, CASE WHEN pdf_url IS NOT NULL OR landing_url = 'https://z.org' THEN pdf_url
    WHEN doc_id % 5 < 3 THEN 'https://z.org/d/' || CAST(doc_id AS VARCHAR) || '.pdf' ELSE 'https://z.org/api/arquivo/' || CAST(doc_id AS VARCHAR) END AS pdf_url,
  CASE WHEN pdf_url IS NOT NULL OR landing_url = 'https://z.org' THEN 'json_result' WHEN doc_id % 5 < 3 THEN 'json_result;pdf_from_detail' ELSE 'json_result;pdf_api_candidate' END AS notes FROM {_CAND}""",
)
def _(t):
    html = F.expr("""CASE WHEN doc_id % 5 < 3 THEN '<a href="../d/' || CAST(doc_id AS STRING) || '.pdf">pdf</a>' ELSE '<script>x="/api/arquivo/' || CAST(doc_id AS STRING) || '"</script>' END""")
    details = t("documents").select(F.concat(F.lit("https://z.org/relatorio/"), F.col("doc_id").cast("string")).alias("landing_url"), html.alias("html"))
    return reports.fill_missing_pdf(_candidates(t), details, "https://z.org").select("doc_id", "landing_url", "title_text", "pdf_url", "notes")


@query(
    "report_index",
    f"""SELECT report_candidate_id, max(doc_id) AS doc_id FROM (SELECT doc_id, 'cand_' || substr(sha256(landing_url || '|' || coalesce(pdf_url, 'None') || '|' || name || '|eaud_api'), 1, 16)
  AS report_candidate_id FROM {_CAND}) GROUP BY 1""",
)
def _(t):
    last = reports.unique_candidates(_candidates(t), ["doc_id", "item_order"])
    return reports.report_index(last).select("report_candidate_id", "doc_id")


@query(
    "pdf_probe_eligible",
    f"SELECT doc_id, landing_url FROM {_CAND} WHERE pdf_url IS NOT NULL AND confidence = 'high'",
)
def _(t):
    return _candidates(t).where(pdf_eligible()).select("doc_id", "landing_url")


_FAIL = "(SELECT 'eaud_api' AS strategy, CASE event_type WHEN 'error' THEN 'empty_json_results' ELSE 'detail_follow_failed' END AS reason FROM {events} WHERE event_type IN ('error', 'signup'))"


def _failures(t):
    reason = F.when(F.col("event_type") == "error", "empty_json_results").otherwise("detail_follow_failed")
    return t("events").where(F.col("event_type").isin("error", "signup")).select(F.lit("eaud_api").alias("strategy"), reason.alias("reason"))


@query(
    "strategy_breakdown",
    f"SELECT 'eaud_api' AS strategy, count(*) AS candidates_found, count(pdf_url) AS candidates_with_pdf, (SELECT count(*) FROM {_FAIL}) AS errors FROM {_CAND}",
)
def _(t):
    return profile.strategy_breakdown(_candidates(t), _failures(t))


@query("failure_reasons", f"SELECT reason, count(*) AS count FROM {_FAIL} GROUP BY 1")
def _(t):
    return profile.failure_reasons(_failures(t))


@query(
    "discovery_gates",
    f"""WITH c AS (SELECT count(*) AS n, count(pdf_url) AS p FROM {_CAND}) SELECT 'candidates' AS gate, CAST(n AS DOUBLE) AS value, CAST(5 AS DOUBLE) AS bound, n >= 5 AS ok FROM c
  UNION ALL SELECT 'candidates_with_pdf', p, 1, p >= 1 FROM c UNION ALL SELECT 'success', CAST(n >= 5 OR p >= 1 AS INT), 1, n >= 5 OR p >= 1 FROM c""",
)
def _(t):
    return discovery_gate(_candidates(t))


@query(
    "search_phrases",
    """SELECT uf, municipality_name_clean, i AS query_order, CASE i WHEN 0 THEN municipality_name_clean || '/' || uf WHEN 1 THEN municipality_name_clean || ' ' || uf
  ELSE municipality_name_clean END AS query_terms_used FROM (SELECT DISTINCT uf, municipality_name_clean FROM {dirty_places}), (VALUES (0), (1), (2)) AS n(i)""",
)
def _(t):
    places = t("dirty_places").select("uf", "municipality_name_clean").distinct()
    return reports.search_phrases(places, "municipality_name_clean")


@query(
    "legacy_page_candidates",
    f"""SELECT page_id, pos, link AS landing_url, text AS title_text FROM {_ANCHORS} WHERE contains({q.query_key("text || ' ' || link")}, 'QUE') OR contains({q.query_key("text || ' ' || link")}, 'TH')""",
)
def _(t):
    src = t("pages").withColumns({"municipality_name": F.lit("Quê"), "uf": F.lit("th"), "ibge_municipality_code": F.lit("1"), "query_terms_used": F.lit("q")})
    return reports.candidates_from_pages(src, "page_id", "auditoria", "2026-01-01T00:00:00Z").select("page_id", "pos", "landing_url", "title_text")


# Place records as JSON arrays, one array per brand.
_RECORD = """'{"id":' || CASE WHEN p_partkey % 23 = 0 THEN 'null' ELSE CAST(p_partkey % 900 AS STRING) END || ',"nome":"' || p_name || '",' || CASE p_partkey % 6
  WHEN 0 THEN '"microrregiao":{"mesorregiao":{"UF":{"sigla":" sp "}}}' WHEN 1 THEN '"microrregiao":null,"regiao-imediata":{"regiao-intermediaria":{"UF":{"sigla":"ba"}}}'
  WHEN 2 THEN '"UF":{"sigla":"CEX"},"siglaUF":"ce"' WHEN 3 THEN '"uf":{"sigla":12},"UF":7' WHEN 4 THEN '"microrregiao":{"mesorregiao":null}' ELSE '"uf":{"sigla":"MG"}' END || '}'"""


def _payloads(t):
    record = F.struct("p_partkey", F.expr(_RECORD).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]), ",")
    # Arrays of about a hundred records, in part order.
    return t("part").groupBy(F.floor(F.col("p_partkey") / 100).alias("seq")).agg(F.concat(F.lit("["), body, F.lit("]")).alias("payload"))


_RECORDS = """(SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE lpad(CAST(p_partkey % 900 AS VARCHAR), 7, '0') END AS code, p_name,
  CASE p_partkey % 6 WHEN 0 THEN 'SP' WHEN 1 THEN 'BA' WHEN 2 THEN 'CE' WHEN 5 THEN 'MG' END AS uf FROM {part})"""
_REF = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS r FROM {_RECORDS} WHERE uf IS NOT NULL AND code IS NOT NULL) WHERE r = 1)"


@query(
    "place_reference_from_json",
    f"SELECT code AS ibge_municipality_code, p_name AS municipality_name_official, uf, upper(p_name) AS municipality_name_norm FROM {_REF}",
)
def _(t):
    ref = landed.place_reference(landed.place_items(_payloads(t)), "x", "y")
    return ref.select("ibge_municipality_code", "municipality_name_official", "uf", "municipality_name_norm")


@query(
    "place_reference_stats",
    f"""SELECT count(*) AS total_records, count(*) FILTER (WHERE uf IS NULL) AS skipped_missing_uf, count(*) FILTER (WHERE uf IS NOT NULL AND code IS NULL) AS rejected_id,
  (SELECT count(*) FROM {_REF}) AS parsed_ok FROM {_RECORDS}""",
)
def _(t):
    items = landed.place_items(_payloads(t))
    return landed.reference_stats(items, landed.place_reference(items, "x", "y"))


def _court_pages(t):
    hit = F.expr("""'{"_id":"' || CAST(o_orderkey AS STRING) || '","_source":{"numeroProcesso":"' || CAST(o_orderkey AS STRING) || '-12.2020.8","tribunal":"TJ' || o_orderstatus
      || '","grau":"G1","dataAjuizamento":"' || date_format(o_orderdate, "yyyy-MM-dd") || 'T00:00:00","classe":{"codigo":7,"nome":"' || o_orderpriority || '"},"assuntos":[{"nome":"a"},{"nome":"b"}],"movimentos":['
      || array_join(transform(sequence(1, CAST(o_custkey % 3 + 1 AS INT)), i -> '{"codigo":' || CAST(i AS STRING) || ',"nome":"m","dataHora":"2020-01-0' || CAST(i AS STRING) || 'T10:00:00"}'), ',') || ']}}'""")
    grouped = t("orders").groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(hit)), ",").alias("b"))
    return grouped.select("page", F.concat(F.lit('{"hits":{"total":1,"hits":['), "b", F.lit("]}}")).alias("payload"))


@query(
    "court_processes",
    """SELECT CAST(o_orderkey // 50 AS BIGINT) AS page, CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_orderkey AS VARCHAR) || '1220208' AS case_number, 'TJ' || o_orderstatus AS court,
  'G1' AS court_level, strftime(o_orderdate, '%Y-%m-%d') AS filed, o_orderpriority AS case_class, 'a,b' AS subjects FROM {orders}""",
)
def _(t):
    out = landed.court_processes(_court_pages(t), ["page"])
    return out.select(
        "page", "record_id", "case_number", "court", "court_level", F.date_format("filed_at", "yyyy-MM-dd").alias("filed"),
        "case_class", F.array_join("subjects", ",").alias("subjects"),
    )


@query(
    "court_movements",
    """SELECT CAST(o_orderkey AS VARCHAR) || '1220208' AS case_number, i - 1 AS movement_order, CAST(i AS VARCHAR) AS movement_code, '2020-01-0' || CAST(i AS VARCHAR) AS day
  FROM {orders}, (VALUES (1), (2), (3)) AS n(i) WHERE i <= o_custkey % 3 + 1""",
)
def _(t):
    moves = landed.court_movements(landed.court_processes(_court_pages(t), ["page"]), ["page"])
    return moves.select("case_number", "movement_order", "movement_code", F.date_format("moved_at", "yyyy-MM-dd").alias("day"))


@query(
    "decision_catalogue",
    """SELECT 'pk' || CAST(s_nationkey AS VARCHAR) AS package_id, 'r' || CAST(s_suppkey AS VARCHAR) AS resource_id, s_name AS resource_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'csv' ELSE 'json' END AS format, CASE WHEN s_suppkey % 3 = 0 THEN '2021-01-01' ELSE '2020-01-01' END AS day FROM {supplier}""",
)
def _(t):
    one = F.expr("""'{"id":"r' || CAST(s_suppkey AS STRING) || '","name":"' || s_name || '","format":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'CSV' ELSE 'JSON' END
      || '","created":"2020-01-01"' || CASE WHEN s_suppkey % 3 = 0 THEN ',"last_modified":"2021-01-01"' ELSE '' END || '}'""")
    # Packages hold their resources by design, so a package is one JSON document.
    packs = t("supplier").groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 1000)).agg(F.array_join(F.collect_list(one), ",").alias("r"))
    payload = F.concat(F.lit('{"result":{"id":"pk'), F.col("s_nationkey").cast("string"), F.lit('","resources":['), "r", F.lit("]}}"))
    out = landed.decision_catalogue(packs.select("s_nationkey", payload.alias("payload")), ["s_nationkey"])
    return out.select("package_id", "resource_id", "resource_name", "format", F.date_format("published_at", "yyyy-MM-dd").alias("day"))
