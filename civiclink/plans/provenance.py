"""Manifests, fetch log, gates and record contracts."""

from pyspark.sql import functions as F

from civiclink.functions import filetypes
from civiclink.operators import contracts, fetchlog, gates, link, manifest, profile, rows
from civiclink.plans import views  # noqa: F401
from civiclink.plans.registry import query, view

view(
    "manifest_new",
    """SELECT event_id AS seq, CAST(user_id AS STRING) AS local_path, event_type AS item_type,
       md5(CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS sha256, CAST(floor(value * 100) AS BIGINT) AS size_bytes, 'v2' AS parser_version
  FROM {events} WHERE event_type IN ('click', 'view', 'error')""",
)
_STACKED = """(SELECT seq, local_path, item_type, sha256, size_bytes, NULL AS parser_version, 0 AS source_order FROM {manifest_old}
  UNION ALL SELECT seq, local_path, item_type, sha256, size_bytes, parser_version, 1 FROM {manifest_new})"""


@query("manifest_union", f"SELECT * FROM {_STACKED}")
def _(t):
    return manifest.stack(t("manifest_old"), t("manifest_new"))


@query(
    "manifest_upsert",
    f"""SELECT seq, local_path, item_type, sha256, size_bytes, parser_version FROM (SELECT *, row_number() OVER
  (PARTITION BY local_path, item_type ORDER BY source_order DESC, seq DESC) AS r FROM {_STACKED}) WHERE r = 1""",
)
def _(t):
    return manifest.upsert(t("manifest_old"), t("manifest_new"), ["local_path", "item_type"])


@query(
    "manifest_outcomes",
    """WITH c AS (SELECT 'old' AS module_name, sha256, CASE WHEN size_bytes < 1000 THEN 'failed' ELSE 'ok' END AS status FROM {manifest_old}
  UNION ALL SELECT 'new', sha256, CASE WHEN size_bytes < 1000 THEN 'failed' ELSE 'ok' END FROM {manifest_new})
  SELECT module_name, count(*) FILTER (WHERE status <> 'failed') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures,
  count(*) - count(DISTINCT sha256) AS duplicates FROM c GROUP BY 1""",
)
def _(t):
    status = F.when(F.col("size_bytes") < 1000, "failed").otherwise("ok")
    both = manifest.consolidate({"old": t("manifest_old"), "new": t("manifest_new")}).withColumn("status", status)
    return manifest.outcome_summary(both)


@query(
    "landed_file_changes",
    """WITH b AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS p, o_orderstatus AS s FROM {orders} WHERE o_orderstatus <> 'O'),
  a AS (SELECT CAST(o_orderkey AS VARCHAR) AS p, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS s FROM {orders} WHERE o_orderstatus <> 'P')
  SELECT coalesce(b.p, a.p) AS local_path, md5(b.s) AS old_sha256, md5(a.s) AS new_sha256,
  CASE WHEN b.s IS NULL THEN 'new' WHEN a.s IS NULL THEN 'missing' WHEN a.s = b.s THEN 'unchanged' ELSE 'changed' END AS state,
  b.s IS NULL OR (a.s IS NOT NULL AND a.s <> b.s) AS write_version FROM b FULL JOIN a ON b.p = a.p""",
)
def _(t):
    o = t("orders").withColumn("local_path", F.col("o_orderkey").cast("string"))
    before = o.where("o_orderstatus <> 'O'").select("local_path", F.md5("o_orderstatus").alias("sha256"))
    edited = F.expr("CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END")
    after = o.where("o_orderstatus <> 'P'").select("local_path", F.md5(edited).alias("sha256"))
    return manifest.changes(before, after)


@query(
    "rows_kept_first",
    "SELECT seq, local_path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY seq) AS r FROM {manifest_old}) WHERE r = 1",
)
def _(t):
    return rows.keep_first(t("manifest_old"), "local_path", "seq").select("seq", "local_path", "size_bytes")


@query(
    "rows_kept_last",
    "SELECT seq, local_path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY seq DESC) AS r FROM {manifest_old}) WHERE r = 1",
)
def _(t):
    return rows.keep_last(t("manifest_old"), "local_path", "seq").select("seq", "local_path", "size_bytes")


@query("distinct_rows", "SELECT DISTINCT local_path, item_type FROM {manifest_old}")
def _(t):
    return t("manifest_old").select("local_path", "item_type").distinct()


@query("first_200_rows", "SELECT o_orderkey, o_orderpriority FROM {orders} ORDER BY o_orderkey LIMIT 200")
def _(t):
    return rows.head(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 200)


@query("rows_numbered", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS source_row_number FROM {orders}")
def _(t):
    return rows.number_rows(t("orders").select("o_orderkey"), "o_orderkey")


@query("scanned_rows_numbered", "SELECT event_id, event_id + 1 AS source_row_number FROM {events}")
def _(t):
    return rows.number_scanned_rows(t("events")).select("event_id", "source_row_number")


@query(
    "seeded_customer_sample",
    "SELECT c_custkey, c_name FROM {customer} ORDER BY sha256(CAST(c_custkey AS VARCHAR) || '|42'), c_custkey LIMIT 100",
)
def _(t):
    return rows.seeded_sample(t("customer").select("c_custkey", "c_name"), ["c_custkey"], 100, 42)


@query(
    "seeded_place_sample",
    """SELECT * FROM (SELECT DISTINCT uf, municipality_name_clean FROM {dirty_places}) ORDER BY
  sha256(uf || '|' || municipality_name_clean || '|7'), uf, municipality_name_clean LIMIT 50""",
)
def _(t):
    return rows.distinct_sample(t("dirty_places"), ["uf", "municipality_name_clean"], 50, 7)


_OK = "(status_code = 200 AND bytes_len >= 10000 AND (head LIKE '%PDF%' OR head LIKE 'PK%' OR coalesce(content_type, '') LIKE '%pdf%'))"


def _attempts(t):
    body = F.encode("head", "UTF-8")
    return (
        t("attempts")
        .withColumn("ext", filetypes.signature(body, "content_type"))
        .withColumn("ok", fetchlog.good_download(F.col("ext") != "bin"))
        .drop("head")
    )


@query(
    "attempt_rules",
    f"""SELECT seq, {_OK} AS ok, status_code >= 500 OR status_code = -1 AS retryable, status_code IN (408, 425, 429, 500, 502, 503, 504) AS transient,
  host IN ('ecgu') AS host_allowed FROM {{attempts}}""",
)
def _(t):
    return _attempts(t).select(
        "seq", "ok", fetchlog.retryable().alias("retryable"), fetchlog.transient().alias("transient"),
        fetchlog.host_allowed("host", "ECGU, other").alias("host_allowed"),
    )


_INDEX = f"""(SELECT * FROM (SELECT seq, idtarefa, host, row_number() OVER (PARTITION BY idtarefa, host ORDER BY seq) AS r FROM {{attempts}} WHERE {_OK}) WHERE r = 1)"""


@query("downloads_index", f"SELECT seq, idtarefa, host FROM {_INDEX}")
def _(t):
    return fetchlog.downloads_index(_attempts(t)).select("seq", "idtarefa", "host")


@query(
    "downloads_index_two_per_host",
    f"""SELECT max(seq) AS seq, idtarefa, host FROM (SELECT *, row_number() OVER (PARTITION BY idtarefa, host ORDER BY seq) AS r FROM {{attempts}} WHERE {_OK})
  WHERE r <= 2 GROUP BY 2, 3""",
)
def _(t):
    return fetchlog.downloads_index(_attempts(t), 2).select("seq", "idtarefa", "host")


@query("task_ids", "SELECT DISTINCT idtarefa FROM {attempts}")
def _(t):
    return fetchlog.task_ids(t("attempts"))


@query(
    "probe_table",
    """SELECT id_da_tarefa AS idtarefa, id_da_auditoria AS idauditoria, strftime(publication_date, '%Y-%m-%d') AS day, uf, municipality_name_raw, ibge_municipality_code FROM {audits}""",
)
def _(t):
    src = t("audits").drop("data_de_publicacao")
    renamed = src.withColumnsRenamed({"id_da_tarefa": "Id da Tarefa", "publication_date": "Data Publicacao", "uf": "UFs"})
    out = fetchlog.probe_table(renamed, "seq")
    return out.withColumn("day", F.date_format("publication_date", "yyyy-MM-dd")).drop("publication_date")


@query("status_histogram", "SELECT CAST(status_code AS VARCHAR) AS value, count(*) AS count FROM {attempts} GROUP BY 1")
def _(t):
    return profile.histogram(t("attempts"), "status_code")


@query(
    "content_type_histogram",
    "SELECT coalesce(content_type, '') AS value, count(*) AS count FROM {attempts} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
)
def _(t):
    return profile.histogram(t("attempts"), "content_type", "", 30)


@query("fetch_medians", "SELECT median(bytes_len) AS median_bytes_len, median(elapsed_ms) AS median_elapsed_ms FROM {attempts}")
def _(t):
    return fetchlog.medians(t("attempts"))


_SUMMARY = f"""(SELECT *, download_success_count / greatest(unique_idtarefa, 1) AS download_success_rate FROM
  (SELECT count(DISTINCT idtarefa) AS unique_idtarefa, (SELECT count(*) FROM {_INDEX}) AS download_success_count FROM {{attempts}}))"""


def _summary(t):
    a = _attempts(t)
    return fetchlog.download_summary(fetchlog.task_ids(a), fetchlog.downloads_index(a))


@query("download_summary", f"SELECT * FROM {_SUMMARY}")
def _(t):
    return _summary(t)


@query("failed_urls", f"SELECT seq, url, status_code FROM {{attempts}} WHERE NOT {_OK} ORDER BY seq LIMIT 10")
def _(t):
    return fetchlog.failed_urls(_attempts(t))


@query("sampled_urls", "SELECT seq, url FROM {attempts} WHERE url IS NOT NULL ORDER BY seq LIMIT 20")
def _(t):
    return fetchlog.sample_urls(t("attempts"), "url")


@query(
    "detail_page_outcomes",
    """SELECT CASE WHEN status_code <> 200 THEN 'fetch_error_status_' || CAST(status_code AS VARCHAR) WHEN content_type = 'application/pdf' THEN 'downloaded'
  ELSE 'no_pdf_link_found' END AS outcome, count(*) AS count FROM {attempts} GROUP BY 1""",
)
def _(t):
    pdf = F.when(F.col("content_type") == "application/pdf", F.col("url"))
    return profile.outcome_counts(t("attempts").select("status_code", pdf.alias("pdf_url")))


def _gate_sql(*parts):
    return " UNION ALL ".join(f"SELECT '{g}' AS gate, CAST({v} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS bound, {ok} AS ok FROM {src}" for g, v, b, ok, src in parts)


_N = "(SELECT count(*) AS n FROM {orders})"
_R = "(SELECT count(*) AS n FROM {ref_places})"


@query(
    "input_gates",
    _gate_sql(("csv_columns", 6, 5, "true", _N), ("csv_rows", "n", 1000, "n >= 1000", _N), ("reference_rows", "n", 5000, "n >= 5000", _R)),
)
def _(t):
    return gates.all_gates(gates.csv_gates(t("orders")), gates.reference_gate(t("ref_places")))


_COV = """(SELECT (SELECT count(*) FROM {audits}) AS rows_after, (SELECT count(*) FILTER (WHERE length(uf) >= 2) / count(*) FROM {audits}) AS cover,
  (SELECT count(*) FROM {lottery} l LEFT JOIN {audits} a ON l.ibge_municipality_code = a.ibge_municipality_code AND l.uf = a.uf) AS long_rows)"""


@query(
    "success_gates",
    _gate_sql(
        ("rows_after_filters", "rows_after", 1, "rows_after > 0", _COV), ("located_coverage", "cover", 0.98, "cover >= 0.98", _COV),
        ("linked_rows", "long_rows", 1, "long_rows > 0", _COV),
        ("success", "CAST(rows_after > 0 AND cover >= 0.98 AND long_rows > 0 AS INT)", 1, "rows_after > 0 AND cover >= 0.98 AND long_rows > 0", _COV),
    ),
)
def _(t):
    a = t("audits").withColumns({"municipality_name_norm": F.col("municipality_name_raw")})
    cover = profile.located_coverage(a).withColumn("rows_after_filters", a.agg(F.count(F.lit(1))).scalar())
    return gates.coverage_gates(cover.withColumn("long_rows", link.link_long(t("lottery"), a).agg(F.count(F.lit(1))).scalar()))


@query(
    "probe_gate",
    "SELECT 'download_success_rate' AS gate, download_success_rate AS value, CAST(0.5 AS DOUBLE) AS bound, "
    f"(unique_idtarefa >= 10 AND download_success_rate >= 0.5) OR (unique_idtarefa < 10 AND download_success_count >= 5) AS ok FROM {_SUMMARY}",
)
def _(t):
    return gates.probe_gate(_summary(t))


# Contract records as JSON text: legal and illegal values over all labels.
view(
    "score_payloads",
    """SELECT doc_id, quality, '{"finding_id":"f' || CAST(doc_id AS STRING) || '","decision_id":' || CASE WHEN doc_id % 11 = 0 THEN 'null' ELSE '"d"' END
  || ',"score":' || CASE WHEN doc_id % 17 = 0 THEN '"high"' ELSE CAST(doc_id % 13 AS STRING) || 'e-1' END
  || ',"label":"' || CASE doc_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'probable' WHEN 2 THEN 'weak' WHEN 3 THEN 'none' ELSE 'maybe' END
  || '","rationale":"r","evidence":[{"source_doc_id":"s","quote":"' || CASE WHEN toxic = 1 THEN '' ELSE 'q' END || '"}]' || CASE WHEN doc_id % 19 = 0 THEN '' ELSE '}' END AS payload
  FROM {labels}""".replace("{\"", "{{\"").replace("'}'", "'}}'").replace("\"}]'", "\"}}]'"),
)
_CODES = """SELECT doc_id, 'record:not_json' AS reason_code FROM {labels} WHERE doc_id % 19 = 0
  UNION ALL SELECT doc_id, 'decision_id:missing' FROM {labels} WHERE doc_id % 19 <> 0 AND doc_id % 11 = 0
  UNION ALL SELECT doc_id, 'score:type' FROM {labels} WHERE doc_id % 19 <> 0 AND doc_id % 17 = 0
  UNION ALL SELECT doc_id, 'score:out_of_range' FROM {labels} WHERE doc_id % 19 <> 0 AND doc_id % 17 <> 0 AND doc_id % 13 > 10
  UNION ALL SELECT doc_id, 'label:not_allowed' FROM {labels} WHERE doc_id % 19 <> 0 AND doc_id % 5 = 4
  UNION ALL SELECT doc_id, 'evidence:invalid_span' FROM {labels} WHERE doc_id % 19 <> 0 AND toxic = 1"""


def _scores(t):
    return contracts.check(t("score_payloads"), "MatchScore")


@query(
    "match_scores_valid",
    f"""SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS finding_id, 'd' AS decision_id, CAST(doc_id % 13 AS DOUBLE) / 10 AS score,
  CASE doc_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'probable' WHEN 2 THEN 'weak' ELSE 'none' END AS label, 'r' AS rationale, 'q' AS quote
  FROM {{labels}} WHERE doc_id NOT IN (SELECT doc_id FROM ({_CODES}))""",
)
def _(t):
    good = contracts.valid_records(_scores(t), "MatchScore", ["doc_id"])
    return good.withColumn("quote", F.col("evidence")[0]["quote"]).drop("evidence")


@query("match_scores_quarantined", f"SELECT doc_id, reason_code, 'scores' AS module_name, 'v1' AS schema_version, 'm' AS model_id FROM ({_CODES})")
def _(t):
    return contracts.quarantine(_scores(t), "scores", "v1", "m", ["doc_id"]).drop("raw_payload")
