"""Audit table and its link to selected places."""

from pyspark.sql import functions as F

from civiclink.operators import audits, link, profile
from civiclink.operators.headers import rename_and_drop
from civiclink.operators.rows import number_rows
from civiclink.plans import sqltext as q
from civiclink.plans import views  # noqa: F401
from civiclink.plans.registry import query

_L = "SELECT seq AS lseq, ibge_municipality_code, uf, municipality_name_clean, round_id, round_label FROM {lottery}"
_LONG = f"""SELECT l.*, a.seq AS aseq, a.municipality_name_raw, a.id_da_tarefa, a.id_da_auditoria, a.titulo_do_relatorio,
  a.publication_date, a.grupoatividade, a.linhaacao, a.tiposervico, a.fef
  FROM ({_L}) l LEFT JOIN {{audits}} a ON l.ibge_municipality_code = a.ibge_municipality_code AND l.uf = a.uf"""


@query(
    "audits_linked_long",
    f"""SELECT lseq AS lottery_seq, aseq AS audit_seq, ibge_municipality_code, uf, round_id, municipality_name_clean AS municipality_name,
  municipality_name_raw, id_da_tarefa AS idtarefa, id_da_auditoria AS idauditoria, titulo_do_relatorio AS titulo,
  strftime(publication_date, '%Y-%m-%d') AS day, grupoatividade, linhaacao, tiposervico, fef, fef AS edicao_programa_sorteio_fef,
  'https://eaud.cgu.gov.br/relatorio/' || id_da_tarefa AS eaud_relatorio_url, 'https://eaud.cgu.gov.br/relatorios' AS eaud_relatorios_ui,
  'ibge_exact' AS link_rule_used FROM ({_LONG})""",
)
def _(t):
    table, _, _ = audits.with_edition(t("audits"))
    long = link.link_long(t("lottery"), table)
    return rename_and_drop(
        long.withColumn("day", F.date_format("publication_date", "yyyy-MM-dd")), {},
        ("publication_date", "round_label", "pdf_url", "pdf_sha256"),
    )


_LISTS = {
    "lottery_round_ids": "round_id", "lottery_round_labels": "round_label", "audit_task_id": "id_da_tarefa",
    "audit_title": "titulo_do_relatorio", "audit_audit_id": "id_da_auditoria", "grupoatividade": "grupoatividade",
    "linhaacao": "linhaacao", "tiposervico": "tiposervico", "fef": "fef", "edition_program_sorteio_fef": "fef",
}


def _list_sql(name, column):
    return (
        f"{name}_t AS (SELECT ibge_municipality_code, uf, string_agg(v, '|' ORDER BY l0, a0) AS {name} FROM "
        f"(SELECT ibge_municipality_code, uf, v, min(lseq) AS l0, arg_min(aseq, lseq * 100000000 + coalesce(aseq, 0)) AS a0 FROM "
        f"(SELECT *, trim(CAST({column} AS VARCHAR)) AS v FROM long_) WHERE v <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    )


@query(
    "audit_events_wide",
    "WITH long_ AS (" + _LONG + "), " + ", ".join(_list_sql(n, c) for n, c in _LISTS.items())
    + """, g AS (SELECT ibge_municipality_code, uf, arg_min(municipality_name_clean, lseq) AS municipality_name,
  arg_min(municipality_name_raw, aseq) AS municipality_name_raw, arg_min(round_label, lseq) AS first_lottery_round,
  coalesce(string_agg(strftime(publication_date, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY lseq, aseq), '') AS audit_publication_date FROM long_ GROUP BY 1, 2)
SELECT g.*, """ + ", ".join(f"coalesce({n}, '') AS {n}" for n in _LISTS) + " FROM g "
    + " ".join(f"LEFT JOIN {n}_t USING (ibge_municipality_code, uf)" for n in _LISTS),
)
def _(t):
    table, _, _ = audits.with_edition(t("audits"))
    wide = link.repeat_dates(link.link_wide(t("lottery"), table))
    lists = [*_LISTS, link.DATES]
    return wide.select(
        *link.KEYS, "municipality_name", "municipality_name_raw", "first_lottery_round",
        *[F.array_join(c, "|").alias(c) for c in lists],
    )


@query(
    "place_value_positions",
    "WITH long_ AS (" + _LONG + ") " + " UNION ALL ".join(
        f"SELECT ibge_municipality_code, uf, '{n}' AS field, trim(CAST({c} AS VARCHAR)) AS value, min({'lseq' if 'round' in c else 'aseq'}) AS seq "
        f"FROM long_ WHERE trim(CAST({c} AS VARCHAR)) <> '' GROUP BY 1, 2, 3, 4"
        for n, c in _LISTS.items()
    )
    + """ UNION ALL SELECT DISTINCT ibge_municipality_code, uf, 'audit_publication_date', strftime(publication_date, '%Y-%m-%dT%H:%M:%S'), aseq
  FROM long_ WHERE publication_date IS NOT NULL""",
)
def _(t):
    table, _, _ = audits.with_edition(t("audits"))
    return link.place_values(t("lottery"), table)


@query(
    "link_coverage",
    """SELECT count(*) AS num_lottery_municipalities, count(hit) AS num_lottery_municipalities_with_audit,
  count(hit) / greatest(count(*), 1) AS lottery_municipality_coverage_with_audits
  FROM (SELECT DISTINCT ibge_municipality_code, uf FROM {lottery}) LEFT JOIN
       (SELECT DISTINCT ibge_municipality_code, uf, 1 AS hit FROM {audits}) USING (ibge_municipality_code, uf)""",
)
def _(t):
    return link.link_coverage(t("lottery"), t("audits"))


@query("audits_per_year", "SELECT year(publication_date) AS year, count(*) AS count FROM {audits} GROUP BY 1")
def _(t):
    return link.audits_per_year(t("audits"))


@query(
    "reports_attached",
    f"""SELECT lseq AS lottery_seq, aseq AS audit_seq, id_da_tarefa AS idtarefa, CASE WHEN c > 1 THEN 'https://x/' || id_da_tarefa END AS pdf_url,
  CASE WHEN c > 1 THEN md5(id_da_tarefa) END AS pdf_sha256 FROM ({_LONG}) LEFT JOIN
  (SELECT l_orderkey, count(*) AS c FROM {{lineitem}} GROUP BY 1) ON l_orderkey = aseq""",
)
def _(t):
    found = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    task = F.col("l_orderkey").cast("string")
    reports = found.select(task.alias("idtarefa"), F.concat(F.lit("https://x/"), task).alias("url"), F.md5(task).alias("sha256"))
    long = link.attach_reports(link.link_long(t("lottery"), t("audits")), reports)
    return long.select("lottery_seq", "audit_seq", "idtarefa", "pdf_url", "pdf_sha256")


_RULE = "(lower(grupoatividade) LIKE '%entes federativos%' OR trim(coalesce(fef, '')) <> '')"


@query("programme_filter", f"SELECT seq, grupoatividade, fef FROM {{audits}} WHERE {_RULE}")
def _(t):
    return audits.programme_filter(t("audits").select("seq", "grupoatividade", "fef"))[0]


@query("programme_filter_without_match", "SELECT seq, linhaacao AS grupo, '  ' AS fef FROM {audits}")
def _(t):
    rows = t("audits").select("seq", F.col("linhaacao").alias("grupo"), F.lit("  ").alias("fef"))
    return audits.programme_filter(rows)[0]


@query(
    "programme_counts",
    f"SELECT count(*) AS rows_total, count(*) FILTER (WHERE {_RULE}) AS rows_matched, count(*) FILTER (WHERE {_RULE}) > 0 AS filter_applied FROM {{audits}}",
)
def _(t):
    return audits.programme_counts(t("audits"))


@query("edition_field", "SELECT seq, fef AS edicao_programa_sorteio_fef, 'derived_from_fef' AS source FROM {audits}")
def _(t):
    out, source, _ = audits.with_edition(t("audits"))
    return out.select("seq", "edicao_programa_sorteio_fef", F.lit(source).alias("source"))


# Audit rows go through the headers of the published file, with day-first date text.
_NAME = "c_name || ' á'"


@query(
    "audits_prepared",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS id_da_tarefa, o_orderpriority AS titulo_do_relatorio, strftime(o_orderdate, '%Y-%m-%d') AS day,
  upper(substr(c_mktsegment, 1, 2)) AS uf, {_NAME} AS municipality_name_raw, {q.match_key(_NAME)} AS municipality_name_norm,
  '2026-01-01T00:00:00Z' AS pulled_at_utc, 'IdTarefa,Titulo,DataPublicacao,UFs,Municipios,EdicaoProgramaSorteioFEF' AS source_columns_original,
  o_orderstatus AS edicaoprogramasorteiofef, row_number() OVER (ORDER BY o_orderkey) AS source_row_number FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
)
def _(t):
    o, c = t("orders"), t("customer")
    raw = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("IdTarefa"), F.col("o_orderpriority").alias("Titulo"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("DataPublicacao"),
        F.expr("' ' || lower(substr(c_mktsegment, 1, 2)) || CASE WHEN o_orderkey % 2 = 0 THEN ';ba' ELSE '' END").alias("UFs"),
        F.expr("'  ' || c_name || '   á '").alias("Municipios"), F.col("o_orderstatus").alias("EdicaoProgramaSorteioFEF"),
    )
    out, _ = audits.prepare_audits(raw, "2026-01-01T00:00:00Z", order="idtarefa")
    # Rows are numbered by their keys alone, so what the numbers need is not folded again.
    landed = o.join(c.select("c_custkey"), o.o_custkey == F.col("c_custkey"), "left_semi")
    numbered = number_rows(landed.select(F.col("o_orderkey").alias("idtarefa")), "idtarefa")
    out = out.join(numbered, "idtarefa")
    return out.select(
        "id_da_tarefa", "titulo_do_relatorio", F.date_format("publication_date", "yyyy-MM-dd").alias("day"), "uf",
        "municipality_name_raw", "municipality_name_norm", "pulled_at_utc", "source_columns_original",
        "edicaoprogramasorteiofef", "source_row_number",
    )


_UNIT = "CASE WHEN c_nationkey % 4 = 0 THEN c_name ELSE '  ' || c_name || ' /' || substr(lower(n_name), 1, 2) || CASE WHEN c_nationkey % 2 = 0 THEN ' resto/XY' ELSE '' END END"


@query(
    "places_from_unit_text",
    f"""SELECT c_custkey, CASE WHEN m[1] IS NULL THEN NULL ELSE upper(substr(n_name, 1, 2)) END AS uf, c_name AS place FROM
  (SELECT *, CASE WHEN c_nationkey % 4 = 0 THEN [NULL] ELSE [1] END AS m FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey)""",
)
def _(t):
    c, n = t("customer"), t("nation")
    units = c.join(n, c.c_nationkey == n.n_nationkey).withColumn("u", F.expr(_UNIT))
    return units.select("c_custkey", audits.unit_state("u").alias("uf"), audits.unit_place("u").alias("place"))


@query(
    "value_counts_top20",
    "SELECT coalesce(fef, '<NA>') AS fef, count(*) AS count FROM {audits} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(t):
    return profile.top_values(t("audits"), "fef")


@query(
    "publication_date_profile",
    """SELECT count(*) FILTER (WHERE d IS NULL) / greatest(count(*), 1) AS share_missing, strftime(min(d), '%Y-%m-%d') AS min_date,
  strftime(max(d), '%Y-%m-%d') AS max_date FROM (SELECT CASE WHEN fef IS NULL THEN NULL ELSE publication_date END AS d FROM {audits})""",
)
def _(t):
    d = F.when(F.col("fef").isNotNull(), F.col("publication_date"))
    return profile.date_profile(t("audits").select(d.alias("d")), "d")


@query(
    "located_coverage",
    """WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE o_orderstatus || 'B' END AS uf, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS n,
  CASE WHEN o_totalprice > 100000 THEN 1 END AS code FROM {orders})
  SELECT count(*) AS rows_with_location, count(code) AS mapped_rows, count(code) / greatest(count(*), 1) AS coverage_rate FROM r WHERE length(uf) >= 2 AND trim(n) <> ''""",
)
def _(t):
    return profile.located_coverage(
        t("orders").select(
            F.expr("CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE o_orderstatus || 'B' END").alias("uf"),
            F.expr("CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END").alias("municipality_name_norm"),
            F.expr("CASE WHEN o_totalprice > 100000 THEN '1' END").alias("ibge_municipality_code"),
        )
    )


@query(
    "link_keys_present",
    """SELECT o_orderkey AS seq, o_orderstatus AS uf, lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS ibge_municipality_code
  FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 0""",
)
def _(t):
    rows = t("orders").select(
        F.col("o_orderkey").alias("seq"), F.expr("' ' || lower(nullif(o_orderstatus, 'P')) || ' '").alias("uf"),
        F.expr("CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS STRING) END").alias("ibge_municipality_code"),
    )
    return link.linkable_audits(rows)[0].select("seq", "uf", "ibge_municipality_code")


# The first date of the table fixes the form of all; the others become null.
@query(
    "dates_by_first_form",
    """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 <> 0 OR o_orderkey = (SELECT min(o_orderkey) FROM {orders}) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM {orders}""",
)
def _(t):
    form = F.when((F.col("o_orderkey") % 4 != 0) | (F.col("o_orderkey") == F.col("lo")), "yyyy-MM-dd").otherwise("dd/MM/yyyy")
    o = t("orders")
    o = o.withColumn("lo", o.agg(F.min("o_orderkey")).scalar())
    iso = F.when(form == "yyyy-MM-dd", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    raw = o.select(F.col("o_orderkey").alias("seq"), iso.alias("DataPublicacao"))
    out, _ = audits.prepare_audits(raw, "2026-01-01T00:00:00Z", order="seq")
    return out.select("seq", F.date_format("publication_date", "yyyy-MM-dd").alias("day"))
