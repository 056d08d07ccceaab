"""Derived tables over the given ones, written once in SQL that Spark and the oracle both read."""

from civiclink.plans.registry import view

# Official places: one row per (name, brand). States are the last digit of the brand, so the same
# (state, name) occurs more than once.
view(
    "ref_places",
    """SELECT lpad(CAST(min(p_partkey) AS STRING), 7, '0') AS ibge_municipality_code,
       p_name AS municipality_name_official, 'B' || right(p_brand, 1) AS uf,
       upper(p_name) AS municipality_name_norm, min(p_partkey) AS ref_pos
  FROM {part} GROUP BY p_name, p_brand""",
)

# Free-text names: every part, written in seven ways.
view(
    "dirty_places",
    """SELECT p_partkey AS seq,
       CASE WHEN p_partkey % 7 = 5 THEN 'ZZ' ELSE 'B' || right(p_brand, 1) END AS uf,
       CASE p_partkey % 7
         WHEN 1 THEN '- ' || upper(p_name)
         WHEN 2 THEN replace(p_name, 'o', 'ó')
         WHEN 3 THEN substr(p_name, 1, length(p_name) - 2) || right(p_name, 1) || substr(p_name, length(p_name) - 1, 1)
         WHEN 4 THEN p_name || ' qx'
         WHEN 6 THEN 'kzv ' || right(p_name, 2)
         ELSE p_name END AS municipality_name_clean
  FROM {part}""",
)

view(
    "alias_places",
    """SELECT * FROM (VALUES
  (1, 'B1', 'kzv ng', 'small ring', 'old name', 'seed'),
  (2, 'B2', 'kzv lt', 'old gear', 'first entry', 'seed'),
  (3, 'B2', 'kzv lt', 'small bolt', 'second entry', 'seed'),
  (4, 'B3', 'red ring', 'blue bolt', 'keeps exact match', 'seed'),
  (5, 'ZZ', 'red ring', 'blue bolt', 'no such state', 'seed')
) AS t(seq, uf, name_norm_from, name_norm_to, note, source)""",
)

view(
    "override_places",
    """SELECT * FROM (VALUES
  (1, 'B4', 'kzv ar', '12', 'typo'),
  (2, 'B5', 'kzv te', '9999999', 'code without a name'),
  (3, 'B6', 'small ring', '31', 'first entry'),
  (4, 'B6', 'small ring', '37', ''),
  (5, 'ZZ', 'hot gear', '12', 'moved')
) AS t(seq, uf, municipality_name_clean, ibge_municipality_code, note)""",
)

# Selected places by round: distinct (user, event type).
view(
    "lottery",
    """SELECT min(event_id) AS seq, lpad(CAST(user_id AS STRING), 7, '0') AS ibge_municipality_code,
       CASE event_type WHEN 'signup' THEN 'OB' WHEN 'purchase' THEN 'PB' WHEN 'error' THEN 'ZB' ELSE 'FB' END AS uf,
       'Place ' || CAST(user_id AS STRING) AS municipality_name_clean,
       'r_' || event_type AS round_id, event_type AS round_label
  FROM {events} GROUP BY user_id, event_type""",
)

# Audits: one per order.
view(
    "audits",
    """SELECT o_orderkey AS seq, lpad(CAST(o_custkey AS STRING), 7, '0') AS ibge_municipality_code,
       o_orderstatus || 'B' AS uf, 'Place ' || CAST(o_custkey AS STRING) AS municipality_name_raw,
       CAST(o_orderkey AS STRING) AS id_da_tarefa,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey + 7 AS STRING) END AS id_da_auditoria,
       o_orderpriority AS titulo_do_relatorio, o_orderdate AS publication_date, o_orderdate AS data_de_publicacao,
       CASE o_orderstatus WHEN 'F' THEN 'Fiscalizacao de Entes Federativos' ELSE 'Grupo ' || o_orderstatus END AS grupoatividade,
       'Linha ' || substr(o_orderpriority, 1, 1) AS linhaacao,
       CASE WHEN o_totalprice > 250000 THEN 'Tipo alto' ELSE 'Tipo baixo' END AS tiposervico,
       CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'V06' ELSE ' 034 ' END AS fef
  FROM {orders}""",
)

# Download attempts: one per event.
view(
    "attempts",
    """SELECT event_id AS seq, 'run' AS run_id, CAST(user_id AS STRING) AS idtarefa,
       CASE event_id % 2 WHEN 0 THEN 'eaud' ELSE 'ecgu' END AS host,
       'https://eaud.cgu.gov.br/relatorios/download/' || CAST(user_id AS STRING) AS url,
       CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 200 WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE -1 END AS status_code,
       CASE event_type WHEN 'click' THEN 'application/pdf' WHEN 'view' THEN 'application/octet-stream'
                       WHEN 'error' THEN 'text/html' WHEN 'signup' THEN NULL ELSE '' END AS content_type,
       CAST(floor(value * 100) AS BIGINT) AS bytes_len, value AS elapsed_ms,
       CASE event_id % 5 WHEN 0 THEN '%PDF-1.7 x' WHEN 1 THEN 'PK' || chr(3) || chr(4) || 'zip' ELSE '<html></html>' END AS head
  FROM {events}""",
)

# Manifest rows: events written in two runs, the second with one more column.
view(
    "manifest_old",
    """SELECT event_id AS seq, CAST(user_id AS STRING) AS local_path, event_type AS item_type,
       md5(CAST(event_id AS STRING)) AS sha256, CAST(floor(value * 100) AS BIGINT) AS size_bytes
  FROM {events} WHERE event_type <> 'click'""",
)

# Findings and decisions of the same customer.
view(
    "findings",
    """SELECT o_orderkey AS finding_id, lpad(CAST(o_custkey AS STRING), 7, '0') AS ibge_municipality_code, o_orderstatus || 'B' AS uf,
       CAST(o_orderdate AS DATE) AS publication_date, o_orderstatus AS name_1, substr(o_orderpriority, 1, 1) AS keyword_1,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity_level
  FROM {orders}""",
)
view(
    "decisions",
    """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS decision_id,
       lpad(CAST(o_custkey AS STRING), 7, '0') AS ibge_municipality_code, l_linestatus || 'B' AS uf, CAST(l_shipdate AS DATE) AS decision_date,
       CASE l_returnflag WHEN 'R' THEN 'adverse' WHEN 'A' THEN 'neutral' ELSE 'non_punishment' END AS outcome_label,
       CASE WHEN l_tax < 0.04 THEN 'federal' ELSE 'state' END AS court_level,
       CASE WHEN l_discount < 0.03 THEN 'first_instance' WHEN l_discount < 0.07 THEN 'appeal' ELSE 'final' END AS legal_stage,
       CASE WHEN l_suppkey % 2 = 0 THEN 'merits' ELSE 'procedural' END AS decision_type,
       l_linestatus AS name_1, CAST(l_linenumber AS STRING) AS keyword_1, CAST(l_quantity AS BIGINT) AS quantity
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
)

# Pairs within 90 days with a score between 0 and 0.99; the Spark side builds them by its operator.
view(
    "links",
    """SELECT f.finding_id, f.ibge_municipality_code, f.uf AS finding_uf, f.publication_date, f.severity_level, d.decision_id, d.uf AS decision_uf,
       d.decision_date, d.outcome_label, d.court_level, d.legal_stage, d.decision_type, datediff('day', f.publication_date, d.decision_date) AS days_after,
       CASE WHEN f.name_1 = d.name_1 THEN 1 ELSE 0 END AS shared_names, CASE WHEN f.keyword_1 = d.keyword_1 THEN 1 ELSE 0 END AS shared_keywords,
       d.court_level <> 'state' OR f.uf = d.uf AS jurisdiction_ok, CAST(f.finding_id % 50 + d.quantity AS DOUBLE) / 100 AS score
  FROM {findings} f JOIN {decisions} d ON f.ibge_municipality_code = d.ibge_municipality_code
   AND d.decision_date >= f.publication_date AND d.decision_date < f.publication_date + INTERVAL 90 DAY""",
)
