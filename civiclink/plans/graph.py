"""Clusters of the link graph, alike names, versioned landing and keyed deltas."""

from functools import reduce

from pyspark.sql import functions as F

from civiclink.operators import candidates, clusters, namejoin, quantiles
from civiclink.plans import provenance, views  # noqa: F401
from civiclink.plans.outcomes import _GRADED, _banded, _graded, _scored, _sides
from civiclink.plans.registry import query, view
from civiclink.sources.keyed import KeyedTable
from civiclink.sources.landing import LandingStore
from civiclink.sources.scratch import shared_folder

# --- clusters ---------------------------------------------------------------------------------

# Findings that decisions join, directly or through others; low links are left out.
_EDGES = f"e AS (SELECT finding_id, decision_id, score, outcome_label FROM {_GRADED} WHERE band <> 'low')"
_REACH = f"""WITH RECURSIVE {_EDGES},
s AS (SELECT DISTINCT a.finding_id AS x, b.finding_id AS y FROM e a JOIN e b USING (decision_id)),
r AS (SELECT x, y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x),
c AS (SELECT x AS finding_id, min(y) AS cluster_id FROM r GROUP BY x),
t AS (SELECT cluster_id, count(DISTINCT finding_id) AS findings, count(DISTINCT decision_id) AS decisions, count(*) AS links,
  string_agg(DISTINCT outcome_label, ',' ORDER BY outcome_label) AS outcomes, max(score) AS best_score,
  round(CASE WHEN sum(score) > 0 THEN sum(CASE WHEN outcome_label = 'adverse' THEN score ELSE 0 END) / sum(score) ELSE 0 END, 9) AS weighted_adverse,
  count(DISTINCT outcome_label) > 1 AS conflicting FROM e JOIN c USING (finding_id) GROUP BY cluster_id) """


def _clustered(t):
    findings, decisions = _sides(t)
    decisions = decisions.drop("legal_stage", "decision_type")  # not needed, and decisions are stored
    return clusters.link_clusters(candidates.strong_edges(findings, decisions, lambda f, d: _banded(_scored(f, d))))


@query("outcome_clusters", _REACH + "SELECT finding_id, cluster_id, findings + decisions AS cluster_size, conflicting FROM c JOIN t USING (cluster_id)")
def _(t):
    return clusters.finding_clusters(_clustered(t))


@query("outcome_cluster_summary", _REACH + "SELECT cluster_id, findings, decisions, links, outcomes, best_score, weighted_adverse, conflicting FROM t")
def _(t):
    out = clusters.cluster_summary(_clustered(t))
    return out.withColumns({"outcomes": F.array_join("outcomes", ","), "weighted_adverse": F.round("weighted_adverse", 9)})


# --- alike names ------------------------------------------------------------------------------

# Names of three to five words with forms of bodies, titles, accents, other orders and a missing word.
view(
    "body_names",
    """SELECT p_partkey, p_name || ' ' || lower(p_type) || ' ' || replace(lower(p_brand), '#', ' ') AS plain,
       CASE p_partkey % 6
         WHEN 0 THEN 'Dr. ' || upper(p_name) || ' de ' || p_type || ', ' || replace(p_brand, '#', ' ')
         WHEN 1 THEN replace(p_brand, '#', ' ') || ' ' || p_type || ' ' || p_name || ' S/A'
         WHEN 2 THEN replace(p_name, 'o', 'ó') || ' e ' || p_type || ' ' || replace(p_brand, '#', '-') || ' LTDA.'
         WHEN 3 THEN p_name || ' ' || p_type
         WHEN 4 THEN p_type || ' ' || p_type || ' ' || replace(p_brand, '#', ' ') || ' Cia'
         ELSE 'Ltda' END AS raw
  FROM {part}""",
)
_WORDS = """list_distinct(list_filter(string_split(regexp_replace(regexp_replace(upper(strip_accents({x})), 'S/A', 'SA', 'g'), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"""
_DROP = "['LTDA', 'SA', 'CIA', 'DR', 'DE', 'E']"


def _set_of(x: str) -> str:
    words = _WORDS.replace("{x}", x)
    kept = f"list_filter({words}, lambda w: NOT list_contains({_DROP}, w))"
    return f"list_sort(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END)"


@query(
    "similar_entity_names",
    f"""WITH a AS (SELECT DISTINCT {_set_of('raw')} AS x FROM {{body_names}}), b AS (SELECT DISTINCT {_set_of('plain')} AS y FROM {{body_names}}),
p AS (SELECT x, y, len(list_intersect(x, y)) AS shared FROM a, b)
SELECT array_to_string(x, ' ') AS left_key, array_to_string(y, ' ') AS right_key, CAST(shared AS INTEGER) AS shared, round(shared / (len(x) + len(y) - shared), 9) AS jaccard
FROM p WHERE shared * 10 >= (len(x) + len(y) - shared) * 6""",
)
def _(t):
    names = t("body_names")
    found = namejoin.similar_names(names.select(F.col("raw").alias("name")), names.select(F.col("plain").alias("name")), 0.6)
    return found.withColumn("jaccard", F.round("jaccard", 9))


# Findings name bodies in one way, decisions in another.
view(
    "named_findings",
    """SELECT o_orderkey AS finding_id, lpad(CAST(o_custkey AS STRING), 7, '0') AS ibge_municipality_code, o_orderstatus || 'B' AS uf, CAST(o_orderdate AS DATE) AS publication_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'Dr. ' || o_orderstatus || ' Casa ' || substr(o_orderpriority, 3) WHEN 1 THEN upper(substr(o_orderpriority, 3)) || ' ' || o_orderstatus || ' LTDA' ELSE 'Ltda' END AS body
  FROM {orders}""",
)
view(
    "named_decisions",
    """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS decision_id,
       lpad(CAST(o_custkey AS STRING), 7, '0') AS ibge_municipality_code, 'FB' AS uf, CAST(l_shipdate AS DATE) AS decision_date,
       l_linestatus || ' ' || substr(o_orderpriority, 3) || ' S/A' AS first_body, 'Casa de ' || l_returnflag || ' ' || l_linestatus || ', ' || substr(o_orderpriority, 3) AS second_body
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
)
_ALIKE = """(len(list_intersect({x}, {y})) * 2 >= len(list_distinct(list_concat({x}, {y}))))"""


@query(
    "candidate_pairs_by_names",
    f"""WITH f AS (SELECT *, {_set_of('body')} AS x FROM {{named_findings}}), d AS (SELECT *, {_set_of('first_body')} AS y1, {_set_of('second_body')} AS y2 FROM {{named_decisions}})
SELECT finding_id, decision_id, CAST({_ALIKE.format(x='x', y='y1')} AS INT) + CAST(y1 <> y2 AND {_ALIKE.format(x='x', y='y2')} AS INT) AS shared_names
FROM f JOIN d ON f.ibge_municipality_code = d.ibge_municipality_code AND decision_date >= publication_date AND decision_date < publication_date + INTERVAL 90 DAY""",
)
def _(t):
    words = F.array().cast("array<string>")
    findings = t("named_findings").withColumns({"names": F.array("body"), "keywords": words}).drop("body")
    decisions = t("named_decisions").withColumns({"names": F.array("first_body", "second_body"), "keywords": words, "court_level": F.lit("federal")})
    findings, decisions = namejoin.with_similar_names(findings, decisions.drop("first_body", "second_body"), 0.5)
    return candidates.candidate_pairs(findings, decisions, window_days=90).select("finding_id", "decision_id", "shared_names")


# --- landing and keyed deltas -----------------------------------------------------------------

# Three landings of one file per order: some contents change, and change back; many are equal.
_LANDINGS = {
    "first": ("o_orderkey % 4 <> 0", "o_orderpriority"),
    "second": ("true", "CASE WHEN o_totalprice > 250000 THEN 'edited ' || o_orderstatus ELSE o_orderpriority END"),
    "third": ("o_orderkey % 3 = 0", "o_orderpriority"),
}
_VERSIONS = "WITH " + ", ".join(
    f"l{i} AS (SELECT CAST(o_orderkey AS VARCHAR) AS p, {text} AS c FROM {{orders}} WHERE {where})" for i, (where, text) in enumerate(_LANDINGS.values(), 1)
) + """, v1 AS (SELECT p, 1 AS version, c, 'first' AS batch FROM l1),
v2 AS (SELECT l2.p, coalesce(v1.version, 0) + 1 AS version, l2.c, 'second' AS batch FROM l2 LEFT JOIN v1 ON v1.p = l2.p WHERE v1.c IS NULL OR v1.c <> l2.c),
now AS (SELECT p, max(version) AS version, arg_max(c, version) AS c FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY p),
v3 AS (SELECT l3.p, now.version + 1 AS version, l3.c, 'third' AS batch FROM l3 JOIN now ON now.p = l3.p WHERE now.c <> l3.c),
v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3) """


def _landed(t):
    o = t("orders")
    store = LandingStore(o.sparkSession, shared_folder(o.sparkSession, "landing"), buckets=8)
    for batch, (where, text) in _LANDINGS.items():
        store.land(batch, o.where(where).select(F.col("o_orderkey").cast("string").alias("local_path"), F.encode(F.expr(text), "UTF-8").alias("content")))
    return store


@query("landed_versions", _VERSIONS + "SELECT p AS local_path, CAST(version AS INTEGER) AS version, sha256(c) AS sha256, CAST(length(c) AS BIGINT) AS size_bytes, batch FROM v")
def _(t):
    return _landed(t).versions()


@query(
    "landed_contents",
    _VERSIONS + """SELECT sha256(c) AS sha256, any_value(c) AS text, CAST(1 AS BIGINT) AS copies, count(*) FILTER (WHERE last) AS paths FROM
(SELECT *, version = max(version) OVER (PARTITION BY p) AS last FROM v) GROUP BY c""",
)
def _(t):
    store = _landed(t)
    copies = store.contents().groupBy("sha256", F.decode("content", "UTF-8").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    paths = store.current().groupBy("sha256").agg(F.count(F.lit(1)).alias("paths"))
    return copies.join(paths, "sha256", "left").withColumn("paths", F.coalesce("paths", F.lit(0)).cast("long"))


# The two manifests as a keyed table: a load, a compaction, then deltas that are merged when read.
@query(
    "manifest_deltas",
    """SELECT seq, local_path, item_type, sha256, size_bytes, parser_version FROM (SELECT *, row_number() OVER (PARTITION BY local_path, item_type ORDER BY part DESC, seq DESC) AS r FROM
  (SELECT *, NULL AS parser_version, 0 AS part FROM {manifest_old} UNION ALL SELECT *, CASE WHEN item_type = 'error' THEN 2 ELSE 1 END FROM {manifest_new})) WHERE r = 1""",
)
def _(t):
    old, new = t("manifest_old"), t("manifest_new")
    table = KeyedTable(old.sparkSession, shared_folder(old.sparkSession, "manifest"), ["local_path", "item_type"], buckets=16, seq="seq")
    table.upsert("load", old)
    table.compact()
    table.upsert("pages", new.where("item_type != 'error'"))
    table.upsert("errors", new.where("item_type = 'error'"))
    table.upsert("errors", new.where("item_type = 'error'"))
    return table.read()


# Score sketches per court level and month, merged into years; their quantiles are held against exact ranks.
@query(
    "score_quantiles",
    """SELECT court_level, year(decision_date) AS year, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 9) AS mean, true AS within_bound FROM {links} GROUP BY 1, 2""",
)
def _(t):
    links = _graded(t).withColumns({"year": F.year("decision_date").cast("long"), "month": F.month("decision_date")})
    months = quantiles.sketches(links, ["court_level", "year", "month"], "score")
    years = quantiles.quantiles(quantiles.merged(months, ["court_level", "year"]))
    names = {f"q{round(100 * r):02d}": r for r in quantiles.RANKS}
    one = years.select(F.col("court_level").alias("c"), F.col("year").alias("y"), *names)
    met = links.join(one, (F.col("court_level") == F.col("c")) & (F.col("year") == F.col("y")))
    held = [(F.avg((F.col("score") < F.col(q)).cast("int")) <= r + 0.01) & (F.avg((F.col("score") <= F.col(q)).cast("int")) >= r - 0.01) for q, r in names.items()]
    checked = met.groupBy("court_level", "year").agg(reduce(lambda a, b: a & b, held).alias("within_bound"))
    return years.join(checked, ["court_level", "year"]).select("court_level", "year", "n", "low", "high", F.round("mean", 9).alias("mean"), "within_bound")
