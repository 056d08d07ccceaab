"""Chunks, candidate links, enforcement indices and evaluation."""

from pyspark.sql import functions as F

from civiclink.operators import candidates, chunk, contracts, evaluate, indices, rows
from civiclink.operators.manifest import align_union
from civiclink.plans import views  # noqa: F401
from civiclink.plans.registry import query

# --- chunks -----------------------------------------------------------------------------------

_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS tx, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM {documents}),
marked AS (SELECT *, CASE WHEN length(trim(tx, ' ')) BETWEEN 3 AND 80 AND (regexp_matches(trim(tx, ' '), '^(#{1,6} |([0-9]+\\.)+ )')
  OR (upper(trim(tx, ' ')) = trim(tx, ' ') AND lower(trim(tx, ' ')) <> trim(tx, ' '))) THEN 1 ELSE 0 END AS h FROM lines),
placed AS (SELECT *, CAST(coalesce(sum(length(tx) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char,
  greatest(CAST(sum(CASE WHEN trim(tx, ' ') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) - 1, 0) AS paragraph,
  CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS section FROM marked),
sized AS (SELECT *, max(section) OVER (PARTITION BY doc_id) AS sections, max(paragraph) OVER (PARTITION BY doc_id) + 1 AS n FROM placed),
member AS (SELECT doc_id, line, tx, start_char, section AS chunk_index, 'heading' AS chunk_rule FROM sized WHERE sections > 0
  UNION ALL SELECT doc_id, line, tx, start_char, w, 'window' FROM sized, range(0, 100000) AS r(w)
  WHERE sections = 0 AND w <= greatest((n - 1 + 3) // 4 - 1, 0) AND paragraph BETWEEN w * 4 AND w * 4 + 4) """


@query(
    "document_chunks",
    "WITH " + _LINES.replace("#{1,6}", "#+") + """SELECT doc_id, chunk_index, chunk_rule, min(start_char) AS start_char, min(start_char) + length(string_agg(tx, chr(10) ORDER BY line)) AS end_char,
  md5(string_agg(tx, chr(10) ORDER BY line)) AS digest, CAST(1 AS BIGINT) AS page_start, CAST(1 AS BIGINT) AS page_end, any_value(lang) AS lang FROM member JOIN {documents} USING (doc_id) GROUP BY 1, 2, 3""",
)
def _(t):
    out = chunk.chunk_documents(t("documents"), "doc_id", ["lang"])
    return out.select(
        "doc_id", "chunk_index", "chunk_rule", "start_char", "end_char", F.md5("chunk_text").alias("digest"), "page_start", "page_end", "lang"
    )


# Each order as a report of three pages with its date.
@query(
    "report_chunks_with_pages",
    """SELECT o_orderkey, chunk_index, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CASE chunk_index WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS page_start,
  CAST(CASE chunk_index WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS page_end FROM {orders}, (VALUES (0), (1), (2)) AS n(chunk_index)""",
)
def _(t):
    parts = ["intro", "# ", "a\f", "b", "# end", "c\f"]
    lines = [F.lit(p) if p != "# " else F.concat(F.lit(p), "o_orderpriority") for p in parts]
    body = F.concat_ws("\n", *lines, "o_orderstatus")
    out = chunk.chunk_documents(t("orders").withColumn("body", body), "o_orderkey", ["o_orderdate"], "body")
    return out.select("o_orderkey", "chunk_index", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "page_start", "page_end")


@query(
    "chunks_match_source",
    "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS wrong FROM {documents}",
)
def _(t):
    docs = t("documents")
    cut = F.substring("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    checked = chunk.chunk_documents(docs, "doc_id").join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", (cut != F.col("chunk_text")).cast("int").alias("bad")
    )
    return checked.groupBy("doc_id").agg(F.sum("bad").alias("bad")).agg(F.count(F.lit(1)).alias("documents"), F.sum("bad").alias("wrong"))


# --- candidate pairs and links ----------------------------------------------------------------

def _sides(t):
    arrays = {"names": F.array("name_1"), "keywords": F.array("keyword_1")}
    f, d = t("findings").withColumns(arrays).drop("name_1", "keyword_1"), t("decisions").withColumns(arrays)
    return f, d.drop("name_1", "keyword_1")


def _scored(findings, decisions):
    pairs = candidates.candidate_pairs(findings, decisions, window_days=90)
    return pairs.withColumn("score", (F.col("finding_id") % 50 + F.col("quantity")).cast("double") / 100)


def _links(t):
    return _scored(*map(indices.weighed, _sides(t)))


_PAIR = "finding_id, decision_id, ibge_municipality_code, CAST(days_after AS BIGINT) AS days_after, shared_names, shared_keywords, jurisdiction_ok"


@query("candidate_pairs", f"SELECT {_PAIR} FROM {{links}}")
def _(t):
    return candidates.candidate_pairs(*_sides(t), window_days=90).select(
        "finding_id", "decision_id", "ibge_municipality_code", F.col("days_after").cast("long").alias("days_after"),
        "shared_names", "shared_keywords", "jurisdiction_ok",
    )


@query(
    "candidate_pairs_ranked",
    """SELECT finding_id, decision_id, row_number() OVER (PARTITION BY finding_id ORDER BY jurisdiction_ok DESC, shared_names DESC, shared_keywords DESC, days_after, decision_id) <= 3 AS kept FROM {links}""",
)
def _(t):
    return candidates.ranked_pairs(candidates.candidate_pairs(*_sides(t), window_days=90), 3).select("finding_id", "decision_id", "kept")


# Every pair twice: both rows of a repeated pair are ranked and stay.
@query(
    "repeated_pairs_ranked",
    """WITH two AS (SELECT * FROM {links} UNION ALL SELECT * FROM {links}) SELECT finding_id, decision_id, row_number() OVER
  (PARTITION BY finding_id ORDER BY jurisdiction_ok DESC, shared_names DESC, shared_keywords DESC, days_after, decision_id) <= 3 AS kept FROM two""",
)
def _(t):
    pairs = candidates.candidate_pairs(*_sides(t), window_days=90)
    return candidates.ranked_pairs(pairs.unionByName(pairs), 3).select("finding_id", "decision_id", "kept")


@query(
    "candidate_pairs_long_tail",
    """SELECT temporal_class, count(*) AS n FROM (SELECT finding_id, CASE WHEN datediff('day', publication_date, decision_date) < 60 THEN 'default' ELSE 'long_tail' END AS temporal_class
  FROM {links}) GROUP BY 1""",
)
def _(t):
    pairs = candidates.candidate_pairs(*_sides(t), window_days=60, horizon_days=90)
    return pairs.groupBy("temporal_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "temporal_classes",
    """SELECT CASE WHEN l_shipdate < o_orderdate THEN 'pre_audit' WHEN datediff('day', o_orderdate, l_shipdate) < 60 THEN 'default' ELSE 'long_tail' END AS class, count(*) AS n
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    li, o = t("lineitem"), t("orders")
    kind = candidates.temporal_class(F.col("o_orderdate"), F.col("l_shipdate"), 60)
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


_GRADED = """(SELECT *, CASE b WHEN 'high' THEN CASE WHEN jurisdiction_ok THEN 'high' ELSE 'medium' END WHEN 'medium' THEN CASE WHEN jurisdiction_ok THEN 'medium' ELSE 'low' END ELSE 'low' END AS band
  FROM (SELECT *, CASE WHEN score >= 0.85 AND shared_names > 0 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS b FROM {links}))"""


def _banded(links):
    return candidates.graded_links(links.withColumn("core_evidence", F.col("shared_names") > 0))


def _graded(t):
    return _banded(_links(t))


@query("link_bands", f"SELECT finding_id, decision_id, score, b AS band_before_conflict, band FROM {_GRADED}")
def _(t):
    return _graded(t).select("finding_id", "decision_id", "score", "band_before_conflict", "band")


_LEDGER = "(SELECT finding_id, decision_id FROM {links} WHERE court_level = 'state' AND NOT jurisdiction_ok AND shared_keywords > 0)"


@query("links_without_exclusions", f"SELECT finding_id, decision_id FROM {{links}} l ANTI JOIN {_LEDGER} x USING (finding_id, decision_id)")
def _(t):
    links = _links(t)
    ledger = links.where((F.col("court_level") == "state") & ~F.col("jurisdiction_ok") & (F.col("shared_keywords") > 0))
    return candidates.without_exclusions(links, ledger).select("finding_id", "decision_id")


@query(
    "link_graph_summary",
    """SELECT finding_id, arg_max(decision_id, (score, decision_id)) AS best_decision_id, max(score) AS best_score, count(*) AS links,
  round(CASE WHEN sum(score) > 0 THEN sum(CASE WHEN outcome_label = 'adverse' THEN score ELSE 0 END) / sum(score) ELSE 0 END, 9) AS weighted_adverse,
  count(DISTINCT outcome_label) > 1 AS conflicting_outcomes FROM {links} GROUP BY 1""",
)
def _(t):
    edges = candidates.link_edges(_graded(t))
    return candidates.finding_summary(edges).withColumn("weighted_adverse", F.round("weighted_adverse", 9))


# Each link again with the same score, a lower band and another outcome.
@query(
    "edges_with_equal_scores",
    f"""WITH two AS (SELECT finding_id, decision_id, score, band, outcome_label FROM {_GRADED} UNION ALL SELECT finding_id, decision_id, score, 'low', 'neutral' FROM {_GRADED})
  SELECT finding_id, decision_id, score, band, outcome_label FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, decision_id ORDER BY score DESC,
    CASE band WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, outcome_label DESC) AS r FROM two) WHERE r = 1""",
)
def _(t):
    once = _graded(t).select("finding_id", "decision_id", "score", "band", "outcome_label")
    return candidates.link_edges(once.unionByName(once.withColumns({"band": F.lit("low"), "outcome_label": F.lit("neutral")})))


@query(
    "score_profile",
    "SELECT court_level, year(decision_date) AS year, count(*) AS links, min(score) AS min_score, max(score) AS max_score, round(avg(score), 9) AS mean_score, "
    + ", ".join(f"count(*) FILTER (WHERE least(CAST(floor(score * 10) AS BIGINT), 9) = {i}) AS bin_{i}" for i in range(10))
    + " FROM {links} GROUP BY 1, 2",
)
def _(t):
    links = _links(t).withColumn("year", F.year("decision_date").cast("long"))
    return candidates.score_profile(links, ["court_level", "year"]).withColumn("mean_score", F.round("mean_score", 9))


@query(
    "links_near_thresholds",
    "SELECT finding_id, decision_id, score FROM {links} WHERE least(abs(score - CAST(0.65 AS DOUBLE)), abs(score - CAST(0.85 AS DOUBLE))) < 0.015",
)
def _(t):
    return candidates.near_threshold(_links(t), 0.015).select("finding_id", "decision_id", "score")


# --- indices ----------------------------------------------------------------------------------

_W = """CASE severity_level WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 3.0 END"""
_I = """CASE outcome_label WHEN 'adverse' THEN 1.0 WHEN 'neutral' THEN 0.25 ELSE 0.0 END * CASE legal_stage WHEN 'first_instance' THEN 1.0 WHEN 'appeal' THEN 1.5 ELSE 2.0 END"""


def _index_sql(by="", source="{links}"):
    extra = f", {by}" if by else ""
    return f"""SELECT ibge_municipality_code, year{extra}, CAST(sum(n) AS BIGINT) AS links, CAST(sum(adv) AS BIGINT) AS adverse_count, max(any_) AS any_punishment, CAST(sum(sev) AS DOUBLE) AS severity_weighted,
  CAST(min(first_) AS BIGINT) AS days_to_first_adverse, count(*) FILTER (WHERE adv > 0) / count(*) AS p_punished_given_linked, CAST(sum(inten) AS DOUBLE) AS enforcement_intensity FROM
  (SELECT ibge_municipality_code, year(decision_date) AS year{extra}, finding_id, count(*) AS n, count(*) FILTER (WHERE outcome_label = 'adverse') AS adv,
    max(CASE WHEN outcome_label = 'adverse' AND decision_date <= publication_date + INTERVAL 36 MONTH THEN 1 ELSE 0 END) AS any_,
    sum(CASE WHEN outcome_label = 'adverse' THEN {_W} ELSE 0 END) AS sev, min(CASE WHEN outcome_label = 'adverse' THEN days_after END) AS first_, sum({_I}) AS inten
   FROM {source} GROUP BY ALL) GROUP BY ALL"""


def _typed(df):
    return df.withColumns({"year": F.col("year").cast("long"), "days_to_first_adverse": F.col("days_to_first_adverse").cast("long")})


@query("enforcement_indices", _index_sql())
def _(t):
    return _typed(indices.enforcement_indices(_links(t)))


@query("enforcement_indices_split", _index_sql("court_level, decision_type"))
def _(t):
    return _typed(indices.enforcement_indices(_links(t), by=("court_level", "decision_type")))


_CUT = "(SELECT l.*, c.cutoff FROM {links} l JOIN (VALUES ('strict', 0.85), ('medium', 0.65), ('permissive', 0.0)) AS c(cutoff, lim) ON score >= CAST(lim AS DOUBLE))"


@query("indices_by_cutoff", _index_sql("cutoff", _CUT))
def _(t):
    return _typed(indices.indices_by_cutoff(_links(t)))


@query(
    "outcome_bounds",
    """SELECT ibge_municipality_code, year(decision_date) AS year, count(*) FILTER (WHERE outcome_label = 'adverse' AND score >= 0.85) AS lower_bound,
  count(*) FILTER (WHERE outcome_label = 'adverse' AND score >= 0.65) AS adverse_medium, count(*) FILTER (WHERE outcome_label = 'adverse') AS upper_bound FROM {links} GROUP BY 1, 2""",
)
def _(t):
    return indices.outcome_bounds(_links(t)).withColumn("year", F.col("year").cast("long"))


_OUT = "(SELECT ibge_municipality_code, year(decision_date) AS year, count(*) FILTER (WHERE outcome_label = 'adverse') AS adverse_count FROM {links} GROUP BY 1, 2)"
_PANEL = f"""(SELECT c.code AS ibge_municipality_code, y.year, first_exposure, coalesce(y.year >= first_exposure, false) AS exposed, y.year - first_exposure AS event_time,
  greatest(least(y.year - first_exposure, 3), -3) AS event_bin, coalesce(adverse_count, 0) AS adverse_count, c_acctbal AS balance
  FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS code, c_acctbal FROM {{customer}}) c CROSS JOIN
  (SELECT unnest(range(lo, hi + 1)) AS year FROM (SELECT min(y) AS lo, max(y) AS hi FROM (SELECT year(decision_date) AS y FROM {{links}}
    UNION ALL SELECT min(year(publication_date)) FROM {{findings}} GROUP BY ibge_municipality_code))) AS y
  LEFT JOIN (SELECT ibge_municipality_code AS k, min(year(publication_date)) AS first_exposure FROM {{findings}} GROUP BY 1) e ON c.code = e.k
  LEFT JOIN {_OUT} o ON c.code = o.ibge_municipality_code AND y.year = o.year)"""


def _panel(t):
    places = t("customer").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("ibge_municipality_code"), F.col("c_acctbal").alias("balance"))
    adverse = F.count_if("adverse").alias("adverse_count")
    outcomes = _links(t).groupBy("ibge_municipality_code", F.year("decision_date").alias("year")).agg(adverse)
    return indices.panel(places, indices.first_exposure(t("findings")), outcomes, places)


@query("place_year_panel", f"SELECT * FROM {_PANEL}")
def _(t):
    out = _panel(t)
    return out.withColumns({c: F.col(c).cast("long") for c in ("year", "first_exposure", "event_time", "event_bin")})


@query("event_time_means", f"SELECT event_bin, round(avg(adverse_count), 9) AS mean_outcome, count(*) AS cells FROM {_PANEL} WHERE event_bin IS NOT NULL GROUP BY 1")
def _(t):
    out = indices.event_means(_panel(t), "adverse_count")
    return out.select(F.col("event_bin").cast("long").alias("event_bin"), F.round("mean_outcome", 9).alias("mean_outcome"), "cells")


@query(
    "exposure_contrast",
    f"""SELECT year, round(avg(adverse_count) FILTER (WHERE exposed), 9) AS mean_exposed, round(avg(adverse_count) FILTER (WHERE NOT exposed), 9) AS mean_not_yet,
  count(*) FILTER (WHERE exposed) AS n_exposed, count(*) FILTER (WHERE NOT exposed) AS n_not_yet FROM {_PANEL} GROUP BY 1""",
)
def _(t):
    out = indices.exposure_contrast(_panel(t), "adverse_count")
    return out.withColumns({"year": F.col("year").cast("long"), **{c: F.round(c, 9) for c in ("mean_exposed", "mean_not_yet")}})


@query(
    "covariate_balance",
    """WITH v AS (SELECT c_mktsegment AS round, c_acctbal > 4000 AS t, 'c_nationkey' AS covariate, CAST(c_nationkey AS DOUBLE) AS x FROM {customer}
  UNION ALL SELECT c_mktsegment, c_acctbal > 4000, 'c_custkey', CAST(c_custkey AS DOUBLE) FROM {customer})
  SELECT round, covariate, count(*) FILTER (WHERE t) AS n_treated, count(*) FILTER (WHERE NOT t) AS n_control, round(avg(x) FILTER (WHERE t), 6) AS mean_treated,
  round(avg(x) FILTER (WHERE NOT t), 6) AS mean_control, round((avg(x) FILTER (WHERE t) - avg(x) FILTER (WHERE NOT t)) / sqrt((var_samp(x) FILTER (WHERE t) + var_samp(x) FILTER (WHERE NOT t)) / 2), 6) AS standardised_difference
  FROM v GROUP BY 1, 2""",
)
def _(t):
    c = t("customer").withColumn("treated", F.col("c_acctbal") > 4000).withColumnRenamed("c_mktsegment", "round")
    out = indices.balance(c, ["round"], "treated", ["c_nationkey", "c_custkey"])
    return out.withColumns({n: F.round(n, 6) for n in ("mean_treated", "mean_control", "standardised_difference")})


# --- evaluation -------------------------------------------------------------------------------

_GOLD = """(SELECT d.doc_id, lang, source, quality AS gold, toxic, CAST(n_chars > 1500 AS INT) AS predicted, CAST(n_chars % 101 AS DOUBLE) / 101 AS confidence FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id)"""


def _gold(t):
    return t("labels").join(t("documents"), "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("gold"), "toxic", (F.col("n_chars") > 1500).cast("int").alias("predicted"),
        ((F.col("n_chars") % 101).cast("double") / 101).alias("confidence"),
    )


@query(
    "label_precision_recall",
    f"""WITH g AS {_GOLD}, s AS (SELECT lang, l AS label, count(*) FILTER (WHERE gold = l AND predicted = l) AS true_positive, count(*) FILTER (WHERE gold <> l AND predicted = l) AS false_positive,
  count(*) FILTER (WHERE gold = l AND predicted <> l) AS false_negative FROM g, (VALUES (0), (1)) AS v(l) GROUP BY 1, 2)
  SELECT *, CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) ELSE 0 END AS precision,
  CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) ELSE 0 END AS recall,
  CASE WHEN true_positive + false_positive + false_negative > 0 THEN 2 * true_positive / (2 * true_positive + false_positive + false_negative) ELSE 0 END AS f1 FROM s
  WHERE true_positive + false_positive + false_negative > 0""",
)
def _(t):
    return evaluate.label_scores(_gold(t), "gold", "predicted", ["lang"])


@query(
    "precision_recall_at_k",
    f"""WITH g AS {_GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, doc_id) AS rk FROM g),
  s AS (SELECT source, count(*) FILTER (WHERE gold = 1) AS rel, count(*) FILTER (WHERE gold = 1 AND rk <= 5) AS hits FROM r GROUP BY 1)
  SELECT count(*) AS queries, round(avg(hits / 5), 9) AS precision_at_k, round(avg(hits / rel), 9) AS recall_at_k FROM s WHERE rel > 0""",
)
def _(t):
    src = _gold(t).withColumn("relevant", F.col("gold") == 1)
    out = evaluate.ranking_scores(src, "source", "confidence", "relevant", "doc_id", 5)
    return out.select("queries", *[F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k")])


@query(
    "roc_and_pr_points",
    f"""WITH g AS {_GOLD}, c AS (SELECT confidence AS threshold, count(*) FILTER (WHERE gold = 1) AS p, count(*) FILTER (WHERE gold <> 1) AS n FROM g GROUP BY 1),
  w AS (SELECT threshold, CAST(sum(p) OVER (ORDER BY threshold DESC) AS BIGINT) AS true_positive, CAST(sum(n) OVER (ORDER BY threshold DESC) AS BIGINT) AS false_positive FROM c)
  SELECT *, true_positive / (SELECT sum(p) FROM c) AS recall, false_positive / (SELECT sum(n) FROM c) AS false_positive_rate, true_positive / (true_positive + false_positive) AS precision FROM w""",
)
def _(t):
    return evaluate.curve_points(_gold(t).withColumn("truth", F.col("gold") == 1), "confidence", "truth")


@query(
    "calibration_bins",
    f"""SELECT least(CAST(floor(confidence * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, round(avg(CAST(gold = predicted AS INT)), 9) AS accuracy FROM {_GOLD} GROUP BY 1""",
)
def _(t):
    out = evaluate.calibration(_gold(t).withColumn("correct", F.col("gold") == F.col("predicted")), "confidence", "correct")
    return out.select("bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(
    "annotator_agreement",
    f"""WITH g AS {_GOLD}, s AS (SELECT count(*) AS items, count(*) FILTER (WHERE gold = predicted) / count(*) AS observed,
  (CAST(count(*) FILTER (WHERE gold = 1) * count(*) FILTER (WHERE predicted = 1) + count(*) FILTER (WHERE gold = 0) * count(*) FILTER (WHERE predicted = 0) AS DOUBLE)) / (count(*) * count(*)) AS expected FROM g)
  SELECT items, observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS kappa FROM s""",
)
def _(t):
    out = evaluate.agreement(_gold(t), "gold", "predicted")
    return out.select("items", "observed", F.round("expected", 9).alias("expected"), F.round("kappa", 9).alias("kappa"))


@query(
    "abstention_rates",
    f"""SELECT lang, n, abstained, correct, abstained / n AS abstention_rate, CASE WHEN n > abstained THEN correct / (n - abstained) ELSE 0 END AS precision, correct / n AS recall FROM
  (SELECT lang, count(*) AS n, count(*) FILTER (WHERE confidence < 0.3) AS abstained, count(*) FILTER (WHERE confidence >= 0.3 AND gold = predicted) AS correct FROM {_GOLD} GROUP BY 1)""",
)
def _(t):
    src = _gold(t).withColumns({"gave_up": F.col("confidence") < 0.3, "right": F.col("gold") == F.col("predicted")})
    return evaluate.abstention(src, "gave_up", "right", ["lang"])


@query(
    "span_overlaps",
    """SELECT doc_id, CASE WHEN n_chars + 50 > 0 THEN greatest(least(n_chars, n_chars // 2 + 60) - greatest(n_chars // 3, 0), 0) / (greatest(n_chars, n_chars // 2 + 60) - least(n_chars // 3, 0)) END AS overlap FROM {documents}""",
)
def _(t):
    d = t("documents").select(
        "doc_id", F.lit(0).cast("long").alias("gs"), F.col("n_chars").alias("ge"), F.expr("n_chars div 3").alias("s"),
        F.expr("n_chars div 2 + 60").alias("e"),
    )
    return d.select("doc_id", evaluate.span_overlap("gs", "ge", "s", "e").alias("overlap"))


@query(
    "error_rates_rollup",
    f"""SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE gold <> predicted) AS errors, round(avg(CAST(gold <> predicted AS INT)), 9) AS error_rate FROM {_GOLD} GROUP BY ROLLUP (lang, source)""",
)
def _(t):
    out = evaluate.error_rates(_gold(t).withColumn("wrong", F.col("gold") != F.col("predicted")), ["lang", "source"], "wrong")
    return out.withColumn("error_rate", F.round("error_rate", 9))


@query(
    "stratified_gold_sample",
    """SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR) || '|11'), doc_id) AS r FROM {documents}) WHERE r <= 3""",
)
def _(t):
    src = t("documents").select("lang", "source", "doc_id")
    return rows.stratified_sample(src, ["lang", "source"], ["doc_id"], 3, 11)


def _short(x):
    # The pattern takes the characters around a word, so neighbours need a second pass.
    a = "[A-Za-z]"
    return f"regexp_replace({x}, '(^|[^\\pL\\pN_])({a}{a}{a}){a}{a}{a}{a}{a}+([^\\pL\\pN_]|$)', '\\1\\2.\\3', 'g')"


_VARIANTS = {
    "original": "text", "truncated": "substr(text, 1, CAST(ceil(length(text) / 2) AS INT))",
    "no_headings": "regexp_replace(text, '(?m)^(#+ |([0-9]+\\.)+ ).*$', '', 'g')",
    "abbreviated": _short(_short("text")), "scan_noise": "translate(text, 'lO', '10')",
}


@query(
    "stress_variants",
    " UNION ALL ".join(f"SELECT doc_id, '{n}' AS variant, md5({e}) AS digest FROM {{documents}}" for n, e in _VARIANTS.items()),
)
def _(t):
    return evaluate.stress_variants(t("documents"), "doc_id").select("doc_id", "variant", F.md5("variant_text").alias("digest"))


@query(
    "shifted_dates",
    "SELECT DISTINCT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS shifted FROM {orders}",
)
def _(t):
    out = evaluate.shift_dates(t("orders").withColumn("d", F.to_date("o_orderdate")), "d")
    return out.select("o_orderkey", F.date_format("shifted_date", "yyyy-MM-dd").alias("shifted"))


# --- model responses --------------------------------------------------------------------------

def _outcome_payload(t):
    d = t("decisions")
    payload = F.to_json(
        F.struct(
            "decision_id", F.lit("c").alias("case_id"), F.col("court_level").alias("court"),
            F.date_format("decision_date", "yyyy-MM-dd").alias("decision_date"),
            F.when(F.col("decision_type") == "merits", F.col("outcome_label")).otherwise(F.upper("outcome_label")).alias("outcome_label"),
            F.lit("s").alias("outcome_summary"), (F.col("quantity") / 40.0).alias("confidence"),
        )
    )
    return d.select("decision_id", payload.alias("payload"), "quantity", "decision_type", "outcome_label")


_BAD = "(quantity > 40 OR decision_type <> 'merits')"


@query(
    "decision_outcomes_softened",
    f"""SELECT decision_id, CASE WHEN quantity < 20 THEN NULL ELSE outcome_label END AS outcome_label, round(quantity / 40, 9) AS confidence, quantity < 20 AS abstained FROM {{decisions}} WHERE NOT {_BAD}""",
)
def _(t):
    checked = contracts.check(_outcome_payload(t), "DecisionOutcome")
    good = contracts.soften(contracts.valid_records(checked, "DecisionOutcome", []), ["outcome_label", "outcome_summary"])
    return good.select("decision_id", "outcome_label", F.round("confidence", 9).alias("confidence"), "abstained")


@query(
    "response_retry_list",
    f"""SELECT decision_id, CASE WHEN decision_type <> 'merits' AND quantity > 40 THEN 'outcome_label:not_allowed,confidence:out_of_range' WHEN quantity > 40 THEN 'confidence:out_of_range'
  ELSE 'outcome_label:not_allowed' END AS reasons FROM {{decisions}} WHERE {_BAD}""",
)
def _(t):
    return contracts.retry_list(contracts.check(_outcome_payload(t), "DecisionOutcome"), ["decision_id"])


def _card_payload(t):
    card = F.to_json(
        F.struct(
            F.col("finding_id").cast("string").alias("finding_id"), F.lit("r").alias("audit_report_id"),
            F.col("ibge_municipality_code").alias("municipality"), F.col("uf").alias("state"), F.lit("t").alias("finding_type"),
            "severity_level", F.when(F.col("keyword_1") != "5", F.lit("s")).alias("summary"), F.lit("12.5").alias("amount_brl"),
            F.lit(1).alias("confidence"),
            F.array(F.struct(F.lit("d").alias("source_doc_id"), F.col("name_1").alias("quote"), F.lit(3).alias("page"))).alias("evidence"),
        )
    )
    return t("findings").select("finding_id", F.struct("uf", "keyword_1").alias("_s"), card.alias("payload"))


@query(
    "finding_cards_valid",
    "SELECT CAST(finding_id AS VARCHAR) AS finding_id, severity_level, CAST(12.5 AS DOUBLE) AS amount_brl, CAST(1 AS DOUBLE) AS confidence, name_1 AS quote, CAST(3 AS BIGINT) AS page FROM {findings} WHERE keyword_1 <> '5'",
)
def _(t):
    good = contracts.valid_records(contracts.check(_card_payload(t), "AuditFindingCard"), "AuditFindingCard", [])
    span = F.col("evidence")[0]
    return good.select("finding_id", "severity_level", "amount_brl", "confidence", span["quote"].alias("quote"), span["page"].alias("page"))


@query(
    "error_log",
    f"""SELECT 'cards' AS module_name, 'summary:missing' AS reason_code, count(*) AS n FROM {{findings}} WHERE keyword_1 = '5'
  UNION ALL SELECT 'outcomes', 'outcome_label:not_allowed', count(*) FROM {{decisions}} WHERE decision_type <> 'merits'
  UNION ALL SELECT 'outcomes', 'confidence:out_of_range', count(*) FROM {{decisions}} WHERE quantity > 40""",
)
def _(t):
    cards = contracts.quarantine(contracts.check(_card_payload(t), "AuditFindingCard"), "cards", "v1", "m", ["finding_id"])
    outcomes = contracts.quarantine(contracts.check(_outcome_payload(t), "DecisionOutcome"), "outcomes", "v1", "m", ["decision_id"])
    return align_union(cards, outcomes).groupBy("module_name", "reason_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evidence_spans_valid",
    "SELECT item_id, CAST(item_id AS VARCHAR) AS source_doc_id, length(text) AS n FROM {benchmark} WHERE length(text) > 0",
)
def _(t):
    span = F.to_json(F.struct(F.col("item_id").cast("string").alias("source_doc_id"), F.col("text").alias("quote"), F.lit(0).alias("start_char")))
    good = contracts.valid_records(contracts.check(t("benchmark").select("item_id", span.alias("payload")), "EvidenceSpan"), "EvidenceSpan", ["item_id"])
    return good.select("item_id", "source_doc_id", F.length("quote").alias("n"))


# Pages that are large, not a number, not whole, or text: one bad record never stops the others.
_PAGE = """CASE item_id % 6 WHEN 0 THEN '3000000000' WHEN 1 THEN '"NaN"' WHEN 2 THEN '2.5' WHEN 3 THEN '"7"' WHEN 4 THEN '1e30' ELSE 'null' END"""


@query(
    "evidence_pages_checked",
    """SELECT item_id, CASE item_id % 6 WHEN 0 THEN CAST(3000000000 AS BIGINT) WHEN 3 THEN 7 END AS page,
  CASE WHEN item_id % 6 IN (1, 2, 4) THEN 'page:type' ELSE '' END AS reasons FROM {benchmark}""",
)
def _(t):
    span = F.expr(f"""'{{"source_doc_id":"d","quote":"q","page":' || {_PAGE} || '}}'""")
    checked = contracts.check(t("benchmark").select("item_id", span.alias("payload")), "EvidenceSpan")
    reasons = F.array_join("_errors", ",")
    return checked.select("item_id", F.when(reasons == "", F.col("_record.page")).alias("page"), reasons.alias("reasons"))
