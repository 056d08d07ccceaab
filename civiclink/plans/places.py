"""Place names to codes over the part-based proxy tables."""

from pyspark.sql import functions as F

from civiclink.functions.similarity import ratio_udf, weighted_ratio_udf
from civiclink.functions.text import match_key
from civiclink.operators import ladder, profile
from civiclink.operators.gates import no_manual_gate
from civiclink.plans import sqltext as q
from civiclink.plans import views  # noqa: F401
from civiclink.plans.registry import query, view


def _inputs(t):
    return t("dirty_places"), t("ref_places"), {"aliases": t("alias_places"), "overrides": t("override_places")}


def _last(name, keys, values, source, order):
    keyed = ", ".join(f"{e} AS {n}" for n, e in {**keys, **values}.items())
    return (
        f"{name} AS (SELECT * FROM (SELECT {keyed}, row_number() OVER (PARTITION BY {', '.join(keys.values())} "
        f"ORDER BY {order} DESC) AS last_ FROM {{{source}}}) WHERE last_ = 1)"
    )


# The lookup steps in plain SQL: latest entry per key, then five left joins.
LADDER_SQL = f"""WITH {_last('al', {'auf': 'upper(trim(uf))', 'afrom': q.match_key('name_norm_from')}, {'ato': q.match_key('name_norm_to')}, 'alias_places', 'seq')},
{_last('ov', {'ouf': 'upper(trim(uf))', 'oname': 'trim(municipality_name_clean)'}, {'ocode': q.pad('ibge_municipality_code'), 'onote': 'note'}, 'override_places', 'seq')},
{_last('rc', {'ccode': 'ibge_municipality_code'}, {'cname': 'municipality_name_official'}, 'ref_places', 'ref_pos')},
{_last('re', {'euf': 'uf', 'ename': 'upper(trim(municipality_name_official))'}, {'ecode': 'ibge_municipality_code', 'eoff': 'municipality_name_official'}, 'ref_places', 'ref_pos')},
{_last('rn', {'nuf': 'uf', 'nname': 'municipality_name_norm'}, {'ncode': 'ibge_municipality_code', 'noff': 'municipality_name_official'}, 'ref_places', 'ref_pos')},
d AS (SELECT seq, upper(trim(uf)) AS uf, trim(municipality_name_clean) AS name, {q.match_key('municipality_name_clean')} AS raw FROM {{dirty_places}}),
m AS (SELECT d.*, coalesce(ato, raw) AS norm, ato FROM d LEFT JOIN al ON uf = auf AND raw = afrom),
r AS (SELECT m.*, ocode, onote, cname, ecode, eoff, ncode, noff FROM m
  LEFT JOIN ov ON uf = ouf AND name = oname LEFT JOIN rc ON ocode = ccode
  LEFT JOIN re ON uf = euf AND upper(name) = ename LEFT JOIN rn ON uf = nuf AND norm = nname),
answer AS (SELECT seq, uf, name AS municipality_name_clean, norm, ato IS NOT NULL AS alias_applied,
  coalesce(ocode, ecode, ncode) AS ibge_municipality_code,
  CASE WHEN ocode IS NOT NULL THEN 'override' WHEN ecode IS NOT NULL THEN 'exact' WHEN ncode IS NOT NULL THEN 'normalized_exact' ELSE 'unmatched' END AS match_method,
  CASE WHEN ocode IS NULL AND ecode IS NULL AND ncode IS NULL THEN 0.0 ELSE 1.0 END AS match_score,
  CASE WHEN ocode IS NOT NULL THEN cname WHEN ecode IS NOT NULL THEN eoff ELSE noff END AS matched_name_official,
  concat_ws('; ', CASE WHEN ato IS NOT NULL THEN 'alias_applied:' || raw || '->' || norm END,
    CASE WHEN ocode IS NOT NULL THEN CASE WHEN onote <> '' THEN 'override_applied:' || onote ELSE 'override_applied' END END) AS match_notes
  FROM r) """
_OUT = "seq, uf, municipality_name_clean, alias_applied, ibge_municipality_code, match_method, CAST(match_score AS DOUBLE) AS match_score, matched_name_official, match_notes"


@query("place_ladder_lookups", LADDER_SQL + f"SELECT {_OUT} FROM answer")
def _(t):
    rows, ref, extra = _inputs(t)
    return ladder.match_by_lookup(rows, ref, **extra)


@query(
    "alias_step",
    LADDER_SQL + "SELECT DISTINCT uf, municipality_name_clean, norm AS name_norm, alias_applied FROM answer",
)
def _(t):
    rows, _, extra = _inputs(t)
    out = ladder.apply_aliases(ladder.distinct_names(rows), extra["aliases"])
    return out.select(
        F.col("_uf").alias("uf"), F.col("_name").alias("municipality_name_clean"), "name_norm", "alias_applied"
    )


@query(
    "override_step",
    LADDER_SQL + "SELECT DISTINCT uf, name AS municipality_name_clean, ocode AS ov_code, cname AS ov_official FROM r WHERE ocode IS NOT NULL",
)
def _(t):
    rows, ref, extra = _inputs(t)
    out = ladder.apply_overrides(ladder.distinct_names(rows), ref, extra["overrides"])
    return out.where(F.col("ov_code").isNotNull()).select(
        F.col("_uf").alias("uf"), F.col("_name").alias("municipality_name_clean"), "ov_code", "ov_official"
    )


@query(
    "exact_and_normalised_steps",
    LADDER_SQL + "SELECT DISTINCT uf, name AS municipality_name_clean, ecode AS ex_code, eoff AS ex_official, ncode AS no_code, noff AS no_official FROM r",
)
def _(t):
    rows, ref, extra = _inputs(t)
    out = ladder.apply_exact(ladder.apply_aliases(ladder.distinct_names(rows), extra["aliases"]), ref)
    return out.select(
        F.col("_uf").alias("uf"), F.col("_name").alias("municipality_name_clean"),
        "ex_code", "ex_official", "no_code", "no_official",
    )


# Every part's free-text name beside its official name.
view(
    "name_pairs",
    """SELECT seq, municipality_name_clean AS dirty, p_name AS official FROM {dirty_places} JOIN {part} ON seq = p_partkey""",
)

# The weighted score in SQL for a table pairs(a, b).
SCORES = f"""tok AS (SELECT a, b, list_sort(string_split(a, ' ')) AS ta, list_sort(string_split(b, ' ')) AS tb FROM pairs),
sets AS (SELECT a, b, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb,
  array_to_string(list_sort(list_distinct(list_filter(ta, lambda x: list_contains(tb, x)))), ' ') AS sect,
  array_to_string(list_sort(list_distinct(list_filter(ta, lambda x: NOT list_contains(tb, x)))), ' ') AS da,
  array_to_string(list_sort(list_distinct(list_filter(tb, lambda x: NOT list_contains(ta, x)))), ' ') AS db,
  greatest(length(a), length(b)) * 1.0 / least(length(a), length(b)) AS spread FROM tok),
parts AS (SELECT a, b, 'plain' AS k, a AS x, b AS y FROM sets UNION ALL SELECT a, b, 'sorted', sa, sb FROM sets UNION ALL SELECT a, b, 'rest', da, db FROM sets),
far AS (SELECT p.* FROM parts p JOIN sets s ON p.a = s.a AND p.b = s.b WHERE spread >= 1.5 AND length(x) > 0 AND length(y) > 0),
oriented AS (SELECT a, b, k, x AS s, y AS l FROM far WHERE length(x) <= length(y) UNION ALL SELECT a, b, k, y, x FROM far WHERE length(y) <= length(x)),
windows AS (SELECT a, b, k, s, substr(l, greatest(1, e - length(s) + 1), least(e, length(l)) - greatest(1, e - length(s) + 1) + 1) AS w
  FROM (SELECT *, unnest(range(1, length(l) + length(s))) AS e FROM oriented)),
need AS (SELECT x, y FROM parts UNION SELECT s, w FROM windows),
common AS (SELECT x, y, CASE WHEN x = '' OR y = '' THEN 0 ELSE {q.lcs('x', 'y')} END AS c FROM need),
whole AS (SELECT p.a, p.b, k, length(p.x) AS nx, length(p.y) AS ny, c FROM parts p JOIN common m ON p.x = m.x AND p.y = m.y),
part_best AS (SELECT a, b, k, max(200.0 * c / (length(s) + length(w))) AS v FROM windows JOIN common m ON s = m.x AND w = m.y GROUP BY a, b, k),
flat AS (SELECT s.*, (SELECT 200.0 * c / (nx + ny) FROM whole w WHERE w.a = s.a AND w.b = s.b AND k = 'plain') AS plain,
  (SELECT 200.0 * c / (nx + ny) FROM whole w WHERE w.a = s.a AND w.b = s.b AND k = 'sorted') AS sorted_,
  (SELECT c FROM whole w WHERE w.a = s.a AND w.b = s.b AND k = 'rest') AS rest_c,
  (SELECT v FROM part_best w WHERE w.a = s.a AND w.b = s.b AND k = 'plain') AS part_plain,
  (SELECT max(v) FROM part_best w WHERE w.a = s.a AND w.b = s.b AND k <> 'plain') AS part_token,
  length(sect) AS n, CASE WHEN sect = '' THEN 0 ELSE 1 END AS g, length(da) AS na, length(db) AS nb FROM sets s),
scored AS (SELECT a, b, plain, spread, CASE WHEN n > 0 AND (na = 0 OR nb = 0) THEN 100.0 ELSE greatest(sorted_,
    100.0 - 100.0 * (na + nb - 2 * rest_c) / (n + g + na + n + g + nb),
    CASE WHEN n > 0 THEN 100.0 - 100.0 * (g + na) / (n + n + g + na) ELSE 0 END,
    CASE WHEN n > 0 THEN 100.0 - 100.0 * (g + nb) / (n + n + g + nb) ELSE 0 END) END AS token,
  part_plain, CASE WHEN n > 0 THEN 100.0 ELSE part_token END AS part_token FROM flat),
final AS (SELECT a, b, plain, CASE WHEN spread < 1.5 THEN greatest(plain, 0.95 * token)
  ELSE greatest(plain, CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END * part_plain, 0.95 * CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END * part_token) END AS weighted FROM scored) """


@query(
    "name_similarity",
    f"""WITH keyed AS (SELECT seq, {q.match_key('dirty')} AS a, {q.match_key('official')} AS b FROM {{name_pairs}}),
pairs AS (SELECT DISTINCT a, b FROM keyed), """ + SCORES + """SELECT seq, levenshtein(k.a, k.b) AS edit_distance, CAST(round(plain, 6) AS DOUBLE) AS ratio, CAST(round(weighted, 6) AS DOUBLE) AS weighted_ratio
  FROM keyed k JOIN final f ON k.a = f.a AND k.b = f.b""",
)
def _(t):
    keyed = t("name_pairs").select("seq", match_key("dirty").alias("a"), match_key("official").alias("b"))
    pairs = keyed.select("a", "b").distinct()
    scored = pairs.select(
        "a", "b", F.levenshtein("a", "b").cast("long").alias("edit_distance"),
        F.round(ratio_udf("a", "b"), 6).alias("ratio"),
        F.round(weighted_ratio_udf("a", "b"), 6).alias("weighted_ratio"),
    )
    return keyed.join(scored, ["a", "b"]).drop("a", "b")


# The fuzzy step in SQL: every open name against every reference name of its state.
FUZZY_SQL = LADDER_SQL.rstrip() + f""",
open_ AS (SELECT DISTINCT uf, norm FROM answer WHERE match_method = 'unmatched'),
pairs AS (SELECT DISTINCT norm AS a, municipality_name_norm AS b FROM open_ JOIN {{ref_places}} p USING (uf)),
{SCORES.rstrip()},
firsts AS (SELECT uf AS fuf, municipality_name_norm AS fname, arg_min(ibge_municipality_code, ref_pos) AS code, arg_min(municipality_name_official, ref_pos) AS official FROM {{ref_places}} GROUP BY 1, 2),
cand AS (SELECT * FROM (SELECT o.uf, o.norm AS name_norm, round(weighted, 6) AS score, ref_pos, b AS candidate, code, official,
    row_number() OVER (PARTITION BY o.uf, o.norm ORDER BY round(weighted, 6) DESC, ref_pos) AS rank
  FROM open_ o JOIN {{ref_places}} p ON p.uf = o.uf JOIN final ON a = o.norm AND b = municipality_name_norm JOIN firsts ON fuf = o.uf AND fname = b) WHERE rank <= 5),
best AS (SELECT uf, name_norm, max(score) FILTER (WHERE rank = 1) AS best_score, coalesce(max(score) FILTER (WHERE rank = 2), 0) AS second_score,
  max(candidate) FILTER (WHERE rank = 1) AS candidate, max(code) FILTER (WHERE rank = 1) AS code, max(official) FILTER (WHERE rank = 1) AS official FROM cand GROUP BY 1, 2),
ruled AS (SELECT *, round(best_score - second_score, 6) AS margin, levenshtein(name_norm, candidate) AS edit_distance, CASE WHEN best_score >= 92 THEN 'fuzzy_strict'
  WHEN best_score >= 85 AND best_score - second_score >= 10 AND levenshtein(name_norm, candidate) <= 2 THEN 'fuzzy_relaxed' ELSE 'manual_needed' END AS method FROM best),
noted AS (SELECT *, CASE method WHEN 'fuzzy_strict' THEN printf('fuzzy_strict:score=%.2f', best_score)
  WHEN 'fuzzy_relaxed' THEN printf('fuzzy_relaxed:score=%.2f,margin=%.2f,edit_distance=%d', best_score, margin, edit_distance)
  ELSE 'below_threshold_or_low_margin_or_edit_distance' END AS note FROM ruled) """


def _open_names(t):
    rows, ref, extra = _inputs(t)
    names = ladder.lookup_ladder(rows, ref, **extra).where(F.col("match_method").isNull())
    return names.select(F.col("_uf").alias("uf"), "name_norm"), ref


@query("fuzzy_top_candidates", FUZZY_SQL + "SELECT uf, name_norm, score, ref_pos, candidate, code, official, rank FROM cand")
def _(t):
    return ladder.fuzzy_candidates(*_open_names(t)).withColumn("score", F.round("score", 6))


@query(
    "fuzzy_margins",
    FUZZY_SQL + "SELECT uf, name_norm, best_score, second_score, margin, edit_distance, candidate, code, official, method AS match_method, note FROM noted",
)
def _(t):
    out = ladder.fuzzy_decisions(ladder.fuzzy_candidates(*_open_names(t)))
    rounded = {c: F.round(c, 6) for c in ("best_score", "second_score", "margin")}
    return out.withColumns({**rounded, "edit_distance": F.col("edit_distance").cast("long")})


@query(
    "manual_review_candidates",
    FUZZY_SQL + """SELECT seq, municipality_name_clean, w.uf, c.code AS suggested_ibge_code, c.official AS suggested_name_official, c.score, c.rank
  FROM answer w JOIN noted n ON w.uf = n.uf AND w.norm = n.name_norm JOIN cand c ON c.uf = n.uf AND c.name_norm = n.name_norm
  WHERE match_method = 'unmatched' AND method = 'manual_needed'""",
)
def _(t):
    rows, ref, extra = _inputs(t)
    return ladder.review_candidates(rows, ref, **extra).withColumn("score", F.round("score", 6))


WHOLE_SQL = FUZZY_SQL + """, laddered AS (SELECT seq, w.uf, municipality_name_clean, alias_applied,
  CASE WHEN match_method <> 'unmatched' THEN ibge_municipality_code WHEN method LIKE 'fuzzy%' THEN n.code END AS ibge_municipality_code,
  CASE WHEN match_method <> 'unmatched' THEN match_method ELSE coalesce(method, 'unmatched') END AS match_method,
  round(CASE WHEN match_method <> 'unmatched' THEN 1 ELSE coalesce(best_score / 100, 0) END, 6) AS match_score,
  CASE WHEN match_method <> 'unmatched' THEN matched_name_official WHEN method LIKE 'fuzzy%' THEN n.official END AS matched_name_official,
  CASE WHEN match_method <> 'unmatched' THEN match_notes WHEN method IS NULL THEN 'no_reference_for_uf'
    WHEN match_notes = '' THEN note ELSE match_notes || '; ' || note END AS match_notes
  FROM answer w LEFT JOIN noted n ON w.uf = n.uf AND w.norm = n.name_norm) """


@query("place_ladder_full", WHOLE_SQL + "SELECT * FROM laddered")
def _(t):
    rows, ref, extra = _inputs(t)
    return ladder.match_places(rows, ref, **extra).withColumn("match_score", F.round("match_score", 6))


_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE match_method = '{m}') AS BIGINT) AS {n}"
    for m, n in [("override", "matched_override"), ("exact", "matched_exact"), ("normalized_exact", "matched_normalized_exact"),
                 ("fuzzy_relaxed", "matched_fuzzy_relaxed"), ("manual_needed", "manual_needed"), ("unmatched", "unmatched")]
)


@query(
    "crosswalk_summary",
    WHOLE_SQL + f"""SELECT count(*) AS total_rows_input, {_COUNTS},
  count(*) FILTER (WHERE match_method LIKE 'fuzzy%') AS matched_fuzzy,
  count(*) FILTER (WHERE ibge_municipality_code IS NOT NULL AND match_notes LIKE '%alias_applied:%') AS matched_alias_applied,
  count(ibge_municipality_code) / greatest(count(*), 1) AS coverage_rate,
  count(DISTINCT (uf, municipality_name_clean)) AS unique_municipalities FROM laddered""",
)
def _(t):
    rows, ref, extra = _inputs(t)
    return profile.crosswalk_summary(ladder.match_places(rows, ref, **extra))


@query(
    "top_unmatched_names",
    WHOLE_SQL + """SELECT municipality_name_clean, uf, count(*) AS count FROM laddered WHERE match_method IN ('manual_needed', 'unmatched')
  GROUP BY 1, 2 ORDER BY count DESC, municipality_name_clean, uf LIMIT 30""",
)
def _(t):
    rows, ref, extra = _inputs(t)
    return profile.top_unmatched(ladder.match_places(rows, ref, **extra))


@query(
    "manual_gate",
    WHOLE_SQL + """SELECT 'manual_needed' AS gate, CAST(n AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS bound, n = 0 AS ok
  FROM (SELECT count(*) FILTER (WHERE match_method = 'manual_needed') AS n FROM laddered)""",
)
def _(t):
    rows, ref, extra = _inputs(t)
    return no_manual_gate(profile.crosswalk_summary(ladder.match_places(rows, ref, **extra)))
