import pytest
from pyspark.sql import functions as F

from civiclink.functions.similarity import weighted_ratio
from civiclink.functions.text import match_key
from civiclink.operators import ladder

ROW = "seq int, uf string, municipality_name_clean string"
ALIAS = "uf string, name_norm_from string, name_norm_to string, note string, seq int"
OVERRIDE = "uf string, municipality_name_clean string, ibge_municipality_code string, note string, seq int"


def reference(spark, rows):
    df = spark.createDataFrame(
        [(c, n, u, i) for i, (c, n, u) in enumerate(rows)],
        "ibge_municipality_code string, municipality_name_official string, uf string, ref_pos long",
    )
    return df.withColumn("municipality_name_norm", match_key("municipality_name_official"))


def rows(spark, *pairs):
    return spark.createDataFrame([(i, u, n) for i, (u, n) in enumerate(pairs)], ROW)


def solve(spark, names, ref, **kw):
    return ladder.match_places(rows(spark, *names), reference(spark, ref), **kw).orderBy("seq").collect()


def test_alias_leads_to_normalised_match(spark):
    aliases = spark.createDataFrame(
        [("TO", "X", "Y", "", 0), ("TO", "SAO VALERIO DA NATIVIDADE", "WRONG", "", 1),
         ("TO", "SAO VALERIO DA NATIVIDADE", "SAO VALERIO", "historic name", 2)], ALIAS)
    (r,) = solve(spark, [("TO", "Sao Valerio da Natividade")], [("1720499", "Sao Valerio", "TO")], aliases=aliases)
    assert (r.ibge_municipality_code, r.match_method, r.alias_applied) == ("1720499", "normalized_exact", True)
    assert r.match_notes == "alias_applied:SAO VALERIO DA NATIVIDADE->SAO VALERIO"


def test_override_beats_exact_and_keeps_unknown_code(spark):
    overrides = spark.createDataFrame(
        [("BA", "- Boninau", "2904001", "typo", 0), ("BA", "Boninal", "99", "", 1)], OVERRIDE)
    a, b = solve(
        spark, [("ba", " - Boninau"), ("BA", "Boninal")], [("2904001", "Boninal", "BA")], overrides=overrides)
    assert (a.match_method, a.match_score, a.matched_name_official) == ("override", 1.0, "Boninal")
    assert a.match_notes == "override_applied:typo"
    assert (b.ibge_municipality_code, b.matched_name_official, b.match_notes) == ("0000099", None, "override_applied")


def test_relaxed_fuzzy_rule(spark):
    (r,) = solve(
        spark, [("BA", "Boninla")], [("2904001", "Boninal", "BA"), ("2923100", "Olindina", "BA")], threshold=95.0)
    assert (r.match_method, r.ibge_municipality_code) == ("fuzzy_relaxed", "2904001")
    assert r.match_notes == "fuzzy_relaxed:score=85.71,margin=19.05,edit_distance=2"
    assert r.match_score == pytest.approx(6 / 7)


def test_alias_can_leave_exact_match_on_raw_name(spark):
    aliases = spark.createDataFrame([("SP", "SAO PAULO", "OUTRO NOME", "", 0)], ALIAS)
    (r,) = solve(spark, [("SP", "sao paulo")], [("1", "Sao Paulo", "SP")], aliases=aliases)
    assert (r.match_method, r.alias_applied, r.ibge_municipality_code) == ("exact", True, "0000001")


def test_missing_state_replaces_notes(spark):
    aliases = spark.createDataFrame([("ZZ", "ABC", "DEF", "", 0)], ALIAS)
    (r,) = solve(spark, [("ZZ", "Abc")], [("1", "Sao Paulo", "SP")], aliases=aliases)
    assert (r.match_method, r.match_notes, r.match_score, r.alias_applied) == (
        "unmatched", "no_reference_for_uf", 0.0, True)


def test_null_name_or_state_is_unmatched(spark):
    a, b, c = solve(spark, [("SP", None), (None, "Campinas"), ("SP", "")], [("1", "Campinas", "SP")])
    assert [x.match_method for x in (a, b, c)] == ["unmatched", "unmatched", "manual_needed"]


def test_duplicate_reference_names(spark):
    ref = [("1", "Bom Jesus", "PI"), ("2", "Bom Jesus", "PI"), ("3", "Outra", "PI")]
    exact, fuzzy = solve(spark, [("PI", "Bom Jesus"), ("PI", "Bom Jesuss")], ref)
    assert exact.ibge_municipality_code == "0000002"
    assert (fuzzy.match_method, fuzzy.ibge_municipality_code) == ("fuzzy_strict", "0000001")
    relaxed = solve(spark, [("PI", "Bom Jesuss")], ref, threshold=99.0)[0]
    assert relaxed.match_method == "manual_needed"


def test_candidates_equal_brute_force(spark):
    names = ["ALFA BETA", "ALFA GAMA", "BETA", "DELTA DO SUL", "DELTA DO NORTE", "GAMA", "GAMA", "ZETA BOA"]
    ref = reference(spark, [(str(i), n, "SP") for i, n in enumerate(names)])
    queries = ["ALFA BTEA", "DELTA", "GAMMA", "ZETA", "Q", "ALFA ALFA BETA"]
    asked = spark.createDataFrame([("SP", q) for q in queries], "uf string, name_norm string")
    got = {}
    for chunk in (2, 4096):
        old = ladder.BLOCK_NAMES, ladder.CELL_NAMES
        ladder.BLOCK_NAMES, ladder.CELL_NAMES = chunk, chunk
        try:
            found = ladder.fuzzy_candidates(asked, ref).collect()
        finally:
            ladder.BLOCK_NAMES, ladder.CELL_NAMES = old
        for r in found:
            got.setdefault((chunk, r.name_norm), []).append((r["rank"], r.ref_pos, round(r.score, 9)))
    for q in queries:
        best = sorted((-weighted_ratio(q, n), i) for i, n in enumerate(names))[:5]
        want = [(k, i, round(-s, 9)) for k, (s, i) in enumerate(best, 1)]
        assert sorted(got[2, q]) == sorted(got[4096, q]) == want


def test_review_rows_follow_input_rows(spark):
    src = rows(spark, ("PI", "Xyz"), ("PI", "Xyz"), ("PI", "Outra"))
    got = ladder.review_candidates(src, reference(spark, [("3", "Outra", "PI")]))
    assert sorted((r.seq, r["rank"], r.suggested_ibge_code) for r in got.collect()) == [
        (0, 1, "0000003"), (1, 1, "0000003")]
    assert got.where(F.col("seq") == 2).count() == 0
