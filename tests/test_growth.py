"""Steps whose cost must not grow faster than their input: what is evaluated, joined and shuffled how often."""

from datetime import date

from pyspark.sql import functions as F

from civiclink.functions import jsonx, text
from civiclink.operators import candidates, contracts, indices, namejoin, skew


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payload_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"decision_id": "d"}'), (2, None), (3, "[]"), (4, "{")], "k int, payload string")
    retry = contracts.retry_list(contracts.check(df, "DecisionOutcome"), ["k"])
    assert _plan(retry).lower().count("parse_json") + _plan(retry).count("parseJson") == 1
    reasons = {r.k: r.reasons for r in retry.collect()}
    assert reasons[2] == reasons[4] == "record:not_json" and reasons[3] == "record:not_an_object"
    assert reasons[1].startswith("case_id:missing,court:missing")


def test_finding_meets_two_cells(spark):
    f = spark.createDataFrame([(1, "p", "A", date(2024, 3, 1))], "finding_id int, ibge_municipality_code string, uf string, publication_date date")
    days = [date(2024, 2, 29), date(2024, 3, 1), date(2024, 4, 10), date(2024, 5, 29), date(2024, 5, 30)]
    d = spark.createDataFrame([(str(i), "p", "A", x) for i, x in enumerate(days)], "decision_id string, ibge_municipality_code string, uf string, decision_date date")
    pairs = candidates.pairs_in_window(f, d, 90)
    assert sorted(r.decision_id for r in pairs.collect()) == ["1", "2", "3"]
    seen = []
    whole, candidates.salted_join = candidates.salted_join, lambda left, right, *a, **k: seen.append(left.count()) or whole(left, right, *a, **k)
    try:
        candidates.pairs_in_window(f, d, 90)
    finally:
        candidates.salted_join = whole
    assert seen[0] <= 2


def _sides(spark):
    f = [(i, "p" if i % 3 else None, "A", date(2023, 11, 1 + i), ("low", "high", None)[i % 3]) for i in range(20)]
    d = [(str(i % 40), "p", "A", date(2023 + i % 2, 1 + i % 12, 20), ("adverse", "neutral", None)[i % 3], ("final", "appeal", None, "other")[i % 4]) for i in range(60)]
    return (
        spark.createDataFrame(f, "finding_id int, ibge_municipality_code string, uf string, publication_date date, severity_level string"),
        spark.createDataFrame(d, "decision_id string, ibge_municipality_code string, uf string, decision_date date, outcome_label string, legal_stage string"),
    )


def _join_outputs(df):
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    return [side.output().mkString(" ") for side in (plan.left(), plan.right())]


def test_sides_are_paired_without_texts_and_buckets(spark):
    f, d = _sides(spark)
    want = indices.enforcement_indices(candidates.pairs_in_window(f, d, 90))
    got = indices.enforcement_indices(candidates.pairs_in_window(indices.weighed(f), indices.weighed(d), 90))
    assert got.columns == want.columns and got.count() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    left, right = _join_outputs(got)
    assert "severity_level" not in left and "adverse" in right
    assert not any(c in right for c in ("outcome_label", "legal_stage", "_bucket"))


def test_panel_works_out_outcomes_once(spark):
    outcomes = spark.range(12).groupBy(F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("ibge_municipality_code"), (F.col("id") % 3 + 2001).cast("int").alias("year"))
    exposure = spark.createDataFrame([("p0", 2000)], "ibge_municipality_code string, first_exposure int")
    places = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "ibge_municipality_code string")
    out = indices.panel(places, exposure, outcomes.agg(F.count(F.lit(1)).alias("n")))
    assert "Range (" not in _plan(out)
    rows = {(r.ibge_municipality_code, r.year): (r.n, r.event_time) for r in out.collect()}
    assert len(rows) == 12 and rows["p0", 2000] == (0, 0) and rows["p1", 2002] == (2, None) and rows["p2", 2003] == (0, None)


def test_worked_out_keys_join_like_columns(spark):
    left = spark.createDataFrame([(i, f"k{i % 3}" if i % 7 else None, i % 5) for i in range(40)], "i int, k string, b int")
    right = spark.createDataFrame([(f"k{n % 3}" if n % 5 else None, n) for n in range(30)], "k string, r int")
    for how in ("inner", "left"):
        want = left.join(right.withColumn("b", F.col("r") % 4), ["k", "b"], how)
        for hot in ([], [("k1", 1)]):
            got = skew.salted_join(left, right, ["k", "b"], F.col("i"), how, hot_left=hot, right_keys={"b": F.col("r") % 4})
            assert sorted(got.columns) == sorted(want.columns)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_positions_drop_no_pair(spark):
    words = [list(w) for w in ("abcde", "abcdf", "bcdef", "ab", "abc", "a", "vwxyz", "vwxab", "cdefg")]
    sets = spark.createDataFrame([(" ".join(w), w) for w in words], "key string, words array<string>")
    for limit in (0.3, 0.5, 0.6, 0.8, 1.0):
        found = {(r.left_key, r.right_key, r.shared) for r in namejoin.similar_sets(sets, sets, limit).collect()}
        plain = {(" ".join(x), " ".join(y), len({*x} & {*y})) for x in words for y in words if len({*x} & {*y}) >= limit * len({*x} | {*y}) - 1e-9}
        assert found == plain


def test_name_lists_with_nulls_and_repeats(spark):
    kind = "k int, names array<string>"
    f = spark.createDataFrame([(1, ["Casa Azul LTDA"]), (2, None), (3, [None, ""]), (1, ["Casa Azul LTDA"])], kind)
    d = spark.createDataFrame([(1, ["azul casa", None, "AZUL  CASA"]), (2, []), (3, None)], kind)
    x, y = namejoin.with_similar_names(f, d, 0.5)
    assert sorted((r.k, r.names) for r in x.collect()) == [(1, ["AZUL CASA"]), (1, ["AZUL CASA"]), (2, []), (3, [])]
    assert sorted((r.k, r.names) for r in y.collect()) == [(1, ["AZUL CASA"]), (2, []), (3, [])]
    # Words are taken from the stored distinct lists, not from the rows.
    assert "regexp_replace" not in _plan(y)


def test_rare_forms_are_found_by_spans(spark):
    odd = "ﬁ Ⅷ ½ ㌔ 한글 ﷺ ä́ x Ω é"
    rows = spark.createDataFrame([(odd,), ("plain",), (None,)], "t string").select(text.fold_accents("t").alias("f"))
    longer = text._fold_rules()[2]
    assert f"[{''.join(longer)}]" not in _plan(rows)
    got = [r.f for r in rows.collect()]
    import unicodedata

    assert got[1:] == ["plain", ""]
    assert got[0] == "".join(c for c in unicodedata.normalize("NFKD", odd) if not unicodedata.combining(c))
    every = "".join(longer)
    whole = spark.range(1).select(text.fold_accents(F.lit(every)).alias("f")).first().f
    assert whole == "".join(c for c in unicodedata.normalize("NFKD", every) if not unicodedata.combining(c))


def test_kind_is_read_from_the_outermost_level(spark):
    texts = ["{}", '{"a": {"b": [1]}}', "[]", "[{}]", "null", '"x"', "1", "true", "2.5", "{", None]
    v = F.try_parse_json("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsonx.is_object(v).alias("o"), jsonx.is_array(v).alias("a"))
    assert "schema" not in _plan(rows).lower()
    for r in rows.collect():
        known = r.t not in ("{", None)
        assert (r.o, r.a) == ((r.t.startswith("{"), r.t.startswith("[")) if known else (None, None))
