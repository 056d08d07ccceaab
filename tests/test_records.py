import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from civiclink.operators import candidates, chunk, contracts, evaluate, indices
from civiclink.sources import csv_files, landed, provenance, tables

SPAN = {"source_doc_id": "d", "quote": "q"}
CARD = {
    "finding_id": "f", "audit_report_id": "r", "municipality": "m", "state": "CE", "finding_type": "t", "severity_level": "high",
    "summary": "s", "amount_brl": 10.5, "confidence": 0.9, "evidence": [SPAN]}
SCORE = {"finding_id": "f", "decision_id": "d", "score": 0.8, "label": "probable", "rationale": "r", "evidence": [SPAN]}
OUTCOME = {"decision_id": "d", "case_id": "c", "court": "STJ", "decision_date": "2020-01-01", "outcome_label": "adverse",
           "outcome_summary": "s", "confidence": 1, "evidence": []}
WITHOUT = object()


def changed(record, **fields):
    return json.dumps({k: v for k, v in {**record, **fields}.items() if v is not WITHOUT})


CASES = [
    ("EvidenceSpan", changed(SPAN, page=3, start_char=1.0, end_char="7"), []),
    ("EvidenceSpan", changed(SPAN, quote=""), ["quote:too_short"]),
    ("EvidenceSpan", changed(SPAN, page=3_000_000_000, start_char=-(2**40)), []),
    ("EvidenceSpan", changed(SPAN, page="NaN", end_char="Infinity"), ["page:type", "end_char:type"]),
    ("EvidenceSpan", changed(SPAN, page=1e30), ["page:type"]),
    ("EvidenceSpan", changed(SPAN, source_doc_id=5, page=1.5), ["source_doc_id:type", "page:type"]),
    ("AuditFindingCard", changed(CARD), []),
    ("AuditFindingCard", changed(CARD, evidence=WITHOUT, amount_brl=None), []),
    ("AuditFindingCard", changed(CARD, severity_level="severe", confidence=1.2), ["severity_level:not_allowed", "confidence:out_of_range"]),
    ("AuditFindingCard", changed(CARD, municipality=None, state=WITHOUT), ["municipality:missing", "state:missing"]),
    ("AuditFindingCard", changed(CARD, amount_brl="x", evidence=None), ["amount_brl:type", "evidence:type"]),
    ("AuditFindingCard", changed(CARD, evidence=[SPAN, {"quote": "q"}]), ["evidence:invalid_span"]),
    ("AuditFindingCard", changed(CARD, evidence=["q"]), ["evidence:invalid_span"]),
    ("MatchScore", changed(SCORE), []),
    ("MatchScore", changed(SCORE, score="0.5"), []),
    ("MatchScore", changed(SCORE, score=-0.1, label="maybe"), ["score:out_of_range", "label:not_allowed"]),
    ("MatchScore", changed(SCORE, score=None), ["score:missing"]),
    ("DecisionOutcome", changed(OUTCOME), []),
    ("DecisionOutcome", changed(OUTCOME, outcome_label="x", confidence=[]), ["outcome_label:not_allowed", "confidence:type"]),
    ("DecisionOutcome", "{broken", ["record:not_json"]),
    ("DecisionOutcome", "[1]", ["record:not_an_object"]),
]


@pytest.mark.parametrize("contract", list(contracts.CONTRACTS))
def test_contract_rules(spark, contract):
    cases = [(i, p, w) for i, (c, p, w) in enumerate(CASES) if c == contract]
    df = spark.createDataFrame([(i, p) for i, p, _ in cases], "i int, payload string")
    checked = contracts.check(df, contract)
    got = {r.i: list(r._errors) for r in checked.collect()}
    assert got == {i: w for i, _, w in cases}
    assert contracts.valid_records(checked, contract, ["i"]).count() == sum(not w for _, _, w in cases)
    log = contracts.quarantine(checked, "mod", "v1", "model", ["i"])
    assert log.count() == sum(len(w) for _, _, w in cases)


def test_typed_record_and_softening(spark):
    df = spark.createDataFrame([(changed(CARD, confidence=0.2, evidence=[{**SPAN, "page": "4"}]),)], "payload string")
    r = contracts.soften(contracts.valid_records(contracts.check(df, "AuditFindingCard"), "AuditFindingCard", []), ["summary"]).first()
    assert r.summary is None and r.abstained and r.amount_brl == 10.5
    assert (r.evidence[0].page, r.evidence[0].chunk_id, r.evidence[0].quote) == (4, None, "q")


# --- sources

CSV = "Id da Tarefa{s}UF{s}Município{s}Data de Publicação{s}Título do Relatório\n1001{s}CE{s}Itapajé{s}06/03/2026{s}\"Relat{s}ório \\\"A\\\"\"\n1002{s}SP{s}NA\n1003{s}a{s}b{s}c{s}d{s}e\n0034{s}RJ{s}None{s}{s}x\n"


@pytest.mark.parametrize("sep, encoding", [(";", "utf-8"), (",", "utf-8"), ("\t", "utf-8"), ("|", "utf-8"), (";", "utf-8-sig"), (";", "latin-1")])
def test_csv_dialects(spark, tmp_path, sep, encoding):
    path = tmp_path / "a.csv"
    path.write_bytes(CSV.replace("{s}", sep).encode(encoding))
    df, dialect = csv_files.read_csv(spark, str(path))
    assert dialect.delimiter == sep and dialect.encoding == ("ISO-8859-1" if encoding == "latin-1" else "UTF-8")
    got = [tuple(r) for r in df.collect()]
    assert df.columns[0] == "Id da Tarefa" and df.columns[2] == "Município"
    assert got == [
        ("1001", "CE", "Itapajé", "06/03/2026", f"Relat{sep}ório \"A\""), ("1002", "SP", None, None, None), ("0034", "RJ", None, None, "x")]


def test_csv_line_break_in_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a;b\n1;"x\ny"\n2;z\n', encoding="utf-8")
    df, dialect = csv_files.read_csv(spark, str(path))
    assert dialect.multiline and [r.b for r in df.collect()] == ["x\ny", "z"]


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;uf\n1;SP\n2;BA\n")
    (tmp_path / "b.csv").write_text("uf;id\nCE;3\n")
    (tmp_path / "c.csv").write_text("id;uf;nota\n4;RJ;x\n")
    (tmp_path / "d.csv").write_text("id;uf\n5;MG\n")
    (tmp_path / "e.csv").write_text('id;uf\n6;"A\nB"\n')
    df, dialect = csv_files.read_csv(spark, str(tmp_path))
    assert sorted((len(h), m, len(files)) for h, m, files in dialect.groups) == [(2, False, 1), (2, False, 2), (2, True, 1), (3, False, 1)]
    assert sorted(tuple(r) for r in df.select("id", "uf", F.coalesce("nota", F.lit("-"))).collect()) == [
        ("1", "SP", "-"), ("2", "BA", "-"), ("3", "CE", "-"), ("4", "RJ", "x"), ("5", "MG", "-"), ("6", "A\nB", "-")]


def test_curated_tables(spark, tmp_path):
    assert csv_files.read_aliases(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "ov.csv").write_text("uf,municipality_name_clean,ibge_municipality_code\n ba , - Boninau ,42\n")
    r = csv_files.read_overrides(spark, str(tmp_path / "ov.csv")).first()
    assert (r.uf, r.municipality_name_clean, r.ibge_municipality_code, r.note) == ("BA", "- Boninau", "0000042", "")
    tables.seed_if_missing(spark, str(tmp_path / "al"), str(tmp_path / "ov.csv"))
    assert csv_files.read_aliases(spark, str(tmp_path / "al")).first().name_norm_to == "SAO VALERIO"


def test_place_reference(spark):
    payload = json.dumps([
        {"id": 4100001, "nome": "Serra Alta", "microrregiao": None},
        {"id": 4200002, "nome": "Vila Nova", "microrregiao": {"mesorregiao": {"UF": {"sigla": "RS"}}}},
        {"id": 4200002, "nome": "Vila Outra", "UF": {"sigla": "RS"}},
        {"id": None, "nome": "Lagoa", "UF": {"sigla": "RS"}}, {"nome": "Lagoa", "UF": {"sigla": "RS"}},
        {"id": 12, "nome": " ", "UF": {"sigla": "RS"}}, {"id": 13, "nome": "Água", "uf": {"sigla": " ba "}}, 7, None,
        {"id": 14, "nome": "N", "UF": {"sigla": 12}, "siglaUF": "mg"}])
    items = landed.place_items(spark.createDataFrame([(0, payload), (1, "[")], "seq int, payload string"))
    ref = landed.place_reference(items, "src", "t")
    assert [tuple(r) for r in ref.select("ibge_municipality_code", "municipality_name_official", "uf", "municipality_name_norm").orderBy("ibge_municipality_code").collect()] == [
        ("0000013", "Água", "BA", "AGUA"), ("0000014", "N", "MG", "N"), ("4200002", "Vila Nova", "RS", "VILA NOVA")]
    s = landed.reference_stats(items, ref).first()
    assert (s.total_records, s.parsed_ok, s.skipped_missing_uf, s.rejected_id) == (10, 3, 3, 2)


def test_checksums_and_reports(spark, tmp_path):
    import hashlib

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    facts = provenance.file_facts(spark, str(tmp_path / "f"))
    r = facts.first()
    assert (r.sha256, r.size_bytes) == (hashlib.sha256(b"abc").hexdigest(), 3)
    large = provenance.file_facts(spark, str(tmp_path / "f"), largest=2).first()
    assert (large.sha256, large.size_bytes) == (None, 3)
    out = tables.write_report(spark.createDataFrame([(1, None)], "n int, s string"), str(tmp_path / "r"), "run")
    assert [spark.read.text(p).first().value for p in out] == ['{"n":1,"s":null}'] * 2
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "no")])


def test_first_date_behind_other_texts_fixes_the_form(spark):
    from civiclink.operators import audits

    for texts, want in [
        (["", "-", "n/d", "2026-03-06", "2026-03-07", "08/03/2026"], [None, None, None, "2026-03-06 00:00:00", "2026-03-07 00:00:00", None]),
        (["2026-13-45", "06/03/2026"], [None, "2026-03-06 00:00:00"]),
        (["2026-03-06 10:00", "2026-03-07 11:30"], ["2026-03-06 10:00:00", "2026-03-07 11:30:00"]),
        (["2026-03-06T10:00:01.25", "2026-03-07T11:30:02.123456"], ["2026-03-06 10:00:01", "2026-03-07 11:30:02"]),
        (["2026-03-06T10:00:01-03:00", "2026-03-07T11:30:02Z"], ["2026-03-06 13:00:01", "2026-03-07 11:30:02"]),
        (["2026-03-06 10:00:01.5+0200"], ["2026-03-06 08:00:01"]),
    ]:
        raw = spark.createDataFrame(list(enumerate(texts)), "seq int, DataPublicacao string")
        out, _ = audits.prepare_audits(raw, "t", order="seq")
        got = out.orderBy("seq").select(F.date_format("publication_date", "yyyy-MM-dd HH:mm:ss")).collect()
        assert [r[0] for r in got] == want


def test_files_above_a_cell_have_checksums(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(provenance, "LARGEST", 4)
    data = {"a b%.bin": b"abc", "c.bin": b"x" * 100, "d é%20.gz": b"not packed" * 9, "e.bin": b"y" * 100}
    (tmp_path / "f").mkdir()
    for name, content in data.items():
        (tmp_path / "f" / name).write_bytes(content)
    facts = provenance.file_facts(spark, str(tmp_path / "f"))
    assert sorted((r.sha256, r.size_bytes) for r in facts.collect()) == sorted((hashlib.sha256(x).hexdigest(), len(x)) for x in data.values())
    wanted = facts.select(F.lit("i").alias("item_type"), F.lit("u").alias("source_url"), "local_path", F.lit("ok").alias("status"), F.lit("").alias("notes"))
    left = provenance.file_facts(spark, str(tmp_path / "f"), largest=4)
    assert sum(r.sha256 is None for r in provenance.manifest_rows(wanted, left, "t").collect()) == 3


def test_fallback_and_reuse(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert tables.write_with_fallback(df, str(tmp_path / "a.parquet")).endswith("a.parquet")
    odd = df.withColumn("i", F.expr("make_interval(1)"))
    assert tables.write_with_fallback(odd, str(tmp_path / "b.parquet")).endswith("b.csv")
    nested = df.withColumn("i", F.array(F.struct(F.lit(None).alias("x"))))
    assert tables.write_with_fallback(nested, str(tmp_path / "n.parquet")).endswith("n.csv")
    failing = df.withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        tables.write_with_fallback(failing, str(tmp_path / "f.parquet"))
    assert not tables.exists(spark, str(tmp_path / "f.csv"))
    calls = []
    build = lambda: calls.append(1) or df
    total = lambda t: t.agg(F.sum("a").alias("s"))
    for force, reused in ((False, False), (False, True), (True, False)):
        stored, summary, again = tables.reuse_or_build(spark, str(tmp_path / "c"), build, total, force)
        assert summary.first().s == 1 and again is reused
    assert len(calls) == 2


# --- chunks, links, evaluation

def test_chunks_by_window_and_heading(spark):
    plain = "\n".join(["p0", "", "p1", "p2", "p3", "p4", "p5\fx", "p6"])
    headed = "intro\nCAPÍTULO I\ntexto\n1.2. Achado\nmais"
    docs = spark.createDataFrame([(1, plain), (2, headed), (3, "")], "doc_id int, text string")
    got = chunk.chunk_documents(docs, "doc_id", window=3, overlap=1).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_text) for r in got] == [
        (1, "p0\n\np1\np2"), (1, "p2\np3\np4"), (1, "p4\np5\fx\np6"), (2, "intro"), (2, "CAPÍTULO I\ntexto"), (2, "1.2. Achado\nmais"), (3, "")]
    text = {1: plain, 2: headed, 3: ""}
    assert all(text[r.doc_id][r.start_char:r.end_char] == r.chunk_text for r in got)
    assert (got[2].page_start, got[2].page_end, got[3].chunk_rule) == (1, 2, "heading")


def pair_sides(spark):
    day = dt.date
    findings = spark.createDataFrame(
        [(1, "m", "SP", day(2020, 1, 1), ["A"], ["k"]), (2, "m", "RJ", day(2020, 3, 1), [], ["k"]), (3, "n", "SP", day(1969, 12, 1), [], [])],
        "finding_id int, ibge_municipality_code string, uf string, publication_date date, names array<string>, keywords array<string>")
    decisions = spark.createDataFrame(
        [("d1", "m", "SP", day(2019, 12, 31), [], [], "state"), ("d2", "m", "SP", day(2020, 1, 1), ["A"], ["k"], "state"),
         ("d3", "m", "SP", day(2020, 3, 30), ["B"], ["k"], "state"), ("d4", "m", "SP", day(2020, 3, 31), [], [], "federal"), ("d5", "n", "SP", day(1970, 1, 2), [], [], "state")],
        "decision_id string, ibge_municipality_code string, uf string, decision_date date, names array<string>, keywords array<string>, court_level string")
    return findings, decisions


@pytest.mark.parametrize("skewed", [{}, {"hot_left": [("m", 832)], "hot_right": [("m", 832)], "salts": 4}])
def test_candidate_pairs(spark, skewed):
    pairs = candidates.candidate_pairs(*pair_sides(spark), window_days=90, **skewed).collect()
    got = {(r.finding_id, r.decision_id): (r.days_after, r.shared_names, r.shared_keywords, r.jurisdiction_ok) for r in pairs}
    assert len(pairs) == len(got)
    assert got == {(1, "d2"): (0, 1, 1, True), (1, "d3"): (89, 0, 1, True), (2, "d3"): (29, 0, 1, False), (2, "d4"): (30, 0, 0, True), (3, "d5"): (32, 0, 0, True)}


def test_ranked_pairs_lose_nothing(spark):
    pairs = candidates.candidate_pairs(*pair_sides(spark), window_days=90)
    ranked = candidates.ranked_pairs(pairs.unionByName(pairs.where("decision_id = 'd2'")), 1)
    assert sorted(r.decision_id for r in ranked.where("kept").collect()) == ["d2", "d4", "d5"]
    assert sorted(r.decision_id for r in ranked.where("not kept").collect()) == ["d2", "d3", "d3"]


def test_long_tail_pairs(spark):
    pairs = candidates.candidate_pairs(*pair_sides(spark), window_days=30, horizon_days=100)
    assert {(r.finding_id, r.decision_id): r.temporal_class for r in pairs.collect()} == {
        (1, "d2"): "default", (1, "d3"): "long_tail", (1, "d4"): "long_tail", (2, "d3"): "default", (2, "d4"): "long_tail", (3, "d5"): "long_tail"}


def test_bands_and_graph(spark):
    rows = [(0.9, True, True, "high"), (0.9, False, True, "medium"), (0.9, True, False, "medium"), (0.7, True, False, "low"), (0.65, True, True, "medium"), (0.64, True, True, "low")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, score double, core_evidence boolean, jurisdiction_ok boolean, want string")
    assert all(r.band == r.want for r in candidates.graded_links(df).collect())
    links = spark.createDataFrame(
        [(1, "a", 0.9, "high", "adverse"), (1, "a", 0.2, "low", "neutral"), (1, "b", 0.3, "low", "neutral"), (2, "a", 0.0, "low", "adverse")],
        "finding_id int, decision_id string, score double, band string, outcome_label string")
    got = {r.finding_id: r for r in candidates.finding_summary(candidates.link_edges(links)).collect()}
    assert (got[1].best_decision_id, got[1].links, got[1].conflicting_outcomes) == ("a", 2, True)
    assert got[1].weighted_adverse == pytest.approx(0.75) and got[2].weighted_adverse == 0.0
    assert candidates.without_exclusions(links, links.where("decision_id = 'b'")).count() == 3
    tied = spark.createDataFrame([(1, "a", 0.5, "low", "neutral"), (1, "a", 0.5, "medium", "adverse"), (1, "a", 0.5, "medium", "unknown")], links.schema)
    for df in (tied, tied.orderBy("outcome_label"), tied.orderBy(F.desc("outcome_label"))):
        assert [tuple(r) for r in candidates.link_edges(df).collect()] == [(1, "a", 0.5, "medium", "unknown")]


def test_indices_and_panel(spark):
    day = dt.date
    links = spark.createDataFrame(
        [(1, "m", day(2018, 1, 1), "high", "d1", day(2020, 1, 1), "adverse", "final", 0.9), (1, "m", day(2018, 1, 1), "high", "d2", day(2020, 6, 1), "neutral", "appeal", 0.7),
         (2, "m", day(2010, 1, 1), "low", "d3", day(2020, 1, 1), "adverse", "first_instance", 0.1), (3, "m", day(2019, 1, 1), "low", "d4", day(2020, 1, 1), "unknown", "final", 0.9)],
        "finding_id int, ibge_municipality_code string, publication_date date, severity_level string, decision_id string, decision_date date, outcome_label string, legal_stage string, score double")
    r = indices.enforcement_indices(links, years=3).first()
    assert (r.links, r.adverse_count, r.any_punishment, r.severity_weighted, r.days_to_first_adverse) == (4, 2, 1, 4.0, 730)
    assert r.p_punished_given_linked == pytest.approx(2 / 3) and r.enforcement_intensity == pytest.approx(3.375)
    cut = {x.cutoff: x.adverse_count for x in indices.indices_by_cutoff(links).collect()}
    assert cut == {"strict": 1, "medium": 1, "permissive": 2}
    b = indices.outcome_bounds(links).first()
    assert (b.lower_bound, b.adverse_medium, b.upper_bound) == (1, 1, 2)
    places = spark.createDataFrame([("m",), ("n",)], "ibge_municipality_code string")
    rows = indices.panel(places, indices.first_exposure(links), indices.outcome_bounds(links).select("ibge_municipality_code", "year", "upper_bound"))
    got = {(x.ibge_municipality_code, x.year): x for x in rows.collect()}
    assert len(got) == 22 and got["m", 2020].upper_bound == 2 and got["m", 2010].event_bin == 0 and got["m", 2020].event_bin == 3
    assert not got["n", 2020].exposed and got["n", 2020].event_time is None


def test_evaluation(spark):
    df = spark.createDataFrame([("q", 0.9, True, 1, 1), ("q", 0.8, False, 1, 0), ("q", 0.8, True, 0, 0), ("r", 0.1, False, 0, 1)], "q string, s double, t boolean, g int, p int")
    points = [tuple(r)[:4] for r in evaluate.curve_points(df, "s", "t").orderBy(F.desc("threshold")).collect()]
    assert points == [(0.9, 1, 0, 0.5), (0.8, 2, 1, 1.0), (0.1, 2, 2, 1.0)]
    r = evaluate.ranking_scores(df, "q", "s", "t", "g", 2).first()
    assert (r.queries, r.precision_at_k, r.recall_at_k) == (1, 1.0, 1.0)
    one = {x.label: x for x in evaluate.label_scores(df, "g", "p").collect()}[1]
    assert (one.true_positive, one.false_positive, one.false_negative, one.f1) == (1, 1, 1, 0.5)
    given = evaluate.abstention(df.withColumns({"no": F.col("s") < 0.5, "ok": F.col("g") == F.col("p")}), "no", "ok").first()
    assert (given.n, given.abstained, given.correct, given.abstention_rate, given.recall) == (4, 1, 2, 0.25, 0.5)
    a = evaluate.agreement(df, "g", "p").first()
    assert (a.items, a.observed, a.expected, a.kappa) == (4, 0.5, 0.5, 0.0)
    spans = spark.createDataFrame([(0, 10, 5, 20), (0, 2, 3, 4)], "a int, b int, c int, d int")
    assert [x.o for x in spans.select(evaluate.span_overlap("a", "b", "c", "d").alias("o")).collect()] == [0.25, 0.0]
