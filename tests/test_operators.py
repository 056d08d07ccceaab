import datetime as dt

import pytest
from pyspark.sql import functions as F

from civiclink.operators import audits, fetchlog, gates, headers, link, manifest, profile, rows, skew


def ints(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


# --- rows and skew

def test_keep_first_and_last_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, s int, v string")
    assert sorted(r.v for r in rows.keep_first(df, "k", "s").collect()) == ["y", "z"]
    assert sorted(r.v for r in rows.keep_last(df, "k", "s").collect()) == ["w", "x"]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_row_numbers_and_prefix_sums(spark, ranges):
    df = ints(spark, [7, 3, 100, 1, 55, 8, -4, 60])
    got = rows.number_rows(df, "v", "n", ranges=ranges).orderBy("v").collect()
    assert [r.n for r in got] == list(range(1, 9))
    down = rows.prefix_sums(df.withColumn("x", F.col("v") + 10), "v", {"c": "x"}, descending=True, ranges=ranges)
    assert [r.c for r in down.orderBy(F.desc("v")).collect()] == [110, 180, 245, 263, 280, 293, 304, 310]


def test_scanned_row_numbers_follow_files_by_name(spark, tmp_path):
    sizes = {"c": 300, "a": 5, "b": 4000, "d": 40}
    for f, n in sizes.items():
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}{i:05d}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = rows.number_scanned_rows(spark.read.text(str(tmp_path)), "n").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.n for r in got] == list(range(1, sum(sizes.values()) + 1))
    assert [r.value for r in got] == sorted(r.value for r in got)


@pytest.mark.parametrize("values, want", [([5], 5), ([1, 9], 5), ([2, 2, 2, 9], 2), ([4, 1, 3], 3), ([1, 2, 3, 10], 2.5), ([], None)])
def test_exact_median(spark, values, want):
    assert rows.exact_median(ints(spark, values), "v", ranges=4).first().median == want


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("right_hot", ["hot", "k1", "only_right"])
def test_salted_join_equals_plain_join(spark, how, right_hot):
    left = spark.createDataFrame([(i, "hot" if i < 80 else f"k{i % 7}" if i < 95 else None) for i in range(100)], "i int, k string")
    many = [(right_hot, n) for n in range(40)]
    right = spark.createDataFrame([*many, ("k3", 3), ("k4", 4), (None, 4)], "k string, r int")
    got = skew.salted_join(left, right, ["k"], F.col("i"), how, hot_left=[("hot",)], hot_right=[(right_hot,)], salts=5)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.select("i", "k", "r").collect())) == sorted(map(str, want.select("i", "k", "r").collect()))
    plain = skew.salted_join(left, right, ["k"], F.col("i"), how)
    assert sorted(map(str, plain.select("i", "k", "r").collect())) == sorted(map(str, want.select("i", "k", "r").collect()))


def test_named_hot_key_without_a_match_keeps_its_left_rows(spark):
    left = spark.createDataFrame([(i, "hot" if i < 80 else None if i > 95 else "x") for i in range(100)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("y", 2)], "k string, r int")
    got = skew.salted_join(left, right, ["k"], F.col("i"), "left", hot_left=[("hot",)], hot_right=[("x",), ("hot",)], salts=5)
    assert got.count() == 100 and got.where("r = 1").count() == 80


def test_a_key_of_few_rows_in_a_hundred_is_split(spark, tmp_path):
    """One key has 0.4 % of the rows and still is too large for a task: it is split at run time."""
    n = 100_000
    key = F.when(F.col("id") % 250 == 0, F.lit(-1)).otherwise(F.col("id"))
    names = spark.range(n).select("id", F.concat(F.lit("k"), key.cast("string")).alias("_name"), F.lit("SP").alias("uf"))
    names.select("id", "uf", F.col("_name").alias("municipality_name_clean")).repartition(6).write.parquet(str(tmp_path / "rows"))
    names.select("_name", F.lit("SP").alias("_uf"), F.lit("1").alias("ibge_municipality_code")).distinct().write.parquet(str(tmp_path / "names"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "500",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.read.parquet(str(tmp_path / "rows")).withColumnsRenamed({"uf": "_uf", "municipality_name_clean": "_name"})
        out = skew.salted_join(left, spark.read.parquet(str(tmp_path / "names")), ["_uf", "_name"], F.lit(1), "left")
        counted = out.agg(F.count("ibge_municipality_code"), F.countDistinct("id"))
        assert tuple(counted.collect()[0]) == (n, n)
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_samples(spark):
    df = ints(spark, range(50))
    first = [r.v for r in rows.seeded_sample(df, ["v"], 5, 1).collect()]
    assert first == [r.v for r in rows.seeded_sample(df.repartition(3), ["v"], 5, 1).collect()]
    assert first != [r.v for r in rows.seeded_sample(df, ["v"], 5, 2).collect()]
    assert rows.sample_or_all(df, ["v"], 0, 1).count() == 50
    strata = df.withColumn("s", F.col("v") % 3)
    assert {r.s: r["count"] for r in rows.stratified_sample(strata, ["s"], ["v"], 4, 1).groupBy("s").count().collect()} == {0: 4, 1: 4, 2: 4}


# --- headers and audits

def test_header_rules(spark):
    assert headers.folded_header("Edição Programa Sorteio / FEF") == "edicao_programa_sorteio_fef"
    assert headers.folded_header(" - Título  (1º)") == "titulo_1o"
    assert headers.folded_header("Straße nº") == "strasse_no"
    assert headers.ascii_header("Edição / FEF") == "edi_o_fef"
    df = spark.createDataFrame([], "ufs string, municipios string, datapublicacao string, idtarefa string")
    assert headers.find_column(df, ["uf", "UFs"]) == "ufs"
    assert headers.find_column(df, ["nada"]) is None
    assert headers.need_column(df, ["município", "Municipios"]) == "municipios"
    with pytest.raises(KeyError):
        headers.need_column(df, ["nada"])
    with pytest.raises(ValueError, match="b"):
        headers.resolve_required(df, {"a": ["ufs"], "b": ["nada"]})


def test_prepare_audits(spark):
    raw = spark.createDataFrame(
        [("123", "Relatório Teste", "06/03/2026", " ce ", " São  João d'Aliança ", "SORTEIO 10")],
        ["IdTarefa", "Titulo", "DataPublicacao", "UFs", "Municipios", "EdicaoProgramaSorteioFEF"])
    out, source = audits.prepare_audits(raw, "2026-01-01T00:00:00Z")
    r = out.first()
    assert (source["uf"], source["municipality_name_raw"], source["publication_date"]) == ("ufs", "municipios", "datapublicacao")
    assert (r.id_da_tarefa, r.uf, r.municipality_name_raw) == ("123", "CE", "São João d'Aliança")
    assert r.municipality_name_norm == "SAO JOAO D ALIANCA" and r.publication_date == dt.datetime(2026, 3, 6)
    assert r.id_da_auditoria is None and r.source_columns_original.startswith("IdTarefa,Titulo")


@pytest.mark.parametrize("texts, want", [
    ([None, "2026-03-06", "07/03/2026", "2026-03-08"], [None, "2026-03-06", None, "2026-03-08"]),
    (["06/03/2026", "2026-03-07", "31/02/2026"], ["2026-03-06", None, None]),
    (["2026-03-06 10:11:12", "2026-03-07", " 2026-03-08 00:00:00 "], ["2026-03-06", None, "2026-03-08"]),
    ([None, None], [None, None]),
])
def test_first_date_fixes_the_form(spark, texts, want):
    raw = spark.createDataFrame(list(enumerate(texts)), "seq int, DataPublicacao string").repartition(3)
    out, _ = audits.prepare_audits(raw, "t", order="seq")
    got = out.orderBy("seq").select(F.date_format("publication_date", "yyyy-MM-dd")).collect()
    assert [r[0] for r in got] == want


def test_location_from_unit_text(spark):
    raw = spark.createDataFrame([("1", "Itapajé /ce e outros/SP"), ("2", "sem estado"), ("3", None)], ["IdTarefa", "Siglas Unidades Auditadas"])
    out, _ = audits.prepare_audits(raw, "t")
    got = out.orderBy("id_da_tarefa").select("uf", "municipality_name_raw").collect()
    assert [tuple(r) for r in got] == [("CE", "Itapajé"), ("", "sem estado"), ("", "")]


def test_programme_filter(spark):
    df = spark.createDataFrame(
        [("Fiscalização de Entes Federativos", None), ("Outra coisa", "V06"), ("Outra coisa", " "), (None, None)], "grupoatividade string, fef string")
    assert audits.programme_filter(df)[0].count() == 2
    assert audits.programme_filter(df, requested=False)[0].count() == 4
    assert audits.programme_filter(df.where("fef is null and grupoatividade is null"))[0].count() == 1
    assert audits.programme_filter(df.select(F.lit(1).alias("x")))[0].count() == 4
    assert audits.programme_counts(df).first().rows_matched == 2


def test_edition_field(spark):
    df = spark.createDataFrame([("V06",)], "fef string")
    out, source, warning = audits.with_edition(df)
    assert (out.first().edicao_programa_sorteio_fef, source) == ("V06", "derived_from_fef") and warning
    assert audits.with_edition(out.withColumnRenamed("edicao_programa_sorteio_fef", "edicao"))[1] == "existing:edicao"
    assert audits.with_edition(df.select(F.lit(1).alias("x")))[1] == "missing"


# --- linking

LOTTERY = "seq long, ibge_municipality_code string, uf string, municipality_name_clean string, round_id string, round_label string"
AUDITS = ("seq long, ibge_municipality_code string, uf string, municipality_name_raw string, id_da_tarefa string, id_da_auditoria string, "
          "titulo_do_relatorio string, publication_date timestamp, fef string")


def sides(spark):
    lottery = spark.createDataFrame(
        [(2, "2306306", "CE", "Itapage", "r2", "40o"), (1, "2306306", "ce ", None, "r1", "39o"), (3, "1", "SP", "Sem", "r1", "39o"), (4, None, "SP", "X", "r1", "39o")], LOTTERY)
    day = dt.datetime(2020, 1, 15)
    table = spark.createDataFrame(
        [(2, "2306306", "CE", "b", "9002", "78", "T", day, "V"), (1, "2306306", "CE", "a", "9001", "77", "T", day, None),
         (3, "2306306", "CE", "c", "9001", " ", "U", None, "V"), (4, "99", "CE", "c", "7", "7", "U", day, "V"), (5, "99", None, "c", "8", "7", "U", day, "V")], AUDITS)
    return lottery, table


HOT_PLACE = [("2306306", "CE")]


@pytest.mark.parametrize("skewed", [{}, {"hot_left": HOT_PLACE, "hot_right": HOT_PLACE, "salts": 3}])
def test_long_links(spark, skewed):
    long = link.link_long(*sides(spark), **skewed).orderBy("lottery_seq", "audit_seq").collect()
    assert [(r.lottery_seq, r.audit_seq) for r in long] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, None)]
    assert long[0].eaud_relatorio_url == "https://eaud.cgu.gov.br/relatorio/9001" and long[-1].eaud_relatorio_url is None


def test_wide_links(spark):
    wide = link.link_wide(*sides(spark)).orderBy("ibge_municipality_code").collect()
    assert [r.ibge_municipality_code for r in wide] == ["0000001", "2306306"]
    empty, full = wide
    assert (empty.audit_task_id, empty.municipality_name, empty.first_lottery_round) == ([], "Sem", "39o")
    assert full.municipality_name == "Itapage" and full.municipality_name_raw == "a"
    assert full.lottery_round_ids == ["r1", "r2"] and full.first_lottery_round == "39o"
    assert full.audit_task_id == ["9001", "9002"] and full.audit_audit_id == ["77", "78"] and full.fef == ["V"]
    assert full.grupoatividade == [] and full.audit_publication_date == ["2020-01-15T00:00:00"] * 2
    repeated = link.repeat_dates(link.link_wide(*sides(spark))).orderBy("ibge_municipality_code").collect()[1]
    assert repeated.audit_publication_date == ["2020-01-15T00:00:00"] * 4


def test_place_with_more_than_a_million_values_is_one_row(spark):
    n = 1_050_000
    lottery, _ = sides(spark)
    table = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("2306306").alias("ibge_municipality_code"), F.lit("CE").alias("uf"), F.col("id").cast("string").alias("id_da_tarefa")
    )
    wide = link.link_wide(lottery.where("uf like 'CE%' or uf like 'ce%'"), table)
    r = wide.select(F.size("audit_task_id").alias("n"), F.col("audit_task_id")[0].alias("a"), F.try_element_at("audit_task_id", F.lit(n)).alias("z")).collect()
    assert [tuple(x) for x in r] == [(n, "0", str(n - 1))]


def test_link_statistics(spark):
    lottery, table = sides(spark)
    r = link.link_coverage(lottery, table).first()
    assert (r.num_lottery_municipalities, r.num_lottery_municipalities_with_audit, r.lottery_municipality_coverage_with_audits) == (2, 1, 0.5)
    assert [tuple(x) for x in link.audits_per_year(table).collect()] == [(2020, 3)]
    empty = link.link_coverage(lottery.limit(0), table).first()
    assert (empty.num_lottery_municipalities, empty.lottery_municipality_coverage_with_audits) == (0, 0.0)


# --- manifests, fetch log, gates

def test_manifest_upsert_adds_columns_and_keeps_latest(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 2)], "seq int, local_path string, item_type string, size int")
    new = spark.createDataFrame([(1, "a", "x", "n"), (2, "a", "x", "m")], "seq int, local_path string, item_type string, note string")
    got = {r.local_path: (r.size, r.note) for r in manifest.upsert(old, new, ["local_path", "item_type"]).collect()}
    assert got == {"a": (None, "m"), "b": (2, None)}


def test_upsert_to_new_path(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "seq int, local_path string")
    first = manifest.upsert_to(str(tmp_path / "none"), str(tmp_path / "v1"), one, ["local_path"])
    second = manifest.upsert_to(first, str(tmp_path / "v2"), one.withColumn("local_path", F.lit("b")), ["local_path"])
    assert spark.read.parquet(second).count() == 2 and spark.read.parquet(first).count() == 1


def test_file_changes(spark):
    cols = "local_path string, sha256 string"
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], cols)
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], cols)
    got = {r.local_path: (r.state, r.write_version) for r in manifest.changes(before, after).collect()}
    assert got == {"a": ("unchanged", False), "b": ("changed", True), "c": ("missing", False), "d": ("new", True)}


def test_host_list():
    assert fetchlog.parse_hosts(" eCGU, x,") == ["ecgu"] and fetchlog.parse_hosts("x") == ["eaud"]


def test_probe_table_needs_columns(spark):
    with pytest.raises(ValueError, match="publication_date"):
        fetchlog.probe_table(spark.createDataFrame([("1", 1)], "idtarefa string, seq int"), "seq")


def test_downloads_index(spark):
    df = spark.createDataFrame(
        [(1, "t", "h", False, 1), (2, "t", "h", True, 2), (3, "t", "h", True, 3), (4, "u", "h", False, 4)], "seq int, idtarefa string, host string, ok boolean, v int")
    assert [r.seq for r in fetchlog.downloads_index(df).collect()] == [2]
    assert [r.seq for r in fetchlog.downloads_index(df, 2).collect()] == [3]


def test_gates(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    table = gates.csv_gates(df)
    assert {r.gate: r.ok for r in table.collect()} == {"csv_columns": False, "csv_rows": False}
    with pytest.raises(RuntimeError, match="csv_rows"):
        gates.require(table)
    probe = lambda n, good, rate: gates.probe_gate(
        spark.createDataFrame([(n, good, rate)], "unique_idtarefa int, download_success_count int, download_success_rate double")).first().ok
    assert [probe(10, 5, 0.5), probe(10, 4, 0.4), probe(9, 5, 0.55), probe(9, 4, 0.9)] == [True, False, True, False]
    assert gates.no_manual_gate(spark.createDataFrame([(0,)], "manual_needed int")).first().ok


def test_value_counts_of_absent_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert tuple(profile.top_values(df, "fef").first()) == ("<missing_column>", 0)


def test_unmatched_names_count_nulls(spark):
    df = spark.createDataFrame([(None, "SP", "unmatched"), (None, "SP", "unmatched"), ("a", None, "manual_needed"), ("b", "SP", "exact")], "municipality_name_clean string, uf string, match_method string")
    assert [tuple(r) for r in profile.top_unmatched(df).collect()] == [(None, "SP", 2), ("a", None, 1)]
