import itertools
import os
import random
import re
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from civiclink.functions.names import entity_key, entity_words
from civiclink.operators import candidates, clusters, namejoin
from civiclink.plans import ORACLES, QUERIES
from civiclink.sources.keyed import KeyedTable
from civiclink.sources.landing import LandingStore


def union_find(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["root"] for r in clusters.components(df).collect()}


def test_a_chain_of_sixty_links_in_any_order(spark):
    r = random.Random(1)
    names = list(range(61))
    r.shuffle(names)
    edges = list(itertools.pairwise(names))
    r.shuffle(edges)
    assert found(spark, edges) == dict.fromkeys(range(61), 0)
    assert found(spark, [(i, i + 1) for i in range(60)]) == dict.fromkeys(range(61), 0)


def test_components_of_random_graphs_loops_and_repeats(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, 7), (100, 100), (5, 6), (5, 6), (6, 5)] + [(200, i) for i in range(201, 260)]
    want = union_find(edges)
    assert found(spark, edges) == want
    assert found(spark, [(None, 1), (1, None), (2, 3)]) == {2: 2, 3: 2}
    assert found(spark, []) == {}
    assert found(spark, [(4, 4)]) == {4: 4}


EDGES = "finding_id long, decision_id string, score double, band string, outcome_label string"


def test_clusters_flag_conflicts(spark):
    rows = [
        (10, "x", 0.9, "high", "adverse"), (9, "x", 0.7, "medium", "adverse"), (9, "y", 0.8, "medium", "neutral"),
        (3, "z", 0.9, "high", "adverse"), (3, "w", 0.9, "high", "adverse"), (4, "v", 0.0, "medium", None), (4, "u", 0.0, "medium", "neutral"),
    ]
    linked = clusters.link_clusters(spark.createDataFrame(rows, EDGES))
    got = {r["cluster_id"]: r for r in clusters.cluster_summary(linked).collect()}
    assert sorted(got) == [3, 4, 9]
    assert (got[9]["findings"], got[9]["decisions"], got[9]["links"], got[9]["outcomes"], got[9]["conflicting"]) == (2, 2, 3, ["adverse", "neutral"], True)
    assert got[9]["weighted_adverse"] == pytest.approx(1.6 / 2.4) and got[9]["best_score"] == 0.9
    assert not got[3]["conflicting"] and got[3]["weighted_adverse"] == 1.0
    assert not got[4]["conflicting"] and got[4]["weighted_adverse"] == 0.0
    by_finding = {r["finding_id"]: (r["cluster_id"], r["cluster_size"], r["conflicting"]) for r in clusters.finding_clusters(linked).collect()}
    assert by_finding == {10: (9, 4, True), 9: (9, 4, True), 3: (3, 3, False), 4: (4, 3, False)}
    assert clusters.cluster_summary(clusters.link_clusters(spark.createDataFrame([], EDGES))).count() == 0


def _shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = [local.getAllFiles().apply(i).getName() for i in range(local.getAllFiles().size())]
    return {n for n in names if re.match(r"shuffle_.*\.data$", n)}


def _orders(spark, folder):
    """Tables in which most findings share decisions with others and some values are null."""
    r, day = random.Random(4), datetime(2024, 1, 1)
    orders = [(i, r.randrange(4), r.choice("FOP"), day + timedelta(days=r.randrange(400)), f"{i % 5 + 1}-X") for i in range(40)]
    lines = [(r.randrange(40), r.randrange(9), r.randrange(3), i, float(r.randrange(1, 51)), r.random() / 10, r.random() / 12, r.choice("RAN"), r.choice("FO"), day + timedelta(days=r.randrange(450))) for i in range(300)]
    orders += [(None, 1, "F", day, "1-X"), (77, None, "F", day, "1-X")]
    lines += [(3, None, 1, 1, 50.0, 0.0, 0.0, "R", "F", day + timedelta(days=200)), (3, 1, 1, 1, None, 0.0, 0.0, "R", "F", day + timedelta(days=200))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("name", ["outcome_clusters", "outcome_cluster_summary"])
def test_links_are_paired_before_and_leave_no_shuffles(spark, tmp_path, name):
    _orders(spark, tmp_path)
    before = _shuffle_files(spark)
    df = QUERIES[name](spark, str(tmp_path))
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)  # they are removed in the background
    assert not left
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    assert len(rows) > 5 and rows == sorted(map(repr, want.fetchall()))


def test_strong_edges_are_the_edges_above_low(spark):
    r = random.Random(5)
    scores = [None, 0.1, 0.64, 0.65, 0.7, 0.85, 0.9]
    f = spark.createDataFrame([(i % 12 if i % 7 else None, r.choice(scores)) for i in range(30)], "finding_id long, x double")
    d = [(f"d{r.randrange(15)}" if i % 9 else None, r.choice(scores), r.choice([True, False, None]), r.choice(["adverse", "neutral", None])) for i in range(60)]
    d = spark.createDataFrame(d, "decision_id string, y double, jurisdiction_ok boolean, outcome_label string")

    def grade(findings, decisions):
        pairs = findings.join(decisions, F.col("x") >= F.col("y") - 0.06, "left").withColumn("score", F.when(F.col("y") > 0.1, F.least("x", "y")))
        return candidates.graded_links(pairs.withColumn("core_evidence", F.col("y") > 0.8))

    want = candidates.link_edges(grade(f, d)).where("band != 'low'")
    got = candidates.strong_edges(f, d, grade, slices=3)
    assert got.columns == want.columns and got.count() > 20
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_clusters_meet_through_findings_and_edges_without_an_end(spark):
    rows = [(5, "x"), (2, "x"), (2, "y"), (7, "y"), (7, None), (8, None), (None, "x"), (9, "z"), (10, "a"), (9, "a")]
    edges = spark.createDataFrame([(f, d, 0.9, "high", "adverse") for f, d in rows], EDGES)
    got = clusters.link_clusters(edges)
    assert sorted((r["finding_id"], r["decision_id"] or "", r["cluster_id"]) for r in got.collect()) == [
        (2, "x", 2), (2, "y", 2), (5, "x", 2), (7, "", 2), (7, "y", 2), (9, "a", 9), (9, "z", 9), (10, "a", 9)
    ]
    assert {r["cluster_id"]: (r["findings"], r["decisions"], r["links"]) for r in clusters.cluster_summary(got).collect()} == {2: (3, 2, 5), 9: (2, 2, 3)}
    seen = []
    whole, clusters.components = clusters.components, lambda pairs: seen.append(pairs) or whole(pairs)
    try:
        clusters.link_clusters(edges)
    finally:
        clusters.components = whole
    assert dict(seen[0].dtypes) == {"a": "bigint", "b": "bigint"} and seen[0].count() <= edges.count()


def test_entity_words(spark):
    cases = {
        "Construtora São João Ltda.": "CONSTRUTORA JOAO SAO", "SAO JOAO CONSTRUTORA S/A": "CONSTRUTORA JOAO SAO", "Dr. João da Silva e Silva": "JOAO SILVA",
        "S.A.": "SA", "Ltda": "LTDA", "": "", " - ": "", None: "", "Casa & Campo ME": "CAMPO CASA",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", entity_key("name").alias("k")).collect()
    assert {r["name"]: r["k"] for r in rows} == cases
    assert spark.createDataFrame([("b a b",)], "name string").select(entity_words("name")).first()[0] == ["A", "B"]


@pytest.mark.parametrize("limit", [0.5, 0.6, 2 / 3, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, limit):
    r = random.Random(int(limit * 100))
    words = "abcdefghijklm"

    def some(n):
        sets = {tuple(sorted({words[min(int(r.expovariate(0.25)), 12)] for _ in range(r.randrange(1, 8))})) for _ in range(n)}
        return sorted(sets)

    left, right = some(120), some(120)
    frames = [spark.createDataFrame([(" ".join(s), list(s)) for s in side], "key string, words array<string>") for side in (left, right)]
    limit = round(limit, 6)
    got = {(x["left_key"], x["right_key"]): x["shared"] for x in namejoin.similar_sets(*frames, limit).collect()}
    want = {}
    for a, b in itertools.product(left, right):
        shared = len(set(a) & set(b))
        if shared >= limit * len(set(a) | set(b)) - 1e-12:
            want[" ".join(a), " ".join(b)] = shared
    assert got == want and namejoin.similar_sets(*frames, limit).count() == len(want)


def test_names_of_records(spark):
    findings = spark.createDataFrame([(1, ["Casa Verde Ltda", "Dr. X"]), (2, None), (3, [None, ""]), (4, ["nothing alike"])], "finding_id long, names array<string>")
    decisions = spark.createDataFrame([("d", ["VERDE, CASA", "Casa Verde Nova", "other"]), ("e", [])], "decision_id string, names array<string>")
    f, d = namejoin.with_similar_names(findings, decisions, 0.6)
    assert {r["finding_id"]: sorted(r["names"]) for r in f.collect()} == {1: ["CASA NOVA VERDE", "CASA VERDE"], 2: [], 3: [], 4: []}
    assert {r["decision_id"]: r["names"] for r in d.collect()} == {"d": ["CASA VERDE", "CASA NOVA VERDE", "OTHER"], "e": []}


ROW = "k string, seq long, v string"


def files_below(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_small_batch_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["k"], buckets=8, seq="seq")
    assert not table.exists()
    rows = [(f"k{i}", i, "old") for i in range(200)] + [(None, 1, "null key")]
    assert table.upsert("load", spark.createDataFrame(rows, ROW)) and len(table.compact()) == 8
    before = files_below(path)
    small = spark.createDataFrame([("k3", 1, "a"), ("k3", 2, "b"), (None, 5, "new")], ROW)
    assert table.upsert("small", small) and not table.upsert("small", small)
    touched = table.buckets_of(small)
    assert len(touched) <= 2
    made = files_below(path) - before
    assert before <= files_below(path) and {f.split("/")[2] for f in made} == {f"_bucket={b}" for b in touched}
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 201 and got["k3"] == "b" and got[None] == "new" and got["k4"] == "old"
    assert {r["k"] for r in table.read(touched).collect()} >= {"k3", None}
    before = files_below(path)
    assert table.compact() == touched
    assert {f.split("/")[2] for f in files_below(path) - before} == {f"_bucket={b}" for b in touched}
    assert {r["k"]: r["v"] for r in table.read().collect()} == got
    table.tidy()
    assert {r["k"]: r["v"] for r in table.read().collect()} == got and not [f for f in files_below(path) if f.startswith("delta")]
    assert table.batches() == ["load", "small"]


def test_a_cut_off_upsert_does_not_show_and_later_columns_are_null(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert("one", spark.createDataFrame([("a", "x")], "k string, v string"))
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, state: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        table.upsert("two", spark.createDataFrame([("a", "lost")], "k string, v string"))
    with pytest.raises(RuntimeError):
        table.compact()
    monkeypatch.undo()
    assert [tuple(r) for r in table.read().collect()] == [("a", "x")]
    assert table.upsert("two", spark.createDataFrame([("b", "y", 1)], "k string, v string, w int"))
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "x", None), ("b", "y", 1)]
    with pytest.raises(ValueError):
        table.upsert("three", spark.createDataFrame([(1,)], "v int").withColumn("k", F.lit("a")))
    with pytest.raises(ValueError):
        table.upsert("../x", spark.createDataFrame([("a",)], "k string"))
    assert table.upsert("none", spark.createDataFrame([], "k string, v string")) and table.read().count() == 2


def landing(spark, **files):
    return spark.createDataFrame([(p, None if c is None else bytearray(c.encode())) for p, c in files.items()], "local_path string, content binary")


def test_landing_versions_and_equal_contents(spark, tmp_path):
    store = LandingStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.current().count() == 0
    states = {r["local_path"]: r["state"] for r in store.land("a", landing(spark, p="one", q="one", r="two", e="", n=None)).collect()}
    assert states == {"p": "new", "q": "new", "r": "new", "e": "new"}
    states = {r["local_path"]: r["state"] for r in store.land("b", landing(spark, p="two", q="one", s="three")).collect()}
    assert states == {"p": "changed", "q": "unchanged", "s": "new", "r": "missing", "e": "missing"}
    store.land("c", landing(spark, p="one"))
    assert sorted((r["local_path"], r["version"], bytes(r["content"]).decode()) for r in store.read().collect()) == [
        ("e", 1, ""), ("p", 3, "one"), ("q", 1, "one"), ("r", 1, "two"), ("s", 1, "three"),
    ]
    assert sorted(bytes(r["content"]).decode() for r in store.contents().collect()) == ["", "one", "three", "two"]
    assert sorted((r["local_path"], r["version"], bytes(r["content"]).decode()) for r in store.read(store.versions().where("local_path = 'p'")).collect()) == [
        ("p", 1, "one"), ("p", 2, "two"), ("p", 3, "one"),
    ]


def test_a_landing_cut_off_before_the_switch(spark, tmp_path, monkeypatch):
    store = LandingStore(spark, str(tmp_path / "s"), buckets=4)
    store.land("a", landing(spark, p="one"))
    stored = files_below(str(tmp_path / "s"))
    monkeypatch.setattr(LandingStore, "_switch", lambda self, batch: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        store.land("b", landing(spark, p="two", q="new"))
    monkeypatch.undo()
    assert stored < files_below(str(tmp_path / "s"))
    assert [(r["local_path"], r["version"], bytes(r["content"])) for r in store.read().collect()] == [("p", 1, b"one")]
    assert store.contents().count() == 1 and store.versions().count() == 1
    store.land("b", landing(spark, p="three", q="new"))
    assert sorted((r["local_path"], r["version"], bytes(r["content"]).decode()) for r in store.read().collect()) == [("p", 2, "three"), ("q", 1, "new")]
    assert sorted(bytes(r["content"]).decode() for r in store.contents().collect()) == ["new", "one", "three"]
    before = store.versions().count()
    assert {r["state"] for r in store.land("b", landing(spark, p="other")).collect()} == {"changed", "missing"} and store.versions().count() == before
