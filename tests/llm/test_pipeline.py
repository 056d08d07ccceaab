"""The corpus pipeline, stage by stage, against plain versions over the rows each stage was given."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from civiclink.llm import mixing

from .cases import FIELDS
from .test_decontaminate import plain as plain_hits
from .test_langid import SOUNDS, text
from .test_simhash import plain_components, plain_fingerprint

COLUMNS = [n for n, _ in FIELDS]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    items = [(i, text("en", 900 + i, 30)) for i in range(6)] + [(6, None), (7, "")]
    rows = []
    for i in range(150):
        lang = r.choice(list(SOUNDS))
        body = text(lang, i, r.randrange(40, 120))
        if i % 10 == 3:
            body += "\n" + " ".join(items[i % 6][1].split()[5:25]) + "\n" + text(lang, 5000 + i, 12)
        rows.append((i, body, lang if i % 7 else None, r.choice(["a", "a", "b", None]), len(body)))
    rows += [(200 + i, rows[i][1], rows[i][2], "c", rows[i][4]) for i in range(40)]
    rows += [(300 + i, rows[i][1] + " tail", rows[i][2], "c", None) for i in range(20)]
    rows += [(400, None, "en", "a", None), (401, "", "en", None, 0), (402, " 12 -- 34 ", "de", "b", 10), (None, text("de", 77, 50), "de", "a", 1), rows[5], rows[5]]
    schema = StructType([StructField(n, t) for n, t in FIELDS])
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    bench = StructType([StructField("item_id", LongType()), StructField("text", StringType())])
    spark.createDataFrame(items, bench).write.parquet(f"{folder}/benchmark.parquet")
    out, docs = [rows], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([tuple(x) for x in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out, docs.columns, items, folder


def counted(rows):
    return Counter(rows)


def test_language_stage_rejects_texts_without_letters_only(steps):
    before, after = steps[0][0], steps[0][1]
    assert counted(after) == counted(r for r in before if any(c.isalpha() for c in r[1] or ""))


def test_one_document_of_each_near_duplicate_group_stays(steps):
    before, after = steps[0][1], steps[0][2]
    roots = plain_components([plain_fingerprint(r[1]) for r in before], 3)
    groups = defaultdict(list)
    for r, root in zip(before, roots):
        groups[root].append(r)
    least = lambda rows: min((r[0] is None, r[0] or 0) for r in rows)
    assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(map(least, groups.values()))
    assert not counted(after) - counted(before) and len(after) < len(before)


def test_benchmark_passages_are_cut_and_nothing_else(steps):
    before, after, items = steps[0][2], steps[0][3], steps[2]
    new = {r[0]: r for r in after}
    assert len(after) == len(before)
    cut = 0
    for r in before:
        hit = plain_hits(r[1], items, 10)[1]
        if not hit:
            assert new[r[0]] == r
            continue
        cut += 1
        assert not plain_hits(new[r[0]][1], items, 10)[1] and new[r[0]][4] == len(new[r[0]][1]) < len(r[1])
        words = [w for i, w in enumerate(r[1].lower().split()) if i not in hit]
        assert new[r[0]][1].lower().split() == words
    assert cut >= 8


def test_sources_come_near_their_targets(steps):
    before, after = steps[0][3], steps[0][4]
    size = lambda r: len(r[1].split())
    total, most, taken = Counter(), Counter(), Counter()
    for r in before:
        total[r[3]] += size(r)
        most[r[3]] = max(most[r[3]], size(r))
    for r in after:
        taken[r[3]] += size(r)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([total[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()))
    assert all(abs(taken[s] - g) <= most[s] for s, g in zip(names, goals))
    assert set(after) <= set(before) and max(counted(after).values()) <= 2


def test_shards_by_plain_hashing(steps):
    before, after, columns = steps[0][4], steps[0][5], steps[1]
    assert sorted(columns) == sorted([*COLUMNS, "shard", "slot"])
    at = [columns.index(c) for c in COLUMNS]
    assert counted(tuple(r[i] for i in at) for r in after) == counted(before)
    slots = defaultdict(list)
    for r in after:
        row = dict(zip(columns, r))
        key = "null" if row["doc_id"] is None else str(row["doc_id"])
        score = [hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13] for s in range(24)]
        assert row["shard"] == max(range(24), key=lambda s: (score[s], -s))
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_rows_of_the_stages(spark, steps):
    out = corpus_pipeline.run(spark, steps[3])
    assert out.columns == steps[1]
    assert counted(tuple(r) for r in out.collect()) == counted(steps[0][5])


def test_empty_tables(spark, tmp_path):
    schema = StructType([StructField(n, t) for n, t in FIELDS])
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    bench = StructType([StructField("item_id", LongType()), StructField("text", StringType())])
    spark.createDataFrame([], bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
