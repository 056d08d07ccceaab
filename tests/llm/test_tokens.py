import random
import re
from collections import Counter

import pytest
import tiktoken

from pyspark.sql import functions as F

from civiclink.llm import tokens
from civiclink.llm.queries import MAIL, RANKS_FILE, op10_token_counts

from .cases import empty, frame, odd, odd_rows, prose


def encoder():
    with open(RANKS_FILE, "rb") as f:
        return tokens._encoding("test", f.read())


def test_slices_have_the_tokens_of_the_whole(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 50)
    text = "  a b\n\n c  d it's 12 34!! é à " + prose(1, 300) + "  \n\n " + prose(2, 50)
    parts = list(tokens._slices(text))
    assert "".join(parts) == text and len(parts) > 20
    assert sum((encoder().encode_ordinary(p) for p in parts), []) == encoder().encode_ordinary(text)


def test_counts_of_odd_rows(spark):
    rows = tokens.count_tokens(odd(spark), "v1", RANKS_FILE).collect()
    want = sorted(len(encoder().encode_ordinary(r[1] or "")) for r in odd_rows())
    assert sorted(r["tokens"] for r in rows) == want
    n = sorted(r["tokens"] for r in tokens.count_bytes(odd(spark)).collect())
    assert n == sorted(len((r[1] or "").encode()) for r in odd_rows())
    assert isinstance(encoder(), tiktoken.Encoding)


COUNTS = "doc_id long, source string, lang string, version string, tokens long"


def test_batches_against_counting_again(spark, tmp_path):
    r = random.Random(1)
    rollup = tokens.Rollup(spark, str(tmp_path / "rollup"))
    state: dict[tuple, tuple] = {}

    def row(i):
        return (i, r.choice(["a", "b", None]), r.choice(["en", None]), r.choice(["v1", "v2"]), r.randrange(0, 100))

    for batch in range(5):
        new = [row(100 * batch + i) for i in range(20)] + ([(None, "a", "en", "v1", 5)] if not batch else [])
        ids = r.sample(sorted((k for k in state if k[0] is not None)), 8) if state else []
        gone, changed = {k[0] for k in ids[:4]}, [(k[0], "c", "fr", k[1], r.randrange(100)) for k in ids[4:]]
        frames = [spark.createDataFrame(x, COUNTS) for x in (new, changed)]
        deletes = spark.createDataFrame([(i,) for i in gone] + [(10**9,)], "doc_id long")
        assert rollup.commit(f"b{batch}", frames[0], deletes, frames[1])
        assert not rollup.commit(f"b{batch}", frames[0], deletes, frames[1])
        state = {k: v for k, v in state.items() if k[0] not in gone}
        state |= {(i, v): (s, lang, n) for i, s, lang, v, n in [*changed, *new]}
        docs, total = Counter(), Counter()
        for (_, v), (s, lang, n) in state.items():
            docs[s, lang, v] += 1
            total[s, lang, v] += n
        got = {(x["source"], x["lang"], x["version"]): (x["docs"], x["tokens"]) for x in rollup.totals().collect()}
        assert got == {k: (docs[k], total[k]) for k in docs}
    assert rollup.batches() == [f"b{i}" for i in range(5)]
    assert rollup.net().count() == len(state)


def test_deleting_everything_and_null_ids(spark, tmp_path):
    rollup = tokens.Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("one", spark.createDataFrame([(None, "a", None, "v", 3), (1, "a", None, "v", 4), (1, "a", None, "v", 4)], COUNTS))
    assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(3, 11)]
    rollup.commit("two", deletes=spark.createDataFrame([(None,), (1,)], "doc_id long"))
    assert rollup.totals().count() == 0 and rollup.net().count() == 0


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    rollup = tokens.Rollup(spark, str(tmp_path / "rollup"))
    rows = spark.createDataFrame([(1, "a", "en", "v", 3)], COUNTS)
    rows.selectExpr("doc_id", "source", "lang", "version", "5L AS docs", "99L AS tokens").write.parquet(rollup._folder("entries", "one"))
    assert rollup.batches() == [] and rollup.totals().count() == 0
    assert rollup.commit("one", rows)
    assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(1, 3)]


def test_query_against_plain_counting(spark, tmp_path):
    texts = [prose(i, 30) for i in range(30)] + [f"write to a.b{i}@mail{i}.example.com or {prose(i, 5)}" for i in range(12)] + [None, ""]
    sources = [["a", "b", None][i % 3] for i in range(len(texts))]
    docs = frame(spark, texts, source=sources, lang=["en"] * len(texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 44, 2)] + [(0, 1, 1), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    gone = {i for i, _, toxic in labels if toxic}
    want = Counter()
    for i, (t, s) in enumerate(zip(texts, sources)):
        if i not in gone:
            t = re.sub(MAIL, "", t or "")
            want[s, "en", "byte_bpe_50k"] += len(encoder().encode_ordinary(t))
            want[s, "en", "utf8_bytes"] += len(t.encode())
    got = op10_token_counts(spark, str(tmp_path)).collect()
    assert {(r["source"], r["lang"], r["version"]): r["tokens"] for r in got} == dict(want)
    assert sum(r["docs"] for r in got) == 2 * (len(texts) - len(gone & set(range(len(texts)))))


def test_names_and_empty_batches(spark, tmp_path):
    rollup = tokens.Rollup(spark, str(tmp_path / "rollup"))
    with pytest.raises(ValueError):
        rollup.commit("../x", None)
    assert rollup.commit("nothing") and rollup.batches() == ["nothing"] and rollup.totals().count() == 0
    assert tokens.count_tokens(empty(spark), "v", RANKS_FILE).count() == 0
    assert rollup.commit("docs", tokens.count_bytes(frame(spark, ["abc", None])))
    assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(2, 3)]


def test_a_revision_reads_only_its_buckets(spark, tmp_path):
    rollup = tokens.Rollup(spark, str(tmp_path / "rollup"))
    for k in range(3):
        rollup.commit(f"b{k}", spark.range(1000 * k, 1000 * k + 1000).selectExpr("id doc_id", "'a' source", "'en' lang", "'v' version", "2L tokens"))
    change = spark.createDataFrame([(5, "a", "en", "v", 7), (2500, "a", "en", "v", 1)], COUNTS)
    buckets = {x[0] for x in change.select(rollup._bucket("doc_id")).collect()}
    said = rollup._said(change.select("doc_id", F.col("version").alias("of")))
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(rf"PartitionFilters: \[[^\]]*bucket[^\]]*\b{b}\b", plan) for b in buckets)
    assert sorted(x["doc_id"] for x in said.collect()) == [5, 2500]
    assert rollup.commit("change", revised=change)
    assert [tuple(x) for x in rollup.totals().select("docs", "tokens").collect()] == [(3000, 6004)]
