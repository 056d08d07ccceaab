import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from civiclink.llm import decontaminate as dc
from civiclink.llm.fmindex import Index, suffix_array

from .cases import empty, frame, odd, odd_rows, prose

ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("k1", StringType())])


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(text, items, window):
    """(n_words, hit positions, sorted item ids)."""
    mine, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(mine) - n + 1):
                if mine[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add("null" if item is None else str(item))
    return len(mine), hit, sorted(found)


def test_suffix_array_against_sorting():
    r = random.Random(1)
    for n, k in [(1, 1), (5, 1), (60, 2), (300, 3), (500, 400)]:
        seq = np.array([r.randrange(k) for _ in range(n)], np.int64)
        assert suffix_array(seq).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


def test_search_and_locate_against_scanning():
    r = random.Random(2)
    docs = [[r.randrange(1, 6) for _ in range(r.randrange(0, 120))] for _ in range(12)]
    docs += [docs[0], docs[0]]
    seq = np.array([x for d in docs for x in [*d, 0]], np.int64)
    starts = np.concatenate([[0], np.flatnonzero(seq == 0)[:-1] + 1])
    parts = Index.build(seq, 6, starts)
    index = Index(len(seq), parts["rows"], np.frombuffer(parts["counts"], np.int32).astype(np.int64), parts["marks"], np.frombuffer(parts["samples"], np.int32).astype(np.int64))
    phrases = np.zeros((200, 4), np.int64)
    lengths = np.array([r.randrange(1, 5) for _ in range(200)])
    for row, n in zip(phrases, lengths):
        row[4 - n :] = [r.randrange(1, 6) for _ in range(n)]
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[4 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard_bytes,block_words", [(6 << 20, 1 << 20), (300, 40), (40, 15)])
def test_contamination_against_scanning(spark, shard_bytes, block_words):
    r = random.Random(3)
    item_texts = [prose(100, 40), prose(101, 25), "Short Item!", "x", "", None, "---", prose(102, 10), prose(100, 40)]
    items = [(i, t, "clash") for i, t in enumerate(item_texts)] + [(None, prose(103, 12), None), (1, prose(104, 14), None), (0, item_texts[0], "clash")]
    texts = [None, "", "short, ITEM", "a short item b x"]
    for i in range(25):
        parts = [prose(200 + i, r.randrange(40))]
        for _ in range(r.randrange(3)):
            w = words(item_texts[r.choice([0, 1, 7])])
            a = r.randrange(len(w) - 8)
            parts += ["; ".join(w[a : a + r.randrange(8, 30)]).upper(), prose(r.randrange(999), r.randrange(9))]
        texts.append(" \n".join(parts))
    texts += [texts[5], texts[5], " ".join(words(prose(100, 40)) * 30)]
    got = dc.contamination(frame(spark, texts).repartition(2), spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes, block_words=block_words).collect()
    assert len(got) == len(texts)
    for row in got:
        n, hit, found = plain(texts[row["doc_id"]], [i[:2] for i in items], 10)
        assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (n, len(hit), len(found), bool(hit))
        assert row["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_cut_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = ["before, One two-three four five six seven eight nine TEN eleven twelve; after", "one two three four five six seven eight nine", None, item]
    benchmark = spark.createDataFrame([(1, item, None)], ITEMS)
    got = {r["doc_id"]: r["text"] for r in dc.decontaminated(frame(spark, texts), benchmark).collect()}
    assert got == {0: "before, ; after", 1: texts[1], 2: None, 3: ""}


def test_odd_rows(spark):
    rows = odd_rows()
    benchmark = spark.createDataFrame([(1, rows[0][1], None), (2, "one two", None)], ITEMS)
    docs = odd(spark)
    got = dc.contamination(docs, benchmark).collect()
    want = sorted((len(words(r[1])), len(plain(r[1], [(1, rows[0][1]), (2, "one two")], 10)[1])) for r in rows)
    assert sorted((r["n_words"], r["n_hit"]) for r in got) == want
    cut = dc.decontaminated(docs, benchmark)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = sorted(str(r["text"]) for r in cut.collect() if not plain(r["text"], [(1, rows[0][1])], 10)[1])
    assert len(left) == len(rows)


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b", None)], ITEMS)
    nothing = spark.createDataFrame([], ITEMS)
    assert dc.contamination(empty(spark), benchmark).count() == 0
    assert dc.contamination(odd(spark), nothing).where("contaminated").count() == 0
    assert dc.contamination(odd(spark), nothing).count() == len(odd_rows())
    assert dc.decontaminated(empty(spark), nothing).count() == 0


def test_very_many_spans_are_merged(spark):
    r = random.Random(3)
    lists = [[(a, a + r.randrange(1, 12)) for a in (r.randrange(10 * n) for _ in range(n))] for n in (100_000, 2, 3, 40, 1)] + [[(0, 9), (1, 2), (9, 10), (11, 12)], []]
    rows = spark.createDataFrame([(i, [{"a": a, "b": b} for a, b in x]) for i, x in enumerate(lists)], "i int, spans array<struct<a:bigint,b:bigint>>")
    for i, got in rows.select("i", dc._merged(F.col("spans")).alias("spans")).collect():
        want = []
        for a, b in sorted(lists[i]):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [list(s) for s in got] == want
