import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from civiclink.llm import divergence as dv
from civiclink.llm.queries import OP13_SQL, op13_source_divergence

from .cases import empty, frame, odd, odd_rows, prose


def brute(rows, min_docs=10, top=10):
    """rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    groups, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(dv.LOWER))
        groups[lang, source].update(terms)
        langs[lang].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        mine, whole = shares(groups[lang, source]), shares(langs[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                theirs = shares(groups[lang, other])
                pairs.append((sum(f(mine[t], theirs[t]) for t in kept), other))
        terms = [(f(mine[t], whole[t]), t) for t in kept if groups[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n, sources=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "de", None]), f"s{min(int(r.expovariate(0.5)), sources)}"
        words = [r.choice(["The", "über", "漢字", "x", "y", "z"]) + "abcdefghij"[min(int(r.expovariate(0.4)), 9)] * (1 + (source == "s1")) for _ in range(r.randrange(0, 60))]
        rows.append((" ".join(words) + r.choice(["", "!", "-tail", "\x00q"]), lang, source if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed,n,tile", [(1, 300, 2048), (2, 150, 7), (3, 40, 1)])
def test_against_brute_force(spark, monkeypatch, seed, n, tile):
    monkeypatch.setattr(dv, "TILE", tile)
    rows = corpus(seed, n)
    docs = frame(spark, [r[0] for r in rows], lang=[r[1] for r in rows], source=[r[2] for r in rows])
    assert got(dv.divergence(docs)) == brute(rows)


def test_many_terms_fill_words_to_the_last_bit(spark, monkeypatch):
    monkeypatch.setattr(dv, "BUCKET", 100)
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(700)]
    rows = [(" ".join(r.choices(vocabulary, k=300)), "en", f"s{i % 3}") for i in range(60)]
    docs = frame(spark, [x[0] for x in rows], lang=[x[1] for x in rows], source=[x[2] for x in rows])
    assert got(dv.divergence(docs)) == brute(rows)
    found = dv.audit(docs)
    assert found.levels.where("bits < 0").count() > 0  # a bitmap that uses the sign bit
    # The bitmaps hold every (group, term) once.
    assert found.levels.agg(F.sum(F.bit_count("bits"))).first()[0] == found.cells.count()


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    rows = [("common words here", "en", "a")] * 12 + [(None, "en", "b"), ("", "en", "c"), ("rare", "en", "b")]
    rows += [("once", "fr", "a"), ("twice", "fr", "b"), (None, None, None), ("alone", "it", "a")]
    docs = frame(spark, [r[0] for r in rows], lang=[r[1] for r in rows], source=[r[2] for r in rows])
    out = got(dv.divergence(docs))
    assert out == brute(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in out and not [r for r in out if r[0] in ("it", "")]


def test_ties_go_by_item(spark):
    rows = [("one two", "en", s) for s in "abcd" for _ in range(10)]
    docs = frame(spark, [r[0] for r in rows], lang=[r[1] for r in rows], source=[r[2] for r in rows])
    assert [(r[3], r[5]) for r in got(dv.divergence(docs)) if r[1] == "b"] == [("a", 1), ("c", 2), ("d", 3)]


def test_shares_stay_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 10, 3), (10**13, 9 * 10**13, 10**8), (7 * 10**12 + 1, 8 * 10**12 + 3, 12345), (0, 9 * 10**13, 1)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    assert [r[0] for r in df.select(dv._share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_long_texts_and_small_stores(spark, monkeypatch):
    rows = [(prose(i % 7, 400), "en", f"s{i % 4}") for i in range(40)]
    docs = frame(spark, [r[0] for r in rows], lang=[r[1] for r in rows], source=[r[2] for r in rows])
    want = got(dv.divergence(docs))
    monkeypatch.setattr(dv, "SLICE", 100)
    monkeypatch.setattr(dv, "MOST", 50)
    assert got(dv.divergence(docs)) == want == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    rows = [(r[1], r[2], r[3]) for r in odd_rows()]
    assert got(dv.divergence(odd(spark), min_docs=2)) == brute(rows, 2)
    assert got(dv.divergence(empty(spark))) == []


def test_query_against_its_sql(spark, tmp_path):
    rows = corpus(5, 120)
    docs = frame(spark, [r[0].replace("\x00", "\x01") for r in rows], lang=[r[1] for r in rows], source=[r[2] for r in rows])
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({OP13_SQL})").fetchall()
    assert got(op13_source_divergence(spark, str(tmp_path))) == sorted(want)
