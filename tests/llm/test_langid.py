import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclink.llm import langid

from .cases import empty, frame, odd, odd_rows

SOUNDS = {
    "en": "th the and ing ed er on re st ly tion ble of to in".split(),
    "de": "sch ung ein ich keit heit ver be ge pf tz ü ä ß en".split(),
    "fr": "eau aux que ment oi ou tre elle ier é è ç tion en".split(),
}


def text(lang, seed, n=80):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=60):
    langs = [lang for lang in SOUNDS for _ in range(n)]
    return frame(spark, [text(lang, i) for i, lang in enumerate(langs)], lang=langs)


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(corpus(spark))


def test_filters_answer_for_all_languages_at_once(model):
    """No owned n-gram is missed, and the corrected share of noise is near zero."""
    seen = [h for symbols, owner in langid._chunks([text("en", 1), text("en", 2)]) for h, _ in langid._grams(symbols, owner)]
    assert seen
    noise = np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    found = model.masks[0][langid._slots(noise)[0]]
    for s in langid._slots(noise)[1:]:
        found = found & model.masks[0][s]
    for i, p in enumerate(model.chance()):
        assert abs(((found >> np.uint64(i)) & np.uint64(1)).mean() - p) < 0.01


def test_grams_against_a_plain_walk():
    """Equal n-grams have equal hashes, others have others."""
    texts = ["Ab c, abc", None, "", "über ab", "12 3", "a" * 5, "x"]
    names, hashes = [], []
    for i, t in enumerate(texts):
        runs = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        names += [(i, f" {w} "[j : j + n]) for n in langid.SIZES for w in runs for j in range(len(w) + 3 - n)]
    for symbols, owner in langid._chunks(texts):
        hashes += [(int(o), int(h)) for hs, of in langid._grams(symbols, owner) for h, o in zip(hs, of)]
    assert sorted(i for i, _ in names) == sorted(i for i, _ in hashes)
    assert len(set(names)) == len(set(hashes)) and len({g for _, g in names}) == len({h for _, h in hashes})


def test_accuracy_on_held_out_texts(spark, model):
    langs = [lang for lang in SOUNDS for _ in range(40)]
    docs = frame(spark, [text(lang, 10_000 + i, 8) for i, lang in enumerate(langs)], lang=langs)
    rows = langid.predicted(docs, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_long_texts_are_read_whole(spark, model):
    half = text("de", 1, 40_000)
    rows = langid.predicted(frame(spark, [text("en", 1, 200) + " " + half, half + text("fr", 5, 90)]), model).collect()
    assert [r["lang_pred"] for r in rows] == ["de", "de"]


def test_training_leaves_held_out_rows_alone(spark):
    docs = corpus(spark, 30)
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    got = langid.language_table(wrong)
    assert {r["lang_pred"] for r in got.collect()} == set(SOUNDS)
    moved = docs.withColumn("lang", F.lit(None).cast("string")).where(langid.held_out()).unionByName(docs.where(~langid.held_out()))
    a, b = (sorted(map(tuple, x.collect())) for x in (got, langid.language_table(moved)))
    assert a == b


def test_more_than_64_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"l{i:03d}" for i in range(70)]
    texts = [" ".join((letters[i % 26] + letters[i // 26] + letters[(7 * i) % 26]) * 2 for _ in range(30)) for i in range(70)]
    docs = frame(spark, texts, lang=langs)
    rows = langid.predicted(docs, langid.train(docs)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in rows)


def test_rare_languages_beside_a_rich_one(spark):
    """A language of 4000 rows with more n-grams than any fixed number of slots is made for, others of 20."""
    r = random.Random(3)
    words = lambda letters, n: ["".join(r.choices(letters, k=6)) for _ in range(n)]
    docs = [(" ".join(words("abcdefghijklmnopqrstuvwxyz", 110)), "rich") for _ in range(4000)]
    held = []
    for i in range(30):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(40)]
        own = words(letters, 60)
        docs += [(" ".join(own[3 * (j % 20) : 3 * (j % 20) + 3] * 3), f"rare{i:02d}") for j in range(20)]
        held.append((" ".join(r.sample(own, 8)), f"rare{i:02d}"))
    model = langid.train(frame(spark, [t for t, _ in docs], lang=[x for _, x in docs]))
    assert model.masks.shape[1] > 1 << langid.SLOT_BITS
    names, scores = langid.classify([t for t, _ in held] + [docs[0][0]], model, model.chance())
    assert names == [x for _, x in held] + ["rich"] and min(scores) > 0.5


def test_odd_rows(spark, model):
    docs = odd(spark)
    got = langid.predicted(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0.0 or not blank)
    table = langid.language_table(docs).collect()
    assert len(table) == len(odd_rows()) and {r["lang_pred"] for r in table} <= {"en", "de", "fr", "xx", "und"}
    kept = langid.identified(docs, model, min_score=0.0)
    assert kept.columns == docs.columns and all(r["text"].strip() for r in kept.collect())


def test_empty_table_and_no_labels(spark):
    assert langid.language_table(empty(spark)).count() == 0
    rows = langid.language_table(frame(spark, ["some text", None])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
