"""How far sources of one language differ in their words, from count-level bitmaps.

A term is a run of letters; each language keeps the terms that at least `min_docs` of its documents hold. With N occurrences
of V kept terms, a term of count c has p = 1 + floor(10^9 * (c + 2) / (N + 2 V)); two such shares p and q differ by
f = floor((p - q)^2 / (p + q)). All numbers are whole.

The kept terms of a language are laid out in words of 64 bits, terms of like frequency together. Each
(group, count) has the bitmap of its terms, of which only the words with a bit set are rows. For two
sources of a language, bitmaps of the same word meet; AND and popcount give how many terms have count c in the one
and d in the other, and each such cell adds its size times f(c, d). Cells of count zero are
complements and need no rows: with |c| terms of count c, the cell (c, 0) has |c| minus all (c, d) with d > 0. So

    sum = sum over cells c, d > 0 of n(c, d) * (f(c, d) - f(c, 0) - f(0, d) + f(0, 0))
        + sum over c > 0 of |c| * (f(c, 0) - f(0, 0)) + the same for d + V * f(0, 0)

A word has 64 terms, so at most 64 rows per source, and words of rare terms have a few: work is in proportion
to pairs of sources times terms, evenly dealt by words. Terms are counted in each task before they are shuffled; a
language or source with a third of all rows is spread over its terms and words.

Null text, language and source are empty text. Repeated rows count each. A group without terms, and a language without kept
terms, appear with their pairs: the sums are over no terms then, or over counts of zero. A language with one
source has no pairs. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import stored

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
SLICE = 1 << 20
MOST = 1 << 18
SCALE = 1_000_000_000
BUCKET = 512
TILE = 2048


def terms_of(text: str) -> Iterator[list[str]]:
    """The terms of a text, in lists of about a million characters."""
    start = 0
    while start < len(text):
        end = len(text)
        if start + SLICE < end:
            gap = GAP.search(text, start + SLICE)
            end = gap.start() if gap else end
        yield TERM.findall(text[start:end].translate(LOWER))
        start = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it), and per group a row with a null term whose docs are its rows."""
    cell = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(cell(lang_col).alias("lang"), cell(source_col).alias("source"), cell(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in seen.items():
                names = list(n)
                for a in range(0, len(names), 1 << 16):
                    some = names[a : a + (1 << 16)]
                    columns = [pa.array(c, t) for c, t in (([lang] * len(some), pa.string()), ([source] * len(some), pa.string()), (some, pa.string()))]
                    numbers = [pa.array([x[t] for t in some], pa.int64()) for x in (n, docs)]
                    yield pa.RecordBatch.from_arrays([*columns, *numbers], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column("text")):
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                before, mine = len(n), set()
                for some in terms_of(text.as_py()):
                    n.update(some)
                    mine.update(some)
                docs.update(mine)
                docs[None] += 1
                n[None] += 0
                held += len(n) - before
                if held > MOST:
                    yield from flush()
                    held = 0
        yield from flush()

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), divided in two steps that stay within 64 bits up
    to 9 * 10^13 words."""
    whole, first = F.greatest(total + 2 * terms, F.lit(1)), (count + F.lit(2)) * F.lit(100_000)
    low = F.call_function("div", F.call_function("mod", first, whole) * F.lit(10_000), whole)
    return F.lit(1).cast("long") + F.call_function("div", first, whole) * F.lit(10_000) + low


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


@dataclass
class Audit:
    """Tables of one corpus. groups: lang, source, total, terms, lang_total, p0 (share at count zero); cells: lang, source,
    term, n, p, q (the language's share) and the term's place; levels: lang, band, bucket, word, source, n, p, p0, bits, the bitmaps."""

    groups: DataFrame
    cells: DataFrame
    levels: DataFrame


def audit(docs: DataFrame, min_docs: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> Audit:
    """Count the terms, lay the kept ones out and make the bitmaps."""
    counts = stored(term_counts(docs, text_col, lang_col, source_col))
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = kept.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", F.length(F.bin("lang_n")).alias("band"))
    kept = stored(kept)
    sizes = kept.groupBy("lang", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).cast("long").alias("buckets"))
    laid = kept.join(sizes, ["lang", "band"]).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets"))
    laid = laid.repartition("lang", "band", "bucket")  # the join would leave all of a band in one task
    place = F.expr("row_number() OVER (PARTITION BY lang, band, bucket ORDER BY lang_n DESC, term) - 1").cast("int")
    laid = laid.withColumn("place", place).withColumn("word", F.col("place").bitwiseAND(F.lit(~63)))
    laid = laid.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63))))
    cells = stored(terms.select("lang", "source", "term", "n").join(laid.drop("buckets", "place"), ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")])
    groups = stored(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))))
    cells = cells.join(groups.drop("terms").withColumnRenamed("total", "group_total"), ["lang", "source"]).join(langs.select("lang", "terms"), "lang")
    shares = [_share(F.col(n), F.col(t), F.col("terms")).alias(x) for n, t, x in (("n", "group_total", "p"), ("lang_n", "lang_total", "q"))]
    cells = cells.select("lang", "source", "term", "n", *shares, "p0", "band", "bucket", "word", "bit")
    levels = cells.groupBy("lang", "band", "bucket", "word", "source", "n", "p", "p0").agg(F.bit_or("bit").alias("bits"))
    return Audit(groups, cells, stored(levels))


def _joint(rows: pa.Table) -> pa.Table:
    """Sums over cells of counts above zero for all pairs of sources, of the words of one bucket."""
    names, source = np.unique(np.array(rows.column("source").to_pylist(), object).astype(str), return_inverse=True)
    order = np.lexsort((source, rows.column("word").to_numpy()))
    word, p, p0, bits = (rows.column(c).to_numpy()[order] for c in ("word", "p", "p0", "bits"))
    source, sums, bits = source[order].astype(np.int64), {}, bits.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True])

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) ** 2 // (x + y)

    for a, b in zip(starts[:-1], starts[1:]):
        for i in range(a, b, TILE):
            for j in range(i, b, TILE):
                one, two = slice(i, min(i + TILE, b)), slice(j, min(j + TILE, b))
                both = bits[one, None] & bits[None, two]
                if i == j:
                    both = np.triu(both)  # bitmaps of one source share no term
                x, y = np.nonzero(both)
                if i == j:
                    x, y = x[(off := x != y)], y[off]
                if not len(x):
                    continue
                size = np.bitwise_count(both[x, y]).astype(np.int64)
                x, y = x + i, y + j
                value = size * (apart(p[x], p[y]) - apart(p[x], p0[y]) - apart(p0[x], p[y]) + apart(p0[x], p0[y]))
                pairs, where = np.unique(source[x] * len(names) + source[y], return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, where, value)
                for k, v in zip(pairs.tolist(), total.tolist()):
                    sums[k] = sums.get(k, 0) + v
    keys = np.array(list(sums), np.int64)
    left, right, value = names[keys // max(len(names), 1)], names[keys % max(len(names), 1)], np.array(list(sums.values()), np.int64)
    lang = [rows.column("lang")[0].as_py()] * (2 * len(keys))
    columns = [pa.array(lang, pa.string()), pa.array([*left, *right], pa.string()), pa.array([*right, *left], pa.string()), pa.array(np.r_[value, value])]
    return pa.Table.from_arrays(columns, ["lang", "source", "item", "value"])


def pairs(found: Audit) -> DataFrame:
    """lang, source, item (another source of the language), value, for every ordered pair."""
    joint = found.levels.groupBy("lang", "band", "bucket").applyInArrow(_joint, "lang string, source string, item string, value long")
    other = found.groups.select(F.col("lang").alias("of"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    meets = lambda df: df.join(other, (F.col("lang") == F.col("of")) & (F.col("source") != F.col("item")))
    sizes = found.levels.groupBy("lang", "source", "p", "p0").agg(F.sum(F.bit_count("bits")).cast("long").alias("size"))
    alone = meets(sizes).withColumn("value", F.col("size") * (_apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q0"))))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other_way = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    none = meets(found.groups).select("lang", "source", "item", (F.col("terms") * _apart(F.col("p0"), F.col("q0"))).alias("value"))
    parts = joint.unionByName(alone).unionByName(other_way).unionByName(none)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language; part `term`:
    the `top` terms that the group has more of than its language. Ranks by value, then item."""
    found = audit(docs, min_docs, text_col, lang_col, source_col)
    rank = F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)").cast("int")
    between = pairs(found).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    own = found.cells.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    return between.unionByName(own.withColumn("rank", rank).where(F.col("rank") <= top))
