"""Names that are alike as sets of words: an exact set-similarity join by prefix filter.

Two sets of n and m words with a Jaccard similarity of t or more share at least ceil(t * n) words, and m lies between t * n and
n / t. So if the words of every set are put in one order, rare words first, sets that are alike share a word among
the first n - ceil(t * n) + 1 of each: only those words are joined. A pair that shares several of them is
taken at the first one, so nothing has to be made distinct afterwards; pairs with too few words left behind it are dropped by
their positions alone, and the whole sets of the others decide in the same row.

Every distinct set is joined once, whatever number of records has it; records are joined back by their key. The order of
the words comes from counts over both sides, so frequent words hardly ever stand in a prefix. If a word is frequent all the same, the join is a
plain equi-join on (word, size), which adaptive execution splits. Nothing is capped, and the result is that of comparing all with all.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.names import entity_words
from civiclink.functions.text import bound
from civiclink.sources.scratch import cut_lineage

LIMIT = 0.6


def _sets(names: DataFrame) -> DataFrame:
    """key, words of every distinct set of one column `name`."""
    words = bound(names.select("name").distinct(), "words", entity_words("name")).where(F.size("words") > 0)
    return words.select(F.concat_ws(" ", "words").alias("key"), "words").distinct()


def _needed(n: Column, limit: Fraction) -> Column:
    """ceil(limit * n) in whole numbers."""
    return F.call_function("div", n * F.lit(limit.numerator) + F.lit(limit.denominator - 1), F.lit(limit.denominator)).cast("int")


def similar_sets(left: DataFrame, right: DataFrame, limit: float = LIMIT) -> DataFrame:
    """left_key, right_key, shared, jaccard for all pairs of sets (key, words) with jaccard >= limit; sets are without repeats and not empty."""
    exact = Fraction(Decimal(str(limit)))
    if not 0 < exact <= 1:
        raise ValueError("the limit lies above 0 and is 1 at most")
    both = left.select("words").unionByName(right.select("words")).select(F.explode("words").alias("word"))
    counts = cut_lineage(both.groupBy("word").agg(F.count(F.lit(1)).alias("n")))

    def prefixed(sets: DataFrame, side: str) -> DataFrame:
        each = sets.select("key", F.explode("words").alias("word")).join(counts, "word")
        ordered = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
        ordered = ordered.select("key", F.col("w.word").alias("words"), F.size("w").alias("size"))
        prefix = F.posexplode(F.slice("words", 1, F.col("size") - _needed(F.col("size"), exact) + 1)).alias("pos", "word")
        placed = ordered.select("key", "words", "size", prefix)
        return placed.select(*[F.col(c).alias(f"{side}_{c}") for c in ("key", "words", "size", "pos")], "word")

    num, den = F.lit(exact.numerator), F.lit(exact.denominator)
    met = prefixed(left, "left").join(prefixed(right, "right"), "word")
    met = met.where((F.col("left_size") * num <= F.col("right_size") * den) & (F.col("right_size") * num <= F.col("left_size") * den))
    # If this is the first shared word, no more than the words behind it can be shared too.
    most = F.least(F.col("left_size") - F.col("left_pos"), F.col("right_size") - F.col("right_pos"))
    met = met.where(most * (num + den) >= (F.col("left_size") + F.col("right_size")) * num)
    # Both sets are in the same order, so the first shared word is the same from either side.
    met = bound(met, "_both", F.array_intersect("left_words", "right_words")).where(F.col("_both")[0] == F.col("word"))
    met = met.withColumn("shared", F.size("_both"))
    union = F.col("left_size") + F.col("right_size") - F.col("shared")
    met = met.where(F.col("shared") * den >= union * num)
    return met.select("left_key", "right_key", "shared", (F.col("shared") / union).alias("jaccard"))


def similar_names(left: DataFrame, right: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Distinct name sets of two frames with a column `name` that are alike."""
    return similar_sets(cut_lineage(_sets(left)), cut_lineage(_sets(right)), limit)


def with_similar_names(findings: DataFrame, decisions: DataFrame, limit: float = LIMIT, names: str = "names") -> tuple[DataFrame, DataFrame]:
    """Both frames with the raw names in `names` (an array) replaced by keys, those of the findings by the keys of all decision
    names they are alike to. The usual overlap of the two arrays then counts decision names that are alike to a name of the finding. Records
    without names, or with none that is alike to another, keep an empty array."""
    # Distinct lists of names are taken to words and looked up, not records.
    empty = F.array().cast("array<string>")
    keys = F.filter(F.transform("_list", lambda x: F.concat_ws(" ", entity_words(x))), lambda k: k != "")
    as_list = F.coalesce(names, empty)
    lists = [cut_lineage(bound(df.select(as_list.alias("_list")).distinct(), "_keys", F.array_distinct(keys))) for df in (findings, decisions)]
    alike = similar_names(*[x.select(F.explode("_list").alias("name")) for x in lists], limit).select("left_key", "right_key")
    of_key = alike.groupBy("left_key").agg(F.collect_set("right_key").alias("_alike"))
    each = lists[0].select("_list", F.explode("_keys").alias("left_key")).join(of_key, "left_key")
    found = each.groupBy("_list").agg(F.array_distinct(F.flatten(F.collect_list("_alike"))).alias("_found"))
    known = lists[1].select("_list", F.col("_keys").alias("_found"))
    both = [df.join(x, as_list == F.col("_list"), "left").withColumn(names, F.coalesce("_found", empty)) for df, x in ((findings, found), (decisions, known))]
    return both[0].select(*findings.columns), both[1].select(*decisions.columns)
