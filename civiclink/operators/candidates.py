"""Findings paired with later decisions, scored links and the link graph.

findings   finding_id, ibge_municipality_code, uf, publication_date, names, keywords
decisions  decision_id, ibge_municipality_code, uf, decision_date, names, keywords, court_level
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiclink.operators.skew import salted_join
from civiclink.sources.scratch import cut_lineage

WINDOW_DAYS = 365
HIGH, MEDIUM = 0.85, 0.65
PLACE = "ibge_municipality_code"


def temporal_class(published: Column, decided: Column, window_days: int = WINDOW_DAYS) -> Column:
    """pre_audit, default or long_tail by the days between publication and decision."""
    days = F.datediff(decided, published)
    return F.when(days < 0, "pre_audit").when(days < window_days, "default").otherwise("long_tail")


def pairs_in_window(findings: DataFrame, decisions: DataFrame, window_days: int = WINDOW_DAYS, **skew) -> DataFrame:
    """Pairs of one place with the decision in [publication, publication + window).

    Time is cut into buckets of one window, so a finding meets the decisions of two (place, bucket) cells instead
    of all decisions of its place, and is shuffled twice at most.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    width = max(1, window_days)
    bucket = lambda d: F.floor(d / width)
    first, last = bucket(day("publication_date")), bucket(day("publication_date") + window_days - 1)
    left = findings.withColumnsRenamed({"uf": "finding_uf", "names": "finding_names", "keywords": "finding_keywords"})
    left = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    right = decisions.withColumnsRenamed({"uf": "decision_uf", "names": "decision_names", "keywords": "decision_keywords"})
    cell = {"_bucket": bucket(day("decision_date"))}
    met = salted_join(left, right, [PLACE, "_bucket"], F.col("finding_id"), right_keys=cell, **skew)
    days = F.datediff("decision_date", "publication_date")
    return met.where((days >= 0) & (days < window_days)).drop("_bucket").withColumn("days_after", days)


def candidate_pairs(
    findings: DataFrame, decisions: DataFrame, window_days: int = WINDOW_DAYS, horizon_days: int | None = None, **skew
) -> DataFrame:
    """Pairs in the window with their overlap features. With a horizon, later pairs up to it are kept
    as well, and temporal_class tells them from those of the default window."""
    pairs = pairs_in_window(findings, decisions, horizon_days or window_days, **skew)
    if horizon_days:
        pairs = pairs.withColumn("temporal_class", temporal_class(F.col("publication_date"), F.col("decision_date"), window_days))
    overlap = lambda what: F.size(F.array_intersect(f"finding_{what}", f"decision_{what}"))
    state_court = F.col("court_level") == "state"
    out = pairs.withColumns(
        {
            "shared_names": overlap("names"),
            "shared_keywords": overlap("keywords"),
            "jurisdiction_ok": ~state_court | (F.col("finding_uf") == F.col("decision_uf")),
        }
    )
    return out.drop("finding_names", "decision_names", "finding_keywords", "decision_keywords")


def ranked_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """All pairs with their rank per finding, by overlap, and whether they are among the first k."""
    order = [
        F.col("jurisdiction_ok").desc(), F.col("shared_names").desc(), F.col("shared_keywords").desc(),
        F.col("days_after"), F.col("decision_id"),
    ]
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("finding_id").orderBy(*order)))
    return ranked.withColumn("kept", F.col("rank") <= k)


def band(score: Column, core_evidence: Column) -> Column:
    """high needs the score and evidence on core actors or events; without it the link is medium."""
    return (
        F.when((score >= HIGH) & core_evidence, "high").when(score >= MEDIUM, "medium").otherwise("low")
    )


def downgrade(level: Column, conflict: Column) -> Column:
    """One band lower where the deterministic keys contradict the score; the pair stays."""
    lower = F.when(level == "high", "medium").otherwise("low")
    return F.when(conflict, lower).otherwise(level)


def graded_links(scored: DataFrame) -> DataFrame:
    """Needs score, core_evidence and jurisdiction_ok; adds band and band_before_conflict."""
    first = band(F.col("score"), F.col("core_evidence"))
    return scored.withColumn("band_before_conflict", first).withColumn(
        "band", downgrade(F.col("band_before_conflict"), ~F.col("jurisdiction_ok"))
    )


def without_exclusions(links: DataFrame, ledger: DataFrame) -> DataFrame:
    """Links that are not listed as known false positives."""
    return links.join(ledger.select("finding_id", "decision_id").distinct(), ["finding_id", "decision_id"], "left_anti")


def link_edges(links: DataFrame) -> DataFrame:
    """Many-to-many edges; an edge scored more than once keeps its best row. Of equal scores the better
    band wins, then the last outcome label in text order."""
    level = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("band")).alias("level")
    best = F.max(F.struct("score", level, "outcome_label", "band")).alias("_b")
    return links.groupBy("finding_id", "decision_id").agg(best).select(
        "finding_id", "decision_id", "_b.score", "_b.band", "_b.outcome_label"
    )


def strong_edges(findings: DataFrame, decisions: DataFrame, grade: Callable[[DataFrame, DataFrame], DataFrame], slices: int = 2) -> DataFrame:
    """The edges of `link_edges` above the low band, stored. `grade` pairs findings with decisions and adds score and band.

    Decisions are stored first and paired in slices by their id, so disk holds either the shuffles they come from or those
    of one slice. All rows of an edge meet in one slice. A row under MEDIUM is low and ranks behind every row that
    is not, so it is left out before rows are grouped.
    """
    decisions = cut_lineage(decisions, keep_shuffles=False)
    parts = []
    for i in range(slices):
        graded = grade(findings, decisions.where(F.pmod(F.xxhash64("decision_id"), F.lit(slices)) == i))
        parts.append(cut_lineage(link_edges(graded.where(F.col("score") >= MEDIUM)).where("band != 'low'"), keep_shuffles=False))
    return reduce(DataFrame.unionByName, parts)


def finding_summary(edges: DataFrame) -> DataFrame:
    """Per finding: best link, weighted adverse share, number of links, conflicting outcomes."""
    adverse = (F.col("outcome_label") == "adverse").cast("double")
    out = edges.groupBy("finding_id").agg(
        F.max(F.struct("score", "decision_id")).alias("_best"),
        F.count(F.lit(1)).alias("links"),
        F.sum("score").alias("_weight"),
        F.sum(F.col("score") * adverse).alias("_adverse"),
        (F.min("outcome_label") != F.max("outcome_label")).alias("conflicting_outcomes"),
    )
    weighted = F.when(F.col("_weight") > 0, F.col("_adverse") / F.col("_weight")).otherwise(F.lit(0.0))
    return out.select(
        "finding_id",
        F.col("_best.decision_id").alias("best_decision_id"),
        F.col("_best.score").alias("best_score"),
        "links",
        weighted.alias("weighted_adverse"),
        "conflicting_outcomes",
    )


def score_profile(links: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Size, range, mean and a histogram of scores per group: partial sums only."""
    bin_of = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return links.groupBy(*by).agg(
        F.count(F.lit(1)).alias("links"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
        *[F.count_if(bin_of == i).alias(f"bin_{i}") for i in range(bins)],
    )


def near_threshold(links: DataFrame, eps: float = 0.02, thresholds: tuple[float, ...] = (MEDIUM, HIGH)) -> DataFrame:
    """Links whose score lies within eps of a band limit, for manual audit."""
    gap = F.least(*[F.abs(F.col("score") - t) for t in thresholds])
    return links.withColumn("gap", gap).where(gap < eps)
