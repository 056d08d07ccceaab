"""Enforcement outcomes per place and year, threshold grids, panels and balance tables.

links  finding_id, ibge_municipality_code, publication_date, severity_level, decision_id,
       decision_date, outcome_label, legal_stage, court_level, decision_type, score
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.sources.scratch import cut_lineage

PLACE = "ibge_municipality_code"
# Default weights; pass others where a protocol fixes them.
SEVERITY = {"low": 1.0, "medium": 2.0, "high": 3.0}
OUTCOME = {"adverse": 1.0, "neutral": 0.25, "non_punishment": 0.0, "unknown": 0.0}
STAGE = {"first_instance": 1.0, "appeal": 1.5, "final": 2.0}
CUTOFFS = {"strict": 0.85, "medium": 0.65, "permissive": 0.0}


def _weight(column: str, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(column)), F.lit(0.0))


def weighed(df: DataFrame) -> DataFrame:
    """With `severity`, `adverse` and `intensity` beside the texts they follow from, as far as `df` has those. Findings
    and decisions that are weighed before they are paired are shuffled without the texts."""
    made = {
        "severity": (("severity_level",), lambda: _weight("severity_level", SEVERITY)),
        "adverse": (("outcome_label",), lambda: F.col("outcome_label") == "adverse"),
        "intensity": (("outcome_label", "legal_stage"), lambda: _weight("outcome_label", OUTCOME) * _weight("legal_stage", STAGE)),
    }
    return df.withColumns({c: value() for c, (needs, value) in made.items() if c not in df.columns and {*needs} <= {*df.columns}})


def enforcement_indices(links: DataFrame, years: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Indices per place and decision year, optionally split by further columns. Links need not be weighed before.

    Two steps: links collapse to findings first, then findings to places, so a place with a
    third of all links is already reduced when it reaches one task.
    """
    links = weighed(links)
    adverse = F.col("adverse")
    days = F.datediff("decision_date", "publication_date")
    in_time = F.col("decision_date") <= F.add_months("publication_date", 12 * years)
    keys = [PLACE, "year", *by]
    per_finding = (
        links.withColumn("year", F.year("decision_date"))
        .groupBy(*keys, "finding_id")
        .agg(
            F.count(F.lit(1)).alias("_links"),
            F.count_if(adverse).alias("_adverse"),
            F.max((adverse & in_time).cast("int")).alias("_any"),
            F.sum(F.when(adverse, F.col("severity")).otherwise(0.0)).alias("_severity"),
            F.min(F.when(adverse, days)).alias("_first"),
            F.sum("intensity").alias("_intensity"),
        )
    )
    return per_finding.groupBy(*keys).agg(
        F.sum("_links").alias("links"),
        F.sum("_adverse").alias("adverse_count"),
        F.max("_any").alias("any_punishment"),
        F.sum("_severity").alias("severity_weighted"),
        F.min("_first").alias("days_to_first_adverse"),
        (F.count_if(F.col("_adverse") > 0) / F.count(F.lit(1))).alias("p_punished_given_linked"),
        F.sum("_intensity").alias("enforcement_intensity"),
    )


def under_cutoffs(links: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """Each link once per cut-off it passes, with the name of the cut-off."""
    grid = F.array(
        *[F.struct(F.lit(n).alias("cutoff"), F.lit(v).alias("limit")) for n, v in (cutoffs or CUTOFFS).items()]
    )
    passed = F.filter(grid, lambda c: F.col("score") >= c["limit"])
    return links.withColumn("_c", F.explode(passed)).withColumn("cutoff", F.col("_c.cutoff")).drop("_c")


def indices_by_cutoff(links: DataFrame, cutoffs: dict[str, float] | None = None, years: int = 3) -> DataFrame:
    return enforcement_indices(under_cutoffs(links, cutoffs), years, ("cutoff",))


def outcome_bounds(links: DataFrame, lower: str = "strict", upper: str = "permissive") -> DataFrame:
    """Adverse count per place and year from the strictest and the most permissive links."""
    adverse = F.col("outcome_label") == "adverse"
    count = lambda name: F.count_if(adverse & (F.col("score") >= CUTOFFS[name]))
    return links.groupBy(PLACE, F.year("decision_date").alias("year")).agg(
        count(lower).alias("lower_bound"), count("medium").alias("adverse_medium"), count(upper).alias("upper_bound")
    )


def first_exposure(findings: DataFrame) -> DataFrame:
    return findings.groupBy(PLACE).agg(F.min(F.year("publication_date")).alias("first_exposure"))


def panel(places: DataFrame, exposure: DataFrame, outcomes: DataFrame, controls: DataFrame | None = None, span: int = 3) -> DataFrame:
    """Every place in every year with exposure, event time, outcomes (0 where none) and controls. The
    years run from the first to the last one of the outcomes and first exposures. Both are used twice and
    stored when the panel is called, so that links are paired once."""
    exposure, outcomes = cut_lineage(exposure), cut_lineage(outcomes)
    seen = outcomes.select("year").unionByName(exposure.select(F.col("first_exposure").alias("year")))
    bounds = {"_lo": seen.agg(F.min("year")).scalar(), "_hi": seen.agg(F.max("year")).scalar()}
    grid = places.select(PLACE).distinct().withColumns(bounds).withColumn("year", F.explode(F.sequence("_lo", "_hi")))
    grid = grid.drop(*bounds).join(exposure, PLACE, "left")
    out = grid.join(outcomes, [PLACE, "year"], "left")
    measured = [c for c in outcomes.columns if c not in (PLACE, "year")]
    event_time = F.col("year") - F.col("first_exposure")
    out = out.withColumns(
        {
            "exposed": F.coalesce(event_time >= 0, F.lit(False)),
            "event_time": event_time,
            "event_bin": F.greatest(F.least(event_time, F.lit(span)), F.lit(-span)),
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in measured},
        }
    )
    return out if controls is None else out.join(controls, PLACE, "left")


def balance(df: DataFrame, group: list[str], treated: str, covariates: list[str]) -> DataFrame:
    """Means by treatment and standardised mean difference per covariate and group."""
    values = F.explode(
        F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value")) for c in covariates])
    )
    long = df.select(*group, F.col(treated).alias("_t"), values.alias("_v")).select(*group, "_t", "_v.*")
    on = lambda flag: F.when(F.col("_t") == flag, F.col("value"))
    out = long.groupBy(*group, "covariate").agg(
        F.count(on(True)).alias("n_treated"), F.count(on(False)).alias("n_control"),
        F.avg(on(True)).alias("mean_treated"), F.avg(on(False)).alias("mean_control"),
        F.var_samp(on(True)).alias("_v1"), F.var_samp(on(False)).alias("_v0"),
    )
    spread = F.sqrt((F.col("_v1") + F.col("_v0")) / 2)
    difference = F.when(spread > 0, (F.col("mean_treated") - F.col("mean_control")) / spread)
    return out.withColumn("standardised_difference", difference).drop("_v1", "_v0")


def event_means(panel_rows: DataFrame, outcome: str) -> DataFrame:
    """Cell means by event time; negative bins are the pre-trend."""
    return panel_rows.where(F.col("event_bin").isNotNull()).groupBy("event_bin").agg(
        F.avg(outcome).alias("mean_outcome"), F.count(F.lit(1)).alias("cells")
    )


def exposure_contrast(panel_rows: DataFrame, outcome: str) -> DataFrame:
    """Per year: mean outcome of exposed and of not-yet-exposed places."""
    side = lambda flag: F.avg(F.when(F.col("exposed") == flag, F.col(outcome)))
    return panel_rows.groupBy("year").agg(
        side(True).alias("mean_exposed"), side(False).alias("mean_not_yet"),
        F.count_if("exposed").alias("n_exposed"), F.count_if(~F.col("exposed")).alias("n_not_yet"),
    )
