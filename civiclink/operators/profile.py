"""Run summaries. Each is one aggregate over the stored table, with partial sums per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.text import trim_ws
from civiclink.operators.rows import most_frequent


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def crosswalk_summary(matched: DataFrame) -> DataFrame:
    """Counts per method, alias hits, coverage and distinct names of a ladder output, in one pass:
    rows are counted per name first, so the distinct names need no second look at the table."""
    method = F.col("match_method")
    coded = F.col("ibge_municipality_code").isNotNull()
    counts = {
        "total_rows_input": F.lit(True),
        "matched_override": method == "override",
        "matched_exact": method == "exact",
        "matched_normalized_exact": method == "normalized_exact",
        "matched_fuzzy": method.isin("fuzzy_strict", "fuzzy_relaxed"),
        "matched_fuzzy_relaxed": method == "fuzzy_relaxed",
        "matched_alias_applied": coded & F.col("match_notes").contains("alias_applied:"),
        "manual_needed": method == "manual_needed",
        "unmatched": method == "unmatched",
        "_coded": coded,
    }
    per_name = matched.groupBy("uf", "municipality_name_clean").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    out = per_name.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], F.count(F.lit(1)).alias("unique_municipalities")
    )
    return out.withColumn("coverage_rate", share(F.col("_coded"), F.col("total_rows_input"))).drop("_coded")


def top_unmatched(matched: DataFrame, n: int = 30) -> DataFrame:
    """Most frequent names without a code; null names and states are groups of their own."""
    left = matched.where(F.col("match_method").isin("manual_needed", "unmatched"))
    return most_frequent(left, ["municipality_name_clean", "uf"], n)


def top_values(df: DataFrame, column: str, n: int = 20, missing: str = "<NA>") -> DataFrame:
    """Most frequent values; null counts as `missing`, an absent column as one row with count 0."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([("<missing_column>", 0)], f"{column} string, count long")
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column))
    return most_frequent(values, [column], n)


def histogram(df: DataFrame, column: str, missing: str = "<NA>", n: int | None = None) -> DataFrame:
    """Rows (value, count) of one column, all values or the n most frequent."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value"))
    if n is not None:
        return most_frequent(values, ["value"], n)
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def date_profile(df: DataFrame, column: str) -> DataFrame:
    d = F.col(column)
    return df.agg(
        share(F.count_if(d.isNull()), F.count(F.lit(1))).alias("share_missing"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max(d), "yyyy-MM-dd").alias("max_date"),
    )


def located(uf: str = "uf", name_norm: str = "municipality_name_norm") -> Column:
    """Row has a usable place: a state of two letters or more and a name that is not blank."""
    return F.coalesce(F.length(uf) >= 2, F.lit(False)) & F.coalesce(trim_ws(name_norm) != "", F.lit(False))


def located_coverage(matched: DataFrame) -> DataFrame:
    here = located()
    out = matched.agg(
        F.count_if(here).alias("rows_with_location"),
        F.count_if(here & F.col("ibge_municipality_code").isNotNull()).alias("mapped_rows"),
    )
    return out.withColumn("coverage_rate", share(F.col("mapped_rows"), F.col("rows_with_location")))


def strategy_breakdown(candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates, candidates with a PDF and errors per strategy."""
    found = candidates.groupBy(F.col("source_strategy").alias("strategy")).agg(
        F.count(F.lit(1)).alias("candidates_found"),
        F.count_if(F.coalesce(F.col("pdf_url"), F.lit("")) != "").alias("candidates_with_pdf"),
    )
    failed = failures.groupBy("strategy").agg(F.count(F.lit(1)).alias("errors"))
    return found.join(failed, "strategy", "full").na.fill(0)


def failure_reasons(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def round_metrics(rounds: DataFrame) -> DataFrame:
    out = rounds.agg(
        F.count(F.lit(1)).alias("rounds_discovered"),
        F.count_if(F.col("parse_status") == "parsed").alias("rounds_parsed_successfully"),
        F.coalesce(F.sum("parsed_municipalities_count"), F.lit(0)).alias("municipalities_extracted"),
        F.count_if(~F.col("download_ok")).alias("round_download_failures"),
    )
    return out.withColumn("fail_ratio", share(F.col("round_download_failures"), F.col("rounds_discovered")))


def round_summary(rounds: DataFrame) -> DataFrame:
    return rounds.select(
        "round_id",
        "round_label",
        F.col("round_url").alias("url"),
        F.coalesce("download_ok", F.lit(False)).alias("download_ok"),
        "parse_status",
        F.coalesce("parsed_municipalities_count", F.lit(0)).alias("municipality_count"),
        F.coalesce("primary_resource_type", F.lit("unknown")).alias("primary_resource_type"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Tasks per outcome of the detail-page step: downloaded, no link, or error by status."""
    failed = F.concat(F.lit("fetch_error_status_"), F.coalesce("status_code", F.lit(-1)).cast("string"))
    word = (
        F.when(F.col("status_code") != 200, failed)
        .when(F.col("pdf_url").isNull(), "no_pdf_link_found")
        .otherwise("downloaded")
    )
    return outcomes.groupBy(word.alias("outcome")).agg(F.count(F.lit(1)).alias("count"))
