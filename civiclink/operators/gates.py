"""Quality gates: rows (gate, value, bound, ok) computed from one-row summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed bounds of the gates.
MIN_CSV_COLUMNS, MIN_CSV_ROWS = 5, 1000
MIN_REFERENCE_ROWS = 5000
MIN_COVERAGE = 0.98
MAX_FAIL_RATIO, LOW_MUNICIPALITIES = 0.5, 10
MIN_CANDIDATES, MIN_WITH_PDF = 5, 1
LARGE_SAMPLE, MIN_RATE, MIN_SMALL_SAMPLE = 10, 0.5, 5


def _gate(name: str, value: Column, bound: float, ok: Column) -> Column:
    return F.struct(
        F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(bound)).alias("bound"), ok.alias("ok")
    )


def _table(summary: DataFrame, *gates: Column) -> DataFrame:
    return summary.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def csv_gates(df: DataFrame) -> DataFrame:
    n, width = F.col("n"), F.lit(len(df.columns))
    return _table(
        df.agg(F.count(F.lit(1)).alias("n")),
        _gate("csv_columns", width, MIN_CSV_COLUMNS, width >= MIN_CSV_COLUMNS),
        _gate("csv_rows", n, MIN_CSV_ROWS, n >= MIN_CSV_ROWS),
    )


def reference_gate(reference: DataFrame) -> DataFrame:
    n = F.col("n")
    return _table(
        reference.agg(F.count(F.lit(1)).alias("n")), _gate("reference_rows", n, MIN_REFERENCE_ROWS, n >= MIN_REFERENCE_ROWS)
    )


def coverage_gates(summary: DataFrame) -> DataFrame:
    """Needs rows_after_filters, coverage_rate and long_rows."""
    rows, cover, long = F.col("rows_after_filters"), F.col("coverage_rate"), F.col("long_rows")
    every = (rows > 0) & (cover >= MIN_COVERAGE) & (long > 0)
    return _table(
        summary,
        _gate("rows_after_filters", rows, 1, rows > 0),
        _gate("located_coverage", cover, MIN_COVERAGE, cover >= MIN_COVERAGE),
        _gate("linked_rows", long, 1, long > 0),
        _gate("success", every.cast("int"), 1, every),
    )


def lottery_gates(metrics: DataFrame) -> DataFrame:
    found, ratio, places = F.col("rounds_discovered"), F.col("fail_ratio"), F.col("municipalities_extracted")
    every = (found > 0) & (ratio <= MAX_FAIL_RATIO)
    return _table(
        metrics,
        _gate("rounds_non_empty", found, 1, found > 0),
        _gate("download_fail_ratio", ratio, MAX_FAIL_RATIO, ratio <= MAX_FAIL_RATIO),
        _gate("municipalities_low_warning", places, LOW_MUNICIPALITIES, places >= LOW_MUNICIPALITIES),
        _gate("success", every.cast("int"), 1, every),
    )


def discovery_gate(candidates: DataFrame) -> DataFrame:
    with_pdf = F.count_if(F.coalesce(F.col("pdf_url"), F.lit("")) != "")
    n, pdf = F.col("n"), F.col("pdf")
    return _table(
        candidates.agg(F.count(F.lit(1)).alias("n"), with_pdf.alias("pdf")),
        _gate("candidates", n, MIN_CANDIDATES, n >= MIN_CANDIDATES),
        _gate("candidates_with_pdf", pdf, MIN_WITH_PDF, pdf >= MIN_WITH_PDF),
        _gate("success", ((n >= MIN_CANDIDATES) | (pdf >= MIN_WITH_PDF)).cast("int"), 1, (n >= MIN_CANDIDATES) | (pdf >= MIN_WITH_PDF)),
    )


def probe_gate(summary: DataFrame) -> DataFrame:
    """Needs unique_idtarefa, download_success_count and download_success_rate."""
    n, good, rate = F.col("unique_idtarefa"), F.col("download_success_count"), F.col("download_success_rate")
    ok = ((n >= LARGE_SAMPLE) & (rate >= MIN_RATE)) | ((n < LARGE_SAMPLE) & (good >= MIN_SMALL_SAMPLE))
    return _table(summary, _gate("download_success_rate", rate, MIN_RATE, ok))


def no_manual_gate(summary: DataFrame) -> DataFrame:
    n = F.col("manual_needed")
    return _table(summary, _gate("manual_needed", n, 0, n == 0))


def all_gates(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def require(gates: DataFrame) -> None:
    """Raise when a gate failed; the gate table has a handful of rows."""
    failed = [f"{r.gate}={r.value:g} (bound {r.bound:g})" for r in gates.where(~F.col("ok")).collect()]
    if failed:
        raise RuntimeError("quality gate failed: " + ", ".join(failed))
