"""Reading and writing tables: formats, fallbacks, reuse and run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, NullType, StructType

# Empty tables keep their columns, so later steps need no special case.
ROUNDS = (
    "round_id string, round_label string, round_url string, source_page_url string, discovered_at string, "
    "parse_status string, parse_reason string, parsed_municipalities_count long, raw_path string, "
    "primary_resource_type string, error_message string, download_ok boolean"
)
ROUND_PLACES = (
    "round_id string, round_label string, municipality_name_raw string, uf string, municipality_name_clean string, "
    "source_url string, source_snippet string, parse_method string, confidence string, discovered_at string"
)
CANDIDATES = (
    "candidate_id string, municipality_name string, uf string, ibge_municipality_code string, source_strategy string, "
    "landing_url string, pdf_url string, title_text string, date_text string, notes string, confidence string, "
    "discovered_at_utc string, normalized_muni_name string, query_terms_used string"
)
FETCH_ATTEMPTS = (
    "run_id string, strategy string, municipality_ibge string, url string, status_code int, content_type string, "
    "final_url string, bytes_len long, elapsed_ms double, ok boolean, error string"
)
ALIASES = "uf string, name_norm_from string, name_norm_to string, note string, source string"
OVERRIDES = "uf string, municipality_name_clean string, ibge_municipality_code string, note string"

# The first entry of each curated table.
SEED_ALIAS = ("TO", "SAO VALERIO DA NATIVIDADE", "SAO VALERIO", "historic name", "project_seed")
SEED_OVERRIDE = ("BA", "- Boninau", "2904001", "CGU list typo/formatting; intended Boninal")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"expected one of: {', '.join(paths)}")


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet with a declared schema: no footer inference, and only the named columns exist."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def write_with_fallback(df: DataFrame, path: str) -> str:
    """Parquet, or CSV beside it when the columns do not fit parquet; the path that was written.
    The schema decides before anything runs."""
    if all(fits_parquet(f.dataType) for f in df.schema.fields):
        return write_parquet(df, path)
    stem = path[: -len(".parquet")] if path.endswith(".parquet") else path
    flat = [
        F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct", "variant") else F.col(c)
        for c in df.columns
    ]
    text = df.select(*[f.cast("string") for f in flat])
    return write_csv(text.toDF(*df.columns), stem + ".csv")


def fits_parquet(kind: DataType) -> bool:
    """Whether parquet can store a column of this type."""
    if isinstance(kind, ArrayType):
        return fits_parquet(kind.elementType)
    if isinstance(kind, MapType):
        return fits_parquet(kind.keyType) and fits_parquet(kind.valueType)
    if isinstance(kind, StructType):
        return bool(kind.fields) and all(fits_parquet(f.dataType) for f in kind.fields)
    return not isinstance(kind, (CalendarIntervalType, NullType))


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def or_empty(df: DataFrame | None, spark: SparkSession, schema: str) -> DataFrame:
    return empty(spark, schema) if df is None else df


def seed_if_missing(spark: SparkSession, alias_path: str, override_path: str) -> None:
    """Write the curated tables with one entry each where they do not exist yet."""
    for path, row, schema in ((alias_path, SEED_ALIAS, ALIASES), (override_path, SEED_OVERRIDE, OVERRIDES)):
        if not exists(spark, path):
            write_csv(spark.createDataFrame([row], schema), path)


def reuse_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], summarise: Callable[[DataFrame], DataFrame], force: bool = False
) -> tuple[DataFrame, DataFrame, bool]:
    """Stored table, its summary, and whether it was already there. `build` runs only if needed;
    the summary is always computed over the stored table."""
    reused = exists(spark, path) and not force
    if not reused:
        write_parquet(build(), path)
    stored = spark.read.parquet(path)
    return stored, summarise(stored), reused


def write_report(report: DataFrame, folder: str, run_id: str) -> list[str]:
    """One-row summary as JSON text, under its run id and as the latest one."""
    text = report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    paths = [f"{folder}/{run_id}_report", f"{folder}/latest"]
    text.coalesce(1).write.mode("overwrite").text(paths[0])
    # The report is computed once; the second copy is made from the first.
    report.sparkSession.read.text(paths[0]).coalesce(1).write.mode("overwrite").text(paths[1])
    return paths
