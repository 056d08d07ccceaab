"""CSV files of unknown dialect, and small curated CSV tables."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.functions.text import match_key, pad_code, trim_ws, upper_key
from civiclink.sources.tables import ALIASES, OVERRIDES, empty, exists

DELIMITERS = ";,\t|"
SAMPLE_LINES, SAMPLE_CHARS = 500, 50_000
# Cell texts that mean "no value" besides the empty cell.
NULL_TEXTS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    encoding: str
    multiline: bool
    header: tuple[str, ...]
    # (header, line breaks in quotes, files) where the files of a folder differ.
    groups: tuple[tuple[tuple[str, ...], bool, tuple[str, ...]], ...] = ()


def sniff_delimiter(sample: str) -> str:
    """Delimiter of a text sample; ';' when it cannot be told."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ";"


def _cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter, quotechar='"', escapechar="\\"), [])


def detect_dialect(spark: SparkSession, path: str) -> Dialect:
    """Delimiter from the first lines; encoding and line breaks inside quotes from one scan."""
    lines = spark.read.text(path)
    # How much of the table is looked at for the delimiter. Lines are cut before they travel.
    short = lines.select(F.substring("value", 1, SAMPLE_CHARS).alias("value"))
    sample = "\n".join(r.value for r in short.limit(SAMPLE_LINES).collect())[:SAMPLE_CHARS]
    quotes = F.regexp_count(F.regexp_replace("value", r"\\.", ""), F.lit('"'))
    # The first conversion keeps the bytes as read, so invalid UTF-8 is still visible.
    per_file = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open_quote")
    )
    odd = per_file.where(~F.col("utf8") | F.col("open_quote")).collect()
    encoding = "UTF-8" if all(r.utf8 for r in odd) else "ISO-8859-1"
    # A file with line breaks in quotes is read by one task; the others are still split.
    broken = {r.file for r in odd if r.open_quote}
    delimiter = sniff_delimiter(sample)
    heads = _first_lines(spark, path, encoding)
    head = heads[0][1] if heads else ""
    if len(_cells(head, delimiter)) == 1 and ";" in sample:
        delimiter = ";"
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file, line in heads:
        groups.setdefault((tuple(_cells(line, delimiter)), file in broken), []).append(file)
    several = tuple((*kind, tuple(files)) for kind, files in groups.items()) if len(groups) > 1 else ()
    return Dialect(delimiter, encoding, bool(broken), tuple(_cells(head, delimiter)), several)


def _first_lines(spark: SparkSession, path: str, encoding: str) -> list[tuple[str, str]]:
    """(file, first line) of every file that has one, in file name order."""
    raw = spark.read.option("encoding", encoding).csv(path, sep="\x00", quote="", header=False, schema="line string")
    at = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "line")
    firsts = at.where("start = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("line", "n").alias("line"))
    return [(r.file, (r.line or "").lstrip("\ufeff")) for r in firsts.orderBy("file").collect()]


def read_csv(spark: SparkSession, path: str | list[str], dialect: Dialect | None = None) -> tuple[DataFrame, Dialect]:
    """Every column as text. Rows with too many cells are dropped, short rows are filled with null.

    Files of one folder may have different headers: each is read by its own, and columns are
    brought together by name."""
    d = dialect or detect_dialect(spark, path)
    if d.groups:
        out = None
        for header, multiline, files in d.groups:
            part, _ = read_csv(spark, list(files), Dialect(d.delimiter, d.encoding, multiline, header))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out, d
    names = [n if n else f"unnamed_{i}" for i, n in enumerate(d.header)]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "_overflow"])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", d.delimiter)
        .option("encoding", d.encoding)
        .option("quote", '"')
        .option("escape", "\\")
        .option("multiLine", d.multiline)
        .csv(path)
    )
    keep = raw.where(F.col("_overflow").isNull()).drop("_overflow")
    return keep.select(*[_no_value(f"`{n.replace('`', '``')}`").alias(n) for n in names]), d


def _no_value(name: str) -> Column:
    return F.when(~F.col(name).isin(NULL_TEXTS), F.col(name))


def _curated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small CSV with guaranteed columns: no file gives no rows, a missing column gives ''."""
    if not exists(spark, path):
        return empty(spark, schema).withColumn("seq", F.lit(0).cast("long"))
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    wanted = [c.split()[0] for c in schema.split(", ")]
    df = df.withColumns({c: F.lit("") for c in wanted if c not in df.columns})
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in wanted], F.monotonically_increasing_id().alias("seq"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    df = _curated(spark, path, ALIASES)
    return df.withColumns(
        {"uf": upper_key("uf"), "name_norm_from": match_key("name_norm_from"), "name_norm_to": match_key("name_norm_to")}
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    df = _curated(spark, path, OVERRIDES)
    return df.withColumns(
        {
            "uf": upper_key("uf"),
            "municipality_name_clean": trim_ws("municipality_name_clean"),
            "ibge_municipality_code": pad_code("ibge_municipality_code"),
        }
    )
