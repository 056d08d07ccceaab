"""Landed JSON: place reference, court pages and package catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.functions.jsonx import as_text, at, members, parse, place_state
from civiclink.functions.text import match_key, pad_code, trim_ws
from civiclink.operators.rows import keep_first

# Fields read from court pages; everything else in them is ignored.
PROCESS = """struct<numeroProcesso: string, tribunal: string, grau: string, dataAjuizamento: string,
  classe: struct<codigo: string, nome: string>, orgaoJulgador: struct<nome: string, codigoMunicipioIBGE: string>,
  assuntos: array<struct<codigo: string, nome: string>>,
  movimentos: array<struct<codigo: string, nome: string, dataHora: string>>>"""
COURT_PAGE = f"struct<hits: struct<hits: array<struct<_id: string, _source: {PROCESS}>>>>"
PACKAGE = """struct<result: struct<id: string, name: string, title: string, resources: array<struct<
  id: string, name: string, url: string, format: string, created: string, last_modified: string>>>>"""


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (path, payload), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def place_items(payloads: DataFrame, order: str = "seq", payload: str = "payload") -> DataFrame:
    """Members of every JSON array with their position."""
    return payloads.select(order, F.posexplode(members(parse(payload))).alias("pos", "item"))


def place_reference(items: DataFrame, source_url: str, pulled_at_utc: str, order: str = "seq") -> DataFrame:
    """Flat reference of places: first record per code; records without a state, a numeric id of
    at most seven digits or a name are left out."""
    item = F.col("item")
    code = pad_code(as_text(at(item, "$.id")))
    name = trim_ws(as_text(at(item, "$.nome")))
    rows = items.select(
        order,
        "pos",
        code.alias("ibge_municipality_code"),
        name.alias("municipality_name_official"),
        place_state(item).alias("uf"),
    )
    good = F.col("uf").isNotNull() & F.col("ibge_municipality_code").rlike("^[0-9]{7}$") & (F.col("municipality_name_official") != "")
    first = keep_first(rows.where(good), "ibge_municipality_code", [order, "pos"])
    return first.select(
        "ibge_municipality_code",
        "municipality_name_official",
        "uf",
        match_key("municipality_name_official").alias("municipality_name_norm"),
        F.lit(source_url).alias("source_url"),
        F.lit(pulled_at_utc).alias("pulled_at_utc"),
        F.struct(order, "pos").alias("ref_order"),
    )


def reference_stats(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Records seen, places kept, and records left out for want of a state or a usable id."""
    item = F.col("item")
    ident = as_text(at(item, "$.id"))
    state = place_state(item)
    bad_id = state.isNotNull() & ~F.coalesce(ident.rlike("^[0-9]{1,7}$"), F.lit(False))
    return items.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(state.isNull()).alias("skipped_missing_uf"),
        F.count_if(bad_id).alias("rejected_id"),
    ).withColumn("parsed_ok", reference.agg(F.count(F.lit(1))).scalar())


def case_digits(c: str) -> Column:
    return F.regexp_replace(c, r"\D", "")


def court_processes(pages: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per process of landed court pages."""
    hits = F.from_json(payload, COURT_PAGE)["hits"]["hits"]
    rows = pages.select(*keep, F.explode(hits).alias("h")).select(*keep, F.col("h._id").alias("record_id"), "h._source.*")
    return rows.select(
        *keep,
        "record_id",
        "numeroProcesso",
        case_digits("numeroProcesso").alias("case_number"),
        F.col("tribunal").alias("court"),
        F.col("grau").alias("court_level"),
        F.col("dataAjuizamento").try_cast("timestamp").alias("filed_at"),
        F.col("classe.nome").alias("case_class"),
        F.col("orgaoJulgador.codigoMunicipioIBGE").alias("ibge_municipality_code"),
        F.transform("assuntos", lambda a: a["nome"]).alias("subjects"),
        "movimentos",
    )


def court_movements(processes: DataFrame, keep: list[str]) -> DataFrame:
    """One row per movement of a process, in order."""
    return processes.select(*keep, "case_number", F.posexplode("movimentos").alias("movement_order", "m")).select(
        *keep, "case_number", "movement_order", F.col("m.codigo").alias("movement_code"),
        F.col("m.nome").alias("movement_name"), F.col("m.dataHora").try_cast("timestamp").alias("moved_at"),
    )


def decision_catalogue(packages: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per resource of landed package metadata."""
    result = F.from_json(payload, PACKAGE)["result"]
    rows = packages.select(*keep, result.alias("r")).select(
        *keep, F.col("r.id").alias("package_id"), F.col("r.name").alias("package_name"),
        F.col("r.title").alias("title"), F.explode("r.resources").alias("s"),
    )
    return rows.select(
        *keep, "package_id", "package_name", "title", F.col("s.id").alias("resource_id"),
        F.col("s.name").alias("resource_name"), F.col("s.url").alias("url"), F.lower("s.format").alias("format"),
        F.coalesce("s.last_modified", "s.created").try_cast("timestamp").alias("published_at"),
    )
