"""Sources and sinks: tables written to the shared folder and read back by the library's readers."""

from pyspark.sql import functions as F

from civiclink.operators import ladder, profile
from civiclink.operators.headers import add_missing, attach_constants, need_column, rename_all, select_present
from civiclink.plans import views  # noqa: F401
from civiclink.plans.places import LADDER_SQL, _OUT
from civiclink.plans.registry import query
from civiclink.sources import csv_files, landed, provenance, tables
from civiclink.sources.scratch import shared_folder


def _folder(df, name):
    return shared_folder(df.sparkSession, name)


def _csv_rows(t):
    return t("orders").select(
        F.col("o_orderkey").alias("Id da Tarefa"),
        F.expr("'São \"' || o_orderstatus || '\"; ' || o_orderpriority").alias("Município"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END").alias("Data de Publicação"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END").alias("FEF"),
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("Código"),
    )


_CSV = """SELECT CAST(o_orderkey AS VARCHAR) AS id_da_tarefa, 'São "' || o_orderstatus || '"; ' || o_orderpriority AS municipio,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END AS data_de_publicacao, nullif(o_orderstatus, 'F') AS fef,
  lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS codigo, '{e}' AS encoding, '{d}' AS delimiter FROM {{orders}}"""


def _round_trip(t, sep, encoding):
    rows = _csv_rows(t)
    path = _folder(rows, "csv")
    rows.write.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", "\\").csv(path)
    df, dialect = csv_files.read_csv(rows.sparkSession, path)
    return attach_constants(rename_all(df), {"encoding": dialect.encoding, "delimiter": dialect.delimiter})


@query("csv_semicolon_latin1", _CSV.replace("{e}", "ISO-8859-1").replace("{d}", ";").replace("{{", "{").replace("}}", "}"))
def _(t):
    return _round_trip(t, ";", "ISO-8859-1")


@query("csv_comma_utf8", _CSV.replace("{e}", "UTF-8").replace("{d}", ",").replace("{{", "{").replace("}}", "}"))
def _(t):
    return _round_trip(t, ",", "UTF-8")


@query("parquet_declared_schema", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_extra FROM {customer}")
def _(t):
    src = t("customer")
    path = tables.write_parquet(src, _folder(src, "parquet"))
    first = tables.first_existing(src.sparkSession, [path + "-absent", path])
    return tables.read_parquet(src.sparkSession, first, "c_custkey long, c_name string, c_extra string")


@query(
    "csv_fallback_sink",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '[\"' || c_mktsegment || '\"]' AS tags FROM {customer}",
)
def _(t):
    src = t("customer").select("c_custkey", F.array("c_mktsegment").alias("tags"))
    # A duration column does not fit parquet, which sends the table to the CSV sink.
    odd = src.withColumn("took", F.expr("make_interval(0, 1, 0, 0, 0, 0, 0)"))
    path = tables.write_with_fallback(odd, _folder(src, "sink") + ".parquet")
    return src.sparkSession.read.option("header", True).option("escape", '"').csv(path).select("c_custkey", "tags")


@query(
    "stored_summary_reused",
    LADDER_SQL + """SELECT count(*) AS total_rows_input, count(ibge_municipality_code) / greatest(count(*), 1) AS coverage_rate, true AS reused FROM answer""",
)
def _(t):
    rows, ref = t("dirty_places"), t("ref_places")
    build = lambda: ladder.match_by_lookup(rows, ref, t("alias_places"), t("override_places"))
    spark, path = rows.sparkSession, _folder(rows, "stored")
    tables.reuse_or_build(spark, path, build, profile.crosswalk_summary)
    _, summary, reused = tables.reuse_or_build(spark, path, build, profile.crosswalk_summary)
    return summary.select("total_rows_input", "coverage_rate", F.lit(reused).alias("reused"))


@query("curated_csv_tables", LADDER_SQL + f"SELECT {_OUT} FROM answer")
def _(t):
    rows = t("dirty_places")
    spark, base = rows.sparkSession, _folder(rows, "curated")
    for name in ("alias_places", "override_places"):
        tables.write_csv(t(name).drop("seq").coalesce(1), f"{base}/{name}")
    aliases = csv_files.read_aliases(spark, f"{base}/alias_places")
    overrides = csv_files.read_overrides(spark, f"{base}/override_places")
    return ladder.match_by_lookup(rows, t("ref_places"), aliases, overrides)


@query(
    "run_report_json",
    """SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys, 2 AS copies FROM {orders}""",
)
def _(t):
    summary = t("orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"), F.lit(None).cast("string").alias("note"))
    paths = tables.write_report(summary, _folder(summary, "report"), "run1")
    back = summary.sparkSession.read.schema("n long, keys long, note string").json(paths)
    return back.groupBy("n", "keys").agg(F.count(F.lit(1)).cast("int").alias("copies"))


# One text file per nation with the names of its customers, and one file each that is not there.
@query(
    "landed_file_manifest",
    """SELECT CAST(c_nationkey AS VARCHAR) AS notes, 'names' AS item_type, 'ok' AS status, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256,
    CAST(sum(length(c_name) + 1) AS BIGINT) AS size_bytes FROM {customer} GROUP BY 1
  UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), 'absent', 'failed', '', CAST(0 AS BIGINT) FROM {customer}""",
)
def _(t):
    src = t("customer").select("c_nationkey", "c_name")
    path = _folder(src, "landed")
    src.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    facts = provenance.file_facts(src.sparkSession, path).where(F.col("local_path").endswith(".txt"))
    nation = F.regexp_extract("local_path", "c_nationkey=([0-9]+)", 1).alias("notes")
    here = facts.select("local_path", F.lit("names").alias("item_type"), F.lit("ok").alias("status"), nation)
    gone = here.select(F.concat("local_path", F.lit(".gone")).alias("local_path"), F.lit("absent").alias("item_type"), F.lit("failed").alias("status"), "notes")
    wanted = here.unionByName(gone).withColumn("source_url", F.lit("generated"))
    out = provenance.manifest_rows(wanted, facts, "2026-01-01T00:00:00Z")
    return out.select("notes", "item_type", "status", "sha256", "size_bytes")


# One JSON file per nation, read back whole.
@query(
    "json_files_read_whole",
    """SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS items, CAST(sum(c_custkey) AS BIGINT) AS ids FROM {customer} GROUP BY 1""",
)
def _(t):
    src = t("customer")
    path = _folder(src, "json")
    item = F.format_string('{"id":%d,"titulo":"%s"}', "c_custkey", "c_name")
    rows = src.groupBy("c_nationkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]")).alias("value"))
    rows.write.partitionBy("c_nationkey").text(path)
    found = landed.place_items(landed.read_json_texts(src.sparkSession, f"{path}/*/*.txt"), "path")
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).alias("nation")
    number = F.try_variant_get("item", "$.id", "long")
    return found.groupBy(nation).agg(F.count(F.lit(1)).alias("items"), F.sum(number).alias("ids"))


# The curated tables do not exist yet and are seeded with their first entry.
@query(
    "seeded_curated_tables",
    """SELECT c_custkey, c_custkey % 3 = 0 AS alias_applied, CASE WHEN c_custkey % 3 = 1 THEN '2904001' END AS ibge_municipality_code,
  CASE WHEN c_custkey % 3 = 1 THEN 'override' ELSE 'unmatched' END AS match_method FROM {customer}""",
)
def _(t):
    rows = t("customer").select(
        "c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'TO' WHEN 1 THEN 'BA' ELSE 'SP' END").alias("uf"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'São Valério da Natividade' WHEN 1 THEN '- Boninau' ELSE 'x ' || c_name END").alias("municipality_name_clean"),
    )
    spark, base = rows.sparkSession, _folder(rows, "seeded")
    tables.seed_if_missing(spark, f"{base}/aliases", f"{base}/overrides")
    tables.seed_if_missing(spark, f"{base}/aliases", f"{base}/overrides")
    aliases, overrides = csv_files.read_aliases(spark, f"{base}/aliases"), csv_files.read_overrides(spark, f"{base}/overrides")
    out = ladder.match_by_lookup(rows, t("ref_places"), aliases, overrides)
    return out.select("c_custkey", "alias_applied", "ibge_municipality_code", "match_method")


@query("columns_selected_and_added", "SELECT o_orderkey AS chave, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS nota, 'x' AS fonte FROM {orders}")
def _(t):
    renamed = rename_all(t("orders").withColumnsRenamed({"o_orderkey": "Chave ", "o_orderstatus": "STATUS"}))
    picked, missing = select_present(renamed, ["chave", "status", "nota"])
    assert missing == ["nota"] and need_column(renamed, ["estado", "Status"]) == "status"
    return attach_constants(add_missing(picked, missing), {"fonte": "x"})


@query("empty_tables_keep_columns", "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS round_id, CAST(NULL AS VARCHAR) AS parse_status FROM {part}")
def _(t):
    parts = t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("round_id"))
    rounds = tables.or_empty(None, parts.sparkSession, tables.ROUNDS)
    return rounds.unionByName(parts, allowMissingColumns=True).select("round_id", "parse_status")
