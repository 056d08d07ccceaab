"""Selected places linked to audits on (code, state).

The long table is a many-to-many join, so hot places are salted. The wide table never touches
the fan-out: each side is reduced to distinct values per place first, and the sides meet once
per place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.dates import iso_text
from civiclink.functions.text import pad_code, trim_ws, upper_key
from civiclink.functions.urls import REPORTS_UI, report_page
from civiclink.operators.headers import select_present
from civiclink.operators.rows import first_non_null
from civiclink.operators.skew import salted_join

KEYS = ["ibge_municipality_code", "uf"]
RULE = "ibge_exact"
# Column names of the linked tables.
AUDIT_COLUMNS = [
    "municipality_name_raw", "municipality_name_clean", "id_da_tarefa", "id_da_auditoria", "titulo_do_relatorio",
    "publication_date", "data_de_publicacao", "grupoatividade", "linhaacao", "tiposervico", "fef",
    "edicao_programa_sorteio_fef",
]
# Wide list column -> column of the selection table or of the audit table.
LOTTERY_LISTS = {"lottery_round_ids": "round_id", "lottery_round_labels": "round_label"}
AUDIT_LISTS = {
    "audit_task_id": "id_da_tarefa", "audit_title": "titulo_do_relatorio", "audit_audit_id": "id_da_auditoria",
    "grupoatividade": "grupoatividade", "linhaacao": "linhaacao", "tiposervico": "tiposervico", "fef": "fef",
    "edition_program_sorteio_fef": "edicao_programa_sorteio_fef",
}
DATES = "audit_publication_date"


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({KEYS[0]: pad_code(KEYS[0]), KEYS[1]: upper_key(KEYS[1])}).dropna(subset=KEYS)


def linkable_selection(lottery: DataFrame) -> DataFrame:
    return _keyed(lottery).select(*KEYS, "municipality_name_clean", "round_id", "round_label", "seq")


def linkable_audits(audits: DataFrame) -> tuple[DataFrame, list[str]]:
    """Audits with both keys; the raw name and the date fall back to their twins. The second
    value names the optional columns that are missing."""
    present, missing = select_present(_keyed(audits), [*KEYS, "seq", *AUDIT_COLUMNS])
    for name, twin, kind in (
        ("municipality_name_raw", "municipality_name_clean", "string"),
        ("publication_date", "data_de_publicacao", "timestamp"),
    ):
        if name not in present.columns:
            present = present.withColumn(name, F.col(twin) if twin in present.columns else F.lit(None).cast(kind))
    return present, missing


def link_long(lottery: DataFrame, audits: DataFrame, **skew) -> DataFrame:
    """One row per (selection, audit) of a place; selections without an audit stay."""
    left = linkable_selection(lottery).withColumnsRenamed({"seq": "lottery_seq", "municipality_name_clean": "municipality_name"})
    right, _ = linkable_audits(audits)
    right = right.withColumnsRenamed({"seq": "audit_seq"}).drop("municipality_name_clean", "data_de_publicacao")
    out = salted_join(left, right, KEYS, F.col("lottery_seq"), "left", **skew)
    none = F.lit(None).cast("string")
    renamed = {"idtarefa": "id_da_tarefa", "idauditoria": "id_da_auditoria", "titulo": "titulo_do_relatorio"}
    optional = [*renamed.values(), "grupoatividade", "linhaacao", "tiposervico", "fef", "edicao_programa_sorteio_fef"]
    out = out.withColumns({c: none for c in optional if c not in out.columns})
    return out.withColumnsRenamed({v: k for k, v in renamed.items()}).withColumns(
        {
            "eaud_relatorio_url": report_page("idtarefa"),
            "eaud_relatorios_ui": F.lit(REPORTS_UI),
            "link_rule_used": F.lit(RULE),
            "pdf_url": none,
            "pdf_sha256": none,
        }
    )


def attach_reports(long: DataFrame, reports: DataFrame) -> DataFrame:
    """Fill pdf_url and pdf_sha256 from a table with one row per task id."""
    found = reports.select("idtarefa", F.col("url").alias("pdf_url"), F.col("sha256").alias("pdf_sha256"))
    return long.drop("pdf_url", "pdf_sha256").join(found, "idtarefa", "left")


def _values(df: DataFrame, fields: dict[str, str], repeated: dict[str, Column] | None = None) -> DataFrame:
    """(keys, field, value, seq): each distinct non-blank value with its first position; fields in
    `repeated` keep every occurrence. Duplicates collapse in the map tasks."""
    blank_free = [
        F.struct(F.lit(f).alias("field"), trim_ws(F.col(c).cast("string")).alias("value"), F.lit(-1).cast("long").alias("_occ"))
        for f, c in fields.items()
        if c in df.columns
    ]
    blank_free += [
        F.struct(F.lit(f).alias("field"), c.alias("value"), F.col("seq").cast("long").alias("_occ"))
        for f, c in (repeated or {}).items()
    ]
    rows = df.select(*KEYS, "seq", F.explode(F.array(*blank_free)).alias("_v")).select(*KEYS, "seq", "_v.*")
    rows = rows.where(F.col("value") != "")
    return rows.groupBy(*KEYS, "field", "value", "_occ").agg(F.min("seq").alias("seq"))


def place_values(lottery: DataFrame, audits: DataFrame) -> DataFrame:
    """Long form of the wide lists: one row per place, field and value with its first position."""
    right, _ = linkable_audits(audits)
    left = linkable_selection(lottery)
    mine = _values(left, LOTTERY_LISTS)
    linked = right.join(left.select(*KEYS).distinct(), KEYS, "left_semi")
    theirs = _values(linked, AUDIT_LISTS, {DATES: iso_text("publication_date")})
    return mine.unionByName(theirs).drop("_occ")


def link_wide(lottery: DataFrame, audits: DataFrame) -> DataFrame:
    """One row per place with ordered lists of distinct values, at every size.

    This is the view for people and exports, and a list is as long as its place has values. Work that
    has to scale with one place reads `place_values`, which has the same values as rows with their
    position. The date list keeps repeated dates. The fan-out of selections against audits
    would repeat the whole list once per selection; `repeat_dates` gives that form.
    """
    left = linkable_selection(lottery)
    right, _ = linkable_audits(audits)
    values = place_values(lottery, audits)
    fields = [*LOTTERY_LISTS, *AUDIT_LISTS, DATES]
    lists = values.groupBy(*KEYS).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("seq", "value")))).alias(f) for f in fields]
    )
    lists = lists.select(*KEYS, *[F.transform(f, lambda x: x["value"]).alias(f) for f in fields])
    places = left.groupBy(*KEYS).agg(
        first_non_null("municipality_name_clean", "seq").alias("municipality_name"),
        first_non_null(F.nullif(trim_ws("round_label"), F.lit("")), "seq").alias("first_lottery_round"),
        F.count(F.lit(1)).alias("lottery_rows"),
    )
    raw = right.groupBy(*KEYS).agg(first_non_null("municipality_name_raw", "seq").alias("municipality_name_raw"))
    out = places.join(raw, KEYS, "left").join(lists, KEYS, "left")
    empty = F.array().cast("array<string>")
    return out.select(
        *KEYS,
        "municipality_name",
        "municipality_name_raw",
        *[F.coalesce(f, empty).alias(f) for f in LOTTERY_LISTS],
        "first_lottery_round",
        F.coalesce("audit_task_id", empty).alias("audit_task_id"),
        F.coalesce(DATES, empty).alias(DATES),
        *[F.coalesce(f, empty).alias(f) for f in AUDIT_LISTS if f != "audit_task_id"],
        F.lit(RULE).alias("link_rule_used"),
        "lottery_rows",
    )


def repeat_dates(wide: DataFrame) -> DataFrame:
    """Date list as the fan-out would give it: once per selection of the place."""
    return wide.withColumn(DATES, F.flatten(F.array_repeat(F.col(DATES), F.col("lottery_rows").cast("int"))))


def link_coverage(lottery: DataFrame, audits: DataFrame) -> DataFrame:
    """Places selected, places with an audit, and their share."""
    right, _ = linkable_audits(audits)
    mine = linkable_selection(lottery).select(*KEYS).distinct()
    theirs = right.select(*KEYS).distinct().withColumn("_hit", F.lit(1))
    out = mine.join(theirs, KEYS, "left").agg(
        F.count(F.lit(1)).alias("num_lottery_municipalities"),
        F.count("_hit").alias("num_lottery_municipalities_with_audit"),
    )
    share = F.col("num_lottery_municipalities_with_audit") / F.greatest(F.col("num_lottery_municipalities"), F.lit(1))
    return out.withColumn("lottery_municipality_coverage_with_audits", share)


def audits_per_year(audits: DataFrame) -> DataFrame:
    """Linkable audits per publication year, in year order."""
    right, _ = linkable_audits(audits)
    year = F.year("publication_date")
    dated = right.where(F.col("publication_date").isNotNull())
    return dated.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("count")).orderBy("year")
