"""Download attempts: rules per attempt, the index of good downloads, run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.dates import any_date
from civiclink.functions.text import pad_code, trim_ws, upper_key
from civiclink.operators.headers import ascii_header, find_column, rename_all, resolve_required
from civiclink.operators.rows import exact_median, head, keep_first, keep_last, top_per_key

MIN_BYTES = 10_000
# Status codes worth another try while fetching, and the hosts of the portal.
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)
HOSTS = ("eaud", "ecgu")

# Header spellings.
PROBE_ALIASES = {
    "idtarefa": ["idtarefa", "id_tarefa", "id_da_tarefa"],
    "publication_date": ["publication_date", "data_publicacao", "data_de_publicacao"],
    "uf": ["uf", "ufs"],
    "municipality_name_raw": ["municipality_name_raw", "municipality_name_clean", "municipios", "municipio"],
    "ibge_municipality_code": ["ibge_municipality_code", "ibge"],
}
AUDIT_ID_ALIASES = ["idauditoria", "id_auditoria", "id_da_auditoria"]


def probe_table(df: DataFrame, order_by: str) -> DataFrame:
    """Tasks to download, first row per task id; fails when a needed column cannot be found."""
    src = rename_all(df, ascii_header)
    cols = resolve_required(src, PROBE_ALIASES, ascii_header)
    audit = find_column(src, AUDIT_ID_ALIASES, ascii_header)
    task = trim_ws(F.col(cols["idtarefa"]).cast("string"))
    rows = src.select(
        task.alias("idtarefa"),
        (trim_ws(F.col(audit).cast("string")) if audit else F.lit(None).cast("string")).alias("idauditoria"),
        any_date(cols["publication_date"]).alias("publication_date"),
        upper_key(cols["uf"]).alias("uf"),
        trim_ws(F.col(cols["municipality_name_raw"]).cast("string")).alias("municipality_name_raw"),
        pad_code(cols["ibge_municipality_code"]).alias("ibge_municipality_code"),
        F.col(ascii_header(order_by)).alias("_order"),
    )
    return keep_first(rows.where(F.col("idtarefa") != ""), "idtarefa", "_order").drop("_order")


def parse_hosts(text: str) -> list[str]:
    """Allowed hosts of a comma list, the first known host when none is allowed."""
    asked = [h.strip().lower() for h in text.split(",")]
    return [h for h in asked if h in HOSTS] or [HOSTS[0]]


def host_allowed(host: Column | str, hosts: str) -> Column:
    return (F.col(host) if isinstance(host, str) else host).isin(parse_hosts(hosts))


def good_download(signature_ok: Column) -> Column:
    """Status 200, large enough, known signature."""
    return F.coalesce((F.col("status_code") == 200) & (F.col("bytes_len") >= MIN_BYTES) & signature_ok, F.lit(False))


def retryable(status: str = "status_code") -> Column:
    return (F.col(status) >= 500) | (F.col(status) == -1)


def transient(status: str = "status_code") -> Column:
    return F.col(status).isin(*TRANSIENT)


def pdf_eligible() -> Column:
    """Candidate worth a download: it has a PDF link and its title names the place."""
    return (F.coalesce(F.col("pdf_url"), F.lit("")) != "") & (F.col("confidence") == "high")


def downloads_index(attempts: DataFrame, max_per_host: int = 1) -> DataFrame:
    """Good attempts in trial order, at most max_per_host per (task, host), then the last one."""
    good = attempts.where(F.col("ok"))
    kept = top_per_key(good, ["idtarefa", "host"], [F.col("seq")], max_per_host, "_rank").drop("_rank")
    return keep_last(kept, ["idtarefa", "host"], "seq")


def task_ids(df: DataFrame, column: str = "idtarefa") -> DataFrame:
    """Distinct non-blank task ids in order."""
    ids = df.select(trim_ws(F.col(column).cast("string")).alias("idtarefa"))
    return ids.where(F.col("idtarefa") != "").distinct().orderBy("idtarefa")


def failed_urls(attempts: DataFrame, n: int = 10) -> DataFrame:
    return head(attempts.where(~F.col("ok")).select("seq", "url", "status_code"), "seq", n)


def sample_urls(attempts: DataFrame, column: str = "final_url", n: int = 20) -> DataFrame:
    return head(attempts.where(F.col(column).isNotNull()).select("seq", column), "seq", n)


def medians(attempts: DataFrame) -> DataFrame:
    """Exact medians of size and duration."""
    size = exact_median(attempts, "bytes_len", "median_bytes_len")
    time = exact_median(attempts, "elapsed_ms", "median_elapsed_ms")
    return size.withColumn("median_elapsed_ms", time.scalar())


def download_summary(tasks: DataFrame, index: DataFrame) -> DataFrame:
    """Sampled tasks, successful downloads and their rate."""
    out = tasks.agg(F.count(F.lit(1)).alias("unique_idtarefa")).withColumn(
        "download_success_count", index.agg(F.count(F.lit(1))).scalar()
    )
    rate = F.col("download_success_count") / F.greatest(F.col("unique_idtarefa"), F.lit(1))
    return out.withColumn("download_success_rate", rate)
