"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.llm.common import read
from civiclink.llm.crosstok import token_links
from civiclink.llm.decontaminate import contamination
from civiclink.llm.divergence import divergence
from civiclink.llm.exact import exact_duplicates
from civiclink.llm.langid import language_table
from civiclink.llm.licenses import license_scan
from civiclink.llm.lines import line_dedup
from civiclink.llm.mixing import mixed
from civiclink.llm.planes import binary_ids
from civiclink.llm.secrets import secrets
from civiclink.llm.sharding import shard_table
from civiclink.llm.simhash import near_duplicates
from civiclink.llm.tokens import Rollup, count_bytes, count_tokens
from civiclink.sources.scratch import shared_folder

SHARDS = 24
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k"
END_ID = 2
MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.drop("items")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_table(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(read(spark, sf_dir, "documents"), SHARDS)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stands for a repository, every source for an owner."""
    return secrets(read(spark, sf_dir, "documents")).drop("found")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("found")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(read(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, limit=2.0, shards=SHARDS)
    listed = F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards")
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", listed)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents, the same batch once more (which changes nothing), new
    counts for the documents that lose a mail address, and a takedown of documents labelled toxic. Only
    ids and counts are ever joined, texts stay in the scan."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rollup = Rollup(spark, shared_folder(spark, "tokens"), docs.schema["doc_id"].dataType.simpleString())
    counted = lambda rows: count_tokens(rows, TOKENIZER, RANKS_FILE).unionByName(count_bytes(rows))
    rollup.commit("load", counted(docs))
    rollup.commit("load", counted(docs))
    scrubbed = docs.where(F.col("text").contains("@") & F.col("text").rlike(MAIL)).withColumn("text", F.regexp_replace("text", MAIL, ""))
    rollup.commit("scrubbed", revised=counted(scrubbed))
    rollup.commit("takedown", deletes=labels.where("toxic = 1").select("doc_id").distinct())
    return rollup.totals()


def op11_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shared_folder(spark, "ids")
    return binary_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), files, END_ID)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return token_links(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"), min_docs=10, top=10)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, item, p, dw.n FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _spans_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind: the text between two matches gives the distance from one to the next."""
    value = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""SELECT doc_id, {kind} AS kind, v AS value, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start, length(m) AS n FROM
  (SELECT doc_id, unnest(list_slice(string_split_regex(t, '{pattern}'), 1, -2)) AS gap, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest({value}) AS v,
    unnest(range(len({value}))) AS i FROM t WHERE regexp_matches(t, '{pattern}')) QUALIFY length(v) >= {least}"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP7_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_spans_sql(0, _ASSIGN, 2, 12)} UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]{14,}", 0, 0)} UNION ALL {_spans_sql(2, "[0-9a-f]{16,}", 0, 0)}),
more AS ({_spans_sql(3, "[A-Za-z0-9+/_=-]{20,}", 0, 0)}),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.start + m.n AND m.start < b.start + b.n)),
owned AS (SELECT value, count(DISTINCT doc_id) AS repos, count(DISTINCT coalesce('=' || source, '')) AS owners FROM spans JOIN t USING (doc_id) GROUP BY value),
chars AS (SELECT value, c, count(*) AS k FROM (SELECT value, unnest(string_split(value, '')) AS c FROM owned) GROUP BY 1, 2),
bits AS (SELECT value, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy FROM chars GROUP BY value),
judged AS (SELECT spans.*, owners, CASE WHEN owners >= 3 AND repos >= 3 THEN 'copied' WHEN entropy >= 3 THEN 'live' ELSE 'weak' END AS verdict,
  CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'generic' END || ':' || start || ':' || (start + n) AS label
  FROM spans JOIN owned USING (value) JOIN bits USING (value)),
kept AS (SELECT * FROM judged WHERE kind < 3 OR (verdict = 'live' AND owners = 1)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(label, ',' ORDER BY start, kind, n) FILTER (WHERE kind < 3) AS base, string_agg(label, ',' ORDER BY start, kind, n) AS spans,
  count(*) FILTER (WHERE kind = 3) AS n_generic, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_generic, 0) AS n_generic, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN g USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * v) AS q FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_exact_dedup, op3_decontamination, op4_line_dedup, op5_language_id, op6_sharding,
        op7_secrets, op8_licenses, op9_mixing, op10_token_counts, op11_binary_ids, op12_token_alignment, op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op7_secrets": OP7_SQL, "op13_source_divergence": OP13_SQL}
