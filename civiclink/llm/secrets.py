"""Secrets in texts, told apart from copied examples by who else has them. DataFrame functions only.

Three base kinds are found in the whole text: `assign` (a password-like name, a sign, a value of
12 or more characters), `access` (access key ids of 18 or more) and `hex` (runs of 16 or more
hexadecimal digits). A fourth kind, `generic`, takes runs of 20 or more key characters with both letters
and digits that overlap no base span.

The value of every span is hashed, and the hashes are aggregated over the corpus: a value is owned by so many
distinct repositories and owners. A value of at least `copied_owners` owners and
`copied_repos` repositories is a widely copied example; another one of `live_entropy` bits per
character or more is live-looking; the rest is weak. Base spans always stay; generic spans are added
where they are live-looking and owned by one owner alone.

Positions count code points; they are running sums of the lengths of matches and gaps, and crossings with base spans are found
by halving, so the work grows with the matches of a text times their logarithm. Values never leave the scan, only hashes do. The count of distinct owners first
drops repeated (hash, repository, owner) rows in the map tasks, so a value that a third of all
rows share costs its distinct owners only.

Null text counts as empty. A null repository or owner counts as one of its own. Repeated rows get one row each and
are one repository. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import below, bound, halvings, running, stored, text_or_empty

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LENGTH = 12
KINDS = ["assign", "access", "hex", "generic"]

COPIED_OWNERS, COPIED_REPOS, LIVE_ENTROPY = 3, 3, 3.0

EMPTY = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, value). The text between the
    matches and the matches themselves give the positions."""

    def positions(both: Column) -> Column:
        size = lambda i: F.length(F.get(both["gaps"], i)) + F.length(F.get(both["found"], i))
        ends = running(F.transform(both["found"], lambda m, i: size(i).cast("long")), lambda a, b: a + b)

        def span(m: Column, i: Column, end: Column) -> Column:
            value = F.regexp_extract(m, pattern, value_group) if value_group else m
            one = F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
            return one.cast(EMPTY.removeprefix("array<").removesuffix(">"))

        return bound(ends, lambda e: F.transform(both["found"], lambda m, i: span(m, i, F.get(e, i))))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    found = F.when(text.rlike(pattern), bound(both, positions)).otherwise(F.array().cast(EMPTY))
    return F.filter(found, lambda m: F.length(m["value"]) >= least) if least else found


def entropy(value: Column) -> Column:
    """Bits per character of the characters of a text that is not empty."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        total = F.aggregate(
            F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double")),
            F.lit(0.0),
            lambda s, k: s + k * F.log2(k),
        )
        return F.log2(n) - total / n

    return bound(F.split(value, ""), of)


def _scanned(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """row, doc_id, repo, owner and spans (start, kind, end, hash, entropy) of each row, without texts."""
    text = F.col("text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in ((repo_col, "repo"), (owner_col, "owner"))),
        text_or_empty(text_col).alias("text"),
    )
    base = F.concat(matches(text, ASSIGN, 0, 2, ASSIGN_LENGTH), matches(text, ACCESS, 1), matches(text, HEX, 2))
    rows = rows.withColumn("base", base).withColumn("more", matches(text, GENERIC, 3))

    def new(all_: Column) -> Column:
        def free(m: Column) -> Column:
            # Base spans that begin before the end of m all end before m begins: none crosses it.
            begun = below(all_["starts"], all_["steps"], m["end"])
            over = below(all_["ends"], all_["steps"], m["start"] + 1)
            return m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & (begun == over)

        return F.filter(all_["more"], free)

    sides = [F.array_sort(f"base.{side}").alias(f"{side}s") for side in ("start", "end")]
    found = bound(F.struct("more", *sides, halvings(F.col("base")).alias("steps")), new)
    spans = F.array_sort(F.concat("base", F.when(F.size("more") > 0, found).otherwise(F.col("more"))))
    judged = F.transform(
        spans,
        lambda m: F.struct(m["start"], m["kind"], m["end"], F.sha2(m["value"].cast("binary"), 256).alias("hash"), entropy(m["value"]).alias("entropy")),
    )
    return stored(rows.select("row", "doc_id", "repo", "owner", judged.alias("spans")))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, repos, owners: how many distinct repositories and owners have each value."""
    seen = scanned.select("repo", "owner", F.explode("spans.hash").alias("hash"))
    return seen.groupBy("hash").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    copied_owners: int = COPIED_OWNERS,
    copied_repos: int = COPIED_REPOS,
    live_entropy: float = LIVE_ENTROPY,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_generic,
    n_live, n_copied, and found: (start, kind, end, hash, repos, owners, verdict) of every span."""
    rows = _scanned(docs, id_col, text_col, repo_col, owner_col)
    each = rows.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    copied = (F.col("owners") >= copied_owners) & (F.col("repos") >= copied_repos)
    verdict = F.when(copied, "copied").when(F.col("s.entropy") >= live_entropy, "live").otherwise("weak")
    each = each.withColumn("hash", F.col("s.hash")).join(ownership(rows), "hash")
    each = each.where((F.col("s.kind") < 3) | ((verdict == "live") & (F.col("owners") == 1)))
    one = F.struct("s.start", "s.kind", "s.end", "hash", "repos", "owners", verdict.alias("verdict"))
    found = each.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    rows = rows.join(found, "row", "left")
    none = F.array().cast(found.schema["found"].dataType)
    rows = rows.withColumn("found", F.coalesce("found", none)).withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return rows.select(
        "doc_id",
        *(F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count(_of_kind(3)).alias("n_generic"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "copied").alias("n_copied"),
        "found",
    )


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind
