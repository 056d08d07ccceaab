"""Place names to official codes: alias, override, exact, normalised and fuzzy steps.

The steps run once per distinct (state, name), not once per row, and the answer is joined back
to the rows, so a name that fills a third of the table costs as much as a rare one.

`match_places` and `review_candidates` store the reference columns in use, the distinct names with their
lookups and the two sides of the fuzzy step in the shared folder, each once, when they are called. So rows are read
twice (for their names, and for the answer), the reference once, and no step plans another one again.

Tables:
  rows       uf, municipality_name_clean, any other columns
  reference  ibge_municipality_code, municipality_name_official, uf, municipality_name_norm, ref_pos
  aliases    uf, name_norm_from, name_norm_to, note, seq
  overrides  uf, municipality_name_clean, ibge_municipality_code, note, seq
ref_pos and seq give the row order: later rows win in the lookups, earlier ones among equal
fuzzy scores.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.similarity import NameBlock
from civiclink.functions.text import join_notes, match_key, pad_code, trim_ws, upper_key
from civiclink.operators.rows import top_per_key
from civiclink.operators.skew import key_counts
from civiclink.sources.scratch import cut_lineage

STRICT_DEFAULT = 92.0
RELAXED_SCORE, RELAXED_MARGIN, RELAXED_EDITS = 85.0, 10.0, 2
SUGGESTIONS = 5
REFERENCE = ["ibge_municipality_code", "municipality_name_official", "uf", "municipality_name_norm", "ref_pos"]
# Reference names and open names of one scoring cell.
BLOCK_NAMES, CELL_NAMES = 4096, 512

_CANDIDATE = (
    "uf string, name_norm string, score double, ref_pos long, candidate string, code string, official string"
)


def _latest(df: DataFrame, keys: dict, value: dict, order: str) -> DataFrame:
    """One row per key: the values of the row with the largest order value."""
    keyed = df.select(
        *[k.alias(n) for n, k in keys.items()], F.struct(*[v.alias(n) for n, v in value.items()]).alias("_v"), order
    )
    return keyed.groupBy(*keys).agg(F.max_by("_v", order).alias("_v")).select(*keys, "_v.*")


def distinct_names(rows: DataFrame) -> DataFrame:
    """Distinct non-null (uf, name) of the rows with the number of rows, _n."""
    return key_counts(_keyed(rows), ["_uf", "_name"]).dropna(subset=["_uf", "_name"])


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_uf", upper_key("uf")).withColumn(
        "_name", trim_ws(F.col("municipality_name_clean").cast("string"))
    )


def apply_aliases(names: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Add name_norm (replaced where an alias fits), alias_applied and the alias note."""
    out = names.withColumn("_raw", match_key("_name"))
    if aliases is None:
        return out.select(
            "*", F.col("_raw").alias("name_norm"), F.lit(False).alias("alias_applied"), F.lit("").alias("alias_note")
        ).drop("_raw")
    lookup = _latest(
        aliases,
        {"_uf": upper_key("uf"), "_raw": match_key("name_norm_from")},
        {"_to": match_key("name_norm_to")},
        "seq",
    )
    hit = F.col("_to").isNotNull()
    note = F.concat(F.lit("alias_applied:"), F.col("_raw"), F.lit("->"), F.col("_to"))
    return (
        out.join(lookup, ["_uf", "_raw"], "left")
        .withColumn("name_norm", F.coalesce("_to", "_raw"))
        .withColumn("alias_applied", hit)
        .withColumn("alias_note", F.when(hit, note).otherwise(""))
        .drop("_raw", "_to")
    )


def apply_overrides(names: DataFrame, reference: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Add ov_code, ov_official and ov_note; an unknown code is kept without an official name."""
    if overrides is None:
        none = F.lit(None).cast("string")
        return names.select("*", none.alias("ov_code"), none.alias("ov_official"), none.alias("ov_note"))
    lookup = _latest(
        overrides,
        {"_uf": upper_key("uf"), "_name": trim_ws("municipality_name_clean")},
        {"ov_code": pad_code("ibge_municipality_code"), "_note": F.coalesce("note", F.lit(""))},
        "seq",
    )
    by_code = _latest(
        reference,
        {"ov_code": pad_code("ibge_municipality_code")},
        {"ov_official": F.col("municipality_name_official")},
        "ref_pos",
    )
    note = F.when(F.col("_note") != "", F.concat(F.lit("override_applied:"), F.col("_note"))).otherwise(
        "override_applied"
    )
    return (
        names.join(lookup, ["_uf", "_name"], "left")
        .join(by_code, "ov_code", "left")
        .withColumn("ov_note", F.when(F.col("ov_code").isNotNull(), note))
        .drop("_note")
    )


def apply_exact(names: DataFrame, reference: DataFrame) -> DataFrame:
    """Add ex_code/ex_official by upper-case name and no_code/no_official by normalised name."""
    code, official = pad_code("ibge_municipality_code"), F.col("municipality_name_official")
    exact = _latest(
        reference, {"_uf": F.col("uf"), "_exact": upper_key(official)}, {"ex_code": code, "ex_official": official}, "ref_pos"
    )
    normal = _latest(
        reference,
        {"_uf": F.col("uf"), "name_norm": F.col("municipality_name_norm")},
        {"no_code": code, "no_official": official},
        "ref_pos",
    )
    return (
        names.withColumn("_exact", upper_key("_name"))
        .join(exact, ["_uf", "_exact"], "left")
        .join(normal, ["_uf", "name_norm"], "left")
        .drop("_exact")
    )


def lookup_ladder(
    rows: DataFrame, reference: DataFrame, aliases: DataFrame | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """Distinct names with the answer of the lookup steps; match_method is null where none fits."""
    names = apply_exact(apply_overrides(apply_aliases(distinct_names(rows), aliases), reference, overrides), reference)
    by_override, by_exact, by_norm = (F.col(c).isNotNull() for c in ("ov_code", "ex_code", "no_code"))
    return names.select(
        "_uf",
        "_name",
        "_n",
        "name_norm",
        "alias_applied",
        F.coalesce("ov_code", "ex_code", "no_code").alias("ibge_municipality_code"),
        F.when(by_override, "override").when(by_exact, "exact").when(by_norm, "normalized_exact").alias("match_method"),
        F.when(by_override | by_exact | by_norm, 1.0).alias("match_score"),
        F.when(by_override, F.col("ov_official"))
        .when(by_exact, F.col("ex_official"))
        .otherwise(F.col("no_official"))
        .alias("matched_name_official"),
        join_notes("alias_note", "ov_note").alias("match_notes"),
    )


def _score_block(names: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    columns = ["uf", "name_norm", "score", "ref_pos", "candidate", "code", "official"]
    if names.empty or block.empty:
        return pd.DataFrame(columns=columns)
    scorer = NameBlock(block["candidate"].tolist())
    places = [list(p) for p in block["positions"]]
    weight = [len(p) for p in places]
    uf, codes, officials = names["uf"].iat[0], block["code"].tolist(), block["official"].tolist()
    out = []
    for name in names["name_norm"]:
        # Rounded, so that scores equal up to floating-point noise tie and keep reference order.
        hits = [(-round(s, 9), pos, row) for s, row in scorer.best(name, weight, SUGGESTIONS) for pos in places[row]]
        for minus, pos, row in sorted(hits)[:SUGGESTIONS]:
            out.append((uf, name, -minus, pos, scorer.names[row], codes[row], officials[row]))
    return pd.DataFrame(out, columns=columns)


def fuzzy_candidates(names: DataFrame, reference: DataFrame) -> DataFrame:
    """Best five reference names of the same state for every distinct (uf, name_norm), ranked.

    Each state is cut as its own size needs: its open names over salts, its reference names over
    chunks, both from one count per state that is joined in the plan. A cell holds about CELL_NAMES
    open names and BLOCK_NAMES reference names, and only five rows per name leave it.
    """
    parts = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    opened = cut_lineage(names.select("uf", "name_norm").distinct())
    places = top_per_key(reference, ["uf", "municipality_name_norm"], [F.col("ref_pos")], SUGGESTIONS, "_place")
    blocks = (
        places.groupBy("uf", F.col("municipality_name_norm").alias("candidate"))
        .agg(
            F.min_by(F.struct(pad_code("ibge_municipality_code").alias("code"), "municipality_name_official"), "_place").alias("_f"),
            F.array_sort(F.collect_list("ref_pos")).alias("positions"),
        )
        .select("uf", "candidate", "_f.code", F.col("_f.municipality_name_official").alias("official"), "positions")
    )
    # Both sides are read twice, for their sizes and for their rows.
    blocks = cut_lineage(blocks)
    salts = opened.groupBy("uf").agg(parts(F.count(F.lit(1)), CELL_NAMES).alias("_salts"))
    chunks = blocks.groupBy("uf").agg(parts(F.count(F.lit(1)), BLOCK_NAMES).alias("_chunks"))
    sizes = salts.join(chunks, "uf")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    wanted = opened.join(sizes, "uf").select(
        "uf", "name_norm", F.pmod(F.xxhash64("name_norm"), F.col("_salts")).alias("_salt"), up_to("_chunks").alias("_chunk")
    )
    blocks = blocks.join(sizes, "uf").select(
        "uf", "candidate", "code", "official", "positions",
        F.pmod(F.xxhash64("candidate"), F.col("_chunks")).alias("_chunk"), up_to("_salts").alias("_salt"),
    )
    # Scoring costs far more than its few bytes suggest, so the number of tasks is set here:
    # adaptive execution merges partitions by bytes and would leave too few.
    by = ["uf", "_salt", "_chunk"]
    tasks = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted, blocks = wanted.repartition(tasks, *by), blocks.repartition(tasks, *by)
    scored = wanted.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(_score_block, _CANDIDATE)
    return top_per_key(scored, ["uf", "name_norm"], [F.col("score").desc(), F.col("ref_pos")], SUGGESTIONS)


def fuzzy_decisions(candidates: DataFrame, threshold: float = STRICT_DEFAULT) -> DataFrame:
    """One row per name: method, score, code and note by the strict and the relaxed rule."""
    return _decided(candidates, threshold).drop("hits")


def _decided(candidates: DataFrame, threshold: float) -> DataFrame:
    """fuzzy_decisions with `hits`, the ranked candidates of the name (five at most)."""
    at = lambda n, c: F.try_element_at("hits", F.lit(n))[c]
    hits = F.array_sort(F.collect_list(F.struct("rank", "score", "candidate", "code", "official"))).alias("hits")
    best = candidates.groupBy("uf", "name_norm").agg(hits).select(
        "uf",
        "name_norm",
        "hits",
        at(1, "score").alias("best_score"),
        F.coalesce(at(2, "score"), F.lit(0.0)).alias("second_score"),
        at(1, "candidate").alias("candidate"),
        at(1, "code").alias("code"),
        at(1, "official").alias("official"),
    )
    margin = F.col("best_score") - F.col("second_score")
    edits = F.levenshtein("name_norm", "candidate")
    two = lambda c: F.format_number(c, 2)  # noqa: E731  (half-even, as in the notes of earlier runs)
    strict = F.col("best_score") >= threshold
    relaxed = (F.col("best_score") >= RELAXED_SCORE) & (margin >= RELAXED_MARGIN) & (edits <= RELAXED_EDITS)
    return (
        best.withColumn("margin", margin)
        .withColumn("edit_distance", edits)
        .withColumn(
            "match_method",
            F.when(strict, "fuzzy_strict").when(relaxed, "fuzzy_relaxed").otherwise("manual_needed"),
        )
        .withColumn(
            "note",
            F.when(strict, F.concat(F.lit("fuzzy_strict:score="), two("best_score")))
            .when(
                relaxed,
                F.concat(
                    F.lit("fuzzy_relaxed:score="), two("best_score"), F.lit(",margin="), two("margin"),
                    F.lit(",edit_distance="), F.col("edit_distance").cast("string"),
                ),
            )
            .otherwise("below_threshold_or_low_margin_or_edit_distance"),
        )
    )


def _resolve_names(
    rows: DataFrame,
    reference: DataFrame,
    threshold: float,
    aliases: DataFrame | None,
    overrides: DataFrame | None,
) -> DataFrame:
    """Answers per name, with the fuzzy candidates of open names in `hits`."""
    reference = cut_lineage(reference.select(*REFERENCE))
    looked_up = cut_lineage(lookup_ladder(rows, reference, aliases, overrides))
    open_names = looked_up.where(F.col("match_method").isNull()).select(F.col("_uf").alias("uf"), "name_norm")
    decided = _decided(fuzzy_candidates(open_names, reference), threshold).select(
        F.col("uf").alias("_uf"),
        "name_norm",
        F.col("match_method").alias("fz_method"),
        "best_score",
        "code",
        "official",
        "note",
        "hits",
    )
    open_ = F.col("match_method").isNull()
    accepted = F.col("fz_method") != "manual_needed"
    return looked_up.join(decided, ["_uf", "name_norm"], "left").select(
        "_uf",
        "_name",
        "name_norm",
        "hits",
        "alias_applied",
        F.when(open_, F.when(accepted, F.col("code")))
        .otherwise(F.col("ibge_municipality_code"))
        .alias("ibge_municipality_code"),
        F.when(open_, F.coalesce("fz_method", F.lit("unmatched"))).otherwise(F.col("match_method")).alias("match_method"),
        F.when(open_, F.coalesce(F.col("best_score") / 100.0, F.lit(0.0)))
        .otherwise(F.col("match_score"))
        .alias("match_score"),
        F.when(open_, F.when(accepted, F.col("official")))
        .otherwise(F.col("matched_name_official"))
        .alias("matched_name_official"),
        # A state without any reference name replaces earlier notes; all other notes add up.
        F.when(open_ & F.col("fz_method").isNull(), "no_reference_for_uf")
        .when(open_, join_notes("match_notes", "note"))
        .otherwise(F.col("match_notes"))
        .alias("match_notes"),
    )


def _attach(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Answers joined back to the rows. Adaptive execution splits a name that fills a partition."""
    joined = _keyed(rows).join(names.drop("name_norm", "_n", "hits"), ["_uf", "_name"], "left")
    added = ("alias_applied", "ibge_municipality_code", "match_method", "match_score", "matched_name_official", "match_notes")
    kept = [c for c in rows.columns if c not in (*added, "uf", "municipality_name_clean")]
    return joined.select(
        *kept,
        F.col("_uf").alias("uf"),
        F.col("_name").alias("municipality_name_clean"),
        F.coalesce("alias_applied", F.lit(False)).alias("alias_applied"),
        "ibge_municipality_code",
        F.coalesce("match_method", F.lit("unmatched")).alias("match_method"),
        F.coalesce("match_score", F.lit(0.0)).alias("match_score"),
        "matched_name_official",
        F.coalesce("match_notes", F.lit("")).alias("match_notes"),
    )


def match_by_lookup(
    rows: DataFrame, reference: DataFrame, aliases: DataFrame | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """Rows with the answer of the lookup steps alone; the rest is unmatched."""
    return _attach(rows, lookup_ladder(rows, reference, aliases, overrides))


def match_places(
    rows: DataFrame,
    reference: DataFrame,
    threshold: float = STRICT_DEFAULT,
    aliases: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Rows with code, method, score, official name and notes after the whole ladder."""
    return _attach(rows, _resolve_names(rows, reference, threshold, aliases, overrides))


def review_candidates(
    rows: DataFrame,
    reference: DataFrame,
    threshold: float = STRICT_DEFAULT,
    aliases: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Up to five suggestions for every row the ladder leaves to manual review."""
    names = _resolve_names(rows, reference, threshold, aliases, overrides)
    names = names.where(F.col("match_method") == "manual_needed").select("_uf", "_name", F.explode("hits").alias("_h"))
    suggested = names.select(
        "_uf",
        "_name",
        F.col("_h.code").alias("suggested_ibge_code"),
        F.col("_h.official").alias("suggested_name_official"),
        F.col("_h.score").alias("score"),
        F.col("_h.rank").alias("rank"),
    )
    added = ("suggested_ibge_code", "suggested_name_official", "score", "rank")
    kept = [c for c in rows.columns if c not in (*added, "uf", "municipality_name_clean")]
    joined = _keyed(rows).join(suggested, ["_uf", "_name"])
    return joined.select(*kept, F.col("_name").alias("municipality_name_clean"), F.col("_uf").alias("uf"), *added)
