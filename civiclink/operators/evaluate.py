"""Extraction and linkage checked against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.operators.rows import prefix_sums, top_per_key


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_scores(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 per label, from the confusion counts."""
    by = by or []
    counts = confusion(df, gold, predicted, by)
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("gold").alias("label"), F.lit(True).alias("is_gold")),
                F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_gold")),
            )
        ).alias("_s"),
        F.col("gold").eqNullSafe(F.col("predicted")).alias("_hit"),
        "n",
    ).select(*by, "_s.*", "_hit", "n")
    out = sides.where(F.col("label").isNotNull()).groupBy(*by, "label").agg(
        F.sum(F.when(F.col("is_gold") & F.col("_hit"), F.col("n")).otherwise(0)).alias("true_positive"),
        F.sum(F.when(~F.col("is_gold") & ~F.col("_hit"), F.col("n")).otherwise(0)).alias("false_positive"),
        F.sum(F.when(F.col("is_gold") & ~F.col("_hit"), F.col("n")).otherwise(0)).alias("false_negative"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return out.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    )


def ranking_scores(df: DataFrame, query: str, score: str, relevant: str, tie: str, k: int) -> DataFrame:
    """Precision@k and recall@k averaged over queries with at least one relevant item."""
    top = top_per_key(df, [query], [F.col(score).desc(), F.col(tie)], k)
    hits = top.groupBy(query).agg(F.count_if(relevant).alias("_hits"))
    totals = df.groupBy(query).agg(F.count_if(relevant).alias("_relevant"))
    both = totals.where(F.col("_relevant") > 0).join(hits, query)
    return both.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.col("_hits") / F.lit(k)).alias("precision_at_k"),
        F.avg(F.col("_hits") / F.col("_relevant")).alias("recall_at_k"),
    )


def curve_points(df: DataFrame, score: str, truth: str) -> DataFrame:
    """ROC and precision-recall points, one per distinct score. Rows are counted per score first
    and the running totals are built range by range, so no task sees the whole table."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(truth).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg")
    )
    running = prefix_sums(counts, "threshold", {"true_positive": "_pos", "false_positive": "_neg"}, descending=True)
    positives, negatives = counts.agg(F.sum("_pos")).scalar(), counts.agg(F.sum("_neg")).scalar()
    tp, fp = F.col("true_positive"), F.col("false_positive")
    return running.select(
        "threshold", "true_positive", "false_positive", _ratio(tp, positives).alias("recall"),
        _ratio(fp, negatives).alias("false_positive_rate"), _ratio(tp, tp + fp).alias("precision"),
    )


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy per confidence bin."""
    bin_of = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    return df.groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Observed agreement and Cohen's kappa of two annotators."""
    counts = confusion(df.dropna(subset=[first, second]), first, second)
    total = counts.agg(F.sum("n")).scalar()
    margins = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("gold").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")),
            )
        ).alias("m")
    ).select("m.*")
    chance = margins.groupBy("label").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum(F.col("a") * F.col("b")))
    out = counts.agg(
        F.sum("n").alias("items"), (F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("observed")
    )
    expected = chance.scalar() / (total * total)
    out = out.withColumn("expected", expected)
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def span_overlap(gold_start: str, gold_end: str, start: str, end: str) -> Column:
    """Shared share of two character spans (intersection over union)."""
    shared = F.greatest(F.least(gold_end, end) - F.greatest(gold_start, start), F.lit(0))
    joined = F.greatest(gold_end, end) - F.least(gold_start, start)
    return _ratio(shared, joined)


def error_rates(df: DataFrame, by: list[str], error: str) -> DataFrame:
    """Error rate at every level of a rollup; null marks a total."""
    return df.rollup(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.avg(F.col(error).cast("double")).alias("error_rate")
    )


def shift_dates(rows: DataFrame, date: str, shift_days: int = 30) -> DataFrame:
    return rows.withColumn("shifted_date", F.date_add(date, shift_days))


def abstention(rows: DataFrame, abstained: str, correct: str, by: list[str] | None = None) -> DataFrame:
    """Share of records without an answer, and precision and recall of the others."""
    given = ~F.col(abstained)
    out = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(abstained).alias("abstained"), F.count_if(given & F.col(correct)).alias("correct")
    )
    answered = F.col("n") - F.col("abstained")
    return out.withColumns(
        {"abstention_rate": _ratio(F.col("abstained"), F.col("n")), "precision": _ratio(F.col("correct"), answered), "recall": _ratio(F.col("correct"), F.col("n"))}
    )


def stress_variants(docs: DataFrame, key: str, text: str = "text", date: str | None = None, shift_days: int = 30) -> DataFrame:
    """Each text in damaged forms: cut in half, headings removed, words abbreviated, noise; and a
    shifted date where the table has one."""
    t = F.col(text)
    half = F.substring(t, F.lit(1), F.ceil(F.length(t) / 2).cast("int"))
    variants = {
        "original": t,
        "truncated": half,
        "no_headings": F.regexp_replace(t, r"(?m)^(#{1,6} |([0-9]+\.)+ ).*$", ""),
        "abbreviated": F.regexp_replace(t, r"\b([A-Za-z]{3})[A-Za-z]{5,}\b", "$1."),
        "scan_noise": F.translate(t, "lO", "10"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("variant_text")) for n, v in variants.items()]))
    out = docs.select(key, *([date] if date else []), rows.alias("_v")).select(key, *([date] if date else []), "_v.*")
    return shift_dates(out, date, shift_days) if date else out
