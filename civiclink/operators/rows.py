"""Row picking and ordering. Every operator that depends on row order names its order columns.

Row numbers, prefix sums and medians over a whole table never put the table into one task:
the order column is cut into ranges, ranges are handled in parallel, and a small table of
range totals connects them. The cut points only balance the work; any cut points give the
same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiclink.functions.ids import draw_key

RANGE_ROWS = 10_000_000


def _cols(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key with their rank. Spark keeps n rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: str | list[str], order_by: str | list[str]) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in _cols(order_by)]
    return top_per_key(df, _cols(keys), order, 1, "_rank").drop("_rank")


def keep_last(df: DataFrame, keys: str | list[str], order_by: str | list[str]) -> DataFrame:
    order = [F.col(c).desc_nulls_last() for c in _cols(order_by)]
    return top_per_key(df, _cols(keys), order, 1, "_rank").drop("_rank")


def first_non_null(value: str | Column, order_by: str | Column) -> Column:
    """Aggregate: the non-null value with the smallest order value."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order_by) if isinstance(order_by, str) else order_by
    return F.min_by(v, F.when(v.isNotNull(), o))


def head(df: DataFrame, order_by: str | list[str], n: int) -> DataFrame:
    return df.orderBy(*_cols(order_by)).limit(n)


def most_frequent(df: DataFrame, keys: list[str], n: int, count: str = "count") -> DataFrame:
    """Top n groups by size; equal sizes are ordered by the key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return sizes.orderBy(F.col(count).desc(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows in a hash order of their keys: the same draw on every run and cluster."""
    return df.orderBy(draw_key(seed, *keys), *keys).limit(n)


def sample_or_all(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """As seeded_sample, but n <= 0 keeps everything."""
    return df if n <= 0 else seeded_sample(df, keys, n, seed)


def distinct_sample(df: DataFrame, cols: list[str], n: int, seed: int) -> DataFrame:
    return seeded_sample(df.select(*cols).dropna().distinct(), cols, n, seed)


def stratified_sample(df: DataFrame, strata: list[str], keys: list[str], n: int, seed: int) -> DataFrame:
    """Up to n rows per stratum in hash order; Spark prunes each task to n per stratum first."""
    order = [draw_key(seed, *keys), *[F.col(k) for k in keys]]
    return top_per_key(df, strata, order, n, "_rank").drop("_rank")


def _range_of(order: str, cuts: list[float]) -> Column:
    """Index of the range an order value falls into, by binary search over literal cut points."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) <= F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(cuts))


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add _range: consecutive ranges of a numeric or time order column, of about RANGE_ROWS rows
    each, whatever the size of the table; at least one per shuffle partition."""
    kind = df.schema[order].dataType.typeName()
    key = F.col(order)
    if kind in ("timestamp", "timestamp_ntz"):
        key = F.unix_micros(key.cast("timestamp"))
    elif kind == "date":
        key = F.unix_date(key)
    keyed = df.withColumn("_key", key)
    fewest = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def look(n: int):
        """Row count and n - 1 cut points in one pass over the key."""
        points = F.percentile_approx("_key", [i / n for i in range(1, n)], 8 * n) if n > 1 else F.array()
        return keyed.agg(F.count(F.lit(1)).alias("rows"), points.alias("cuts")).first()

    found = look(fewest) if fewest > 1 or ranges is None else None
    if ranges is None and found.rows > RANGE_ROWS * fewest:
        found = look(-(-found.rows // RANGE_ROWS))
    cuts = sorted(set(found.cuts or [])) if found else []
    return keyed.withColumn("_range", _range_of("_key", cuts)).drop("_key")


def prefix_sums(
    df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, ranges: int | None = None
) -> DataFrame:
    """Running totals over a whole table: {output: input}. The order column must be unique."""
    ranged = with_ranges(df, order, ranges)
    totals = ranged.groupBy("_range").agg(*[F.sum(i).alias(f"_t_{o}") for o, i in sums.items()])
    # One row per range, so this window over everything sees `ranges` rows at most.
    by_range = F.col("_range").desc() if descending else F.col("_range").asc()
    before = W.orderBy(by_range).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    by_value = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy("_range").orderBy(by_value).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(offsets, "_range")
    for o, i in sums.items():
        out = out.withColumn(o, F.sum(i).over(inside) + F.col(f"_o_{o}"))
    return out.drop("_range", *[f"_o_{o}" for o in sums])


def number_rows(df: DataFrame, order: str, name: str = "source_row_number", ranges: int | None = None) -> DataFrame:
    """1-based row number over a whole table in the order of a unique column."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, ranges=ranges).drop("_one")


def number_scanned_rows(df: DataFrame, name: str = "source_row_number") -> DataFrame:
    """1-based row number over a frame read straight from files: files in name order, rows in file order.

    A scan reads a file in splits, and splits of several files per task. Spark's increasing id gives
    the order inside a split; the splits, one row each, are put in order by file and start, and turn it
    into consecutive numbers without moving the data.
    """
    tagged = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    splits = tagged.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    out = tagged.join(offsets, ["_file", "_start"])
    return out.withColumn(name, F.col("_offset") + F.col("_id") + 1).drop("_file", "_start", "_id", "_offset")


def exact_median(df: DataFrame, value: str, name: str = "median", ranges: int | None = None) -> DataFrame:
    """Exact median as a one-row frame. Equal values are counted first, so a value that fills a
    third of the table is one row, and the distinct values are ranked range by range."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    running = prefix_sums(sizes, value, {"_upto": "_n"}, ranges=ranges)
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
    start = F.col("_upto") - F.col("_n")
    return running.agg(
        (
            (
                F.max(F.when((start < low) & (F.col("_upto") >= low), F.col(value)))
                + F.max(F.when((start < high) & (F.col("_upto") >= high), F.col(value)))
            )
            / 2
        ).alias(name)
    )
