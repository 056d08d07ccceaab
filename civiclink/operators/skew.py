"""Joins with hot keys.

By default a join is a plain equi-join: adaptive execution splits a partition that is too large, by
bytes and not by share, and each table is read once. Keys a caller knows to be hot can be named;
rows of a key that is hot on the left then get a left salt and meet copies of the right rows, and the other way
round for the right; every pair meets in exactly one (left salt, right salt) cell, and other keys
stay in cell (0, 0). Named keys travel as a list, so there should be few.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

SALTS = 64


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, null keys included; duplicates collapse in the map tasks."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: Column,
    how: str = "inner",
    hot_left: Iterable[tuple] = (),
    hot_right: Iterable[tuple] = (),
    salts: int = SALTS,
    right_keys: dict[str, Column] | None = None,
) -> DataFrame:
    """Equi-join (`inner` or `left`). `spread_by` identifies a left row, such as its id. `right_keys` are keys that
    the right side works out from its columns; they are not shuffled with its rows unless keys are hot."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    flags: dict[tuple, list[bool]] = {}
    for side, found in enumerate((hot_left, hot_right)):
        for key in found:
            flags.setdefault(tuple(key), [False, False])[side] = True
    if not flags and not right_keys:
        return left.join(right, keys, how)
    if not flags:
        own_name = {k: f"_right_{k}" for k in keys if k not in right_keys}
        same = [F.col(k) == (F.col(own_name[k]) if k in own_name else right_keys[k]) for k in keys]
        left = left.select(*keys, *[c for c in left.columns if c not in keys])
        return left.join(right.withColumnsRenamed(own_name), same, how).drop(*own_name.values())
    right = right.withColumns(right_keys or {})
    schema = StructType([*(left.schema[k] for k in keys), StructField("_hot_l", BooleanType()), StructField("_hot_r", BooleanType())])
    marks = left.sparkSession.createDataFrame([(*k, *f) for k, f in flags.items()], schema)
    own = lambda hot, row: F.when(hot, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(0)
    every = lambda hot: F.explode(
        F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    )
    hot_l, hot_r = (F.coalesce(F.col(c), F.lit(False)) for c in ("_hot_l", "_hot_r"))
    l = left.join(marks, keys, "left").withColumn("_a", own(hot_l, spread_by))
    l = l.withColumn("_copied", hot_r).withColumn("_b", every(hot_r)).drop("_hot_l", "_hot_r")
    r = right.join(marks, keys, "left").withColumn("_a", every(hot_l))
    r = r.withColumn("_b", own(hot_r, F.struct(*right.columns))).drop("_hot_l", "_hot_r").withColumn("_met", F.lit(True))
    out = l.join(r, [*keys, "_a", "_b"], how)
    if how == "left":
        # A left row of a key that is hot on the right stands in every cell: without a match anywhere it
        # stays once, in cell 0; with a match its copies without one go.
        some = right.join(marks.where("_hot_r"), keys, "left_semi").select(*keys).distinct().withColumn("_some", F.lit(True))
        out = out.join(some, keys, "left")
        keep = ~F.col("_copied") | F.col("_met").isNotNull() | (F.col("_some").isNull() & (F.col("_b") == 0))
        out = out.where(keep).drop("_some")
    return out.drop("_a", "_b", "_copied", "_met")
