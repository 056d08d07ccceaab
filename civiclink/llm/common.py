"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.sources.scratch import cut_lineage

SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLANKS = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the folder all executors share and read it back: what follows never
    repeats the work before it, and a lost executor costs a re-read."""
    return cut_lineage(df)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_lists(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """White-space separated words of a text, in lists of about `size` bytes of text each, so that
    a very long text never becomes one list."""
    start = 0
    while start < len(data):
        end = len(data)
        if start + size < end:
            gap = SPACE.search(data, start + size)
            end = gap.start() if gap else end
        words = data[start:end].split()
        if words:
            yield words
        start = end


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `_row`, so that no name of theirs can clash with added ones."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under `join` (sum, greatest). Each round joins every value with the one
    twice as far before it as in the last round, so n values cost n log n."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(values).cast("double"))).cast("int"))

    def add(done: Column, k: Column) -> Column:
        before = lambda i: F.get(done, i - F.call_function("shiftleft", F.lit(1), k))
        return F.transform(done, lambda x, i: F.when(before(i).isNull(), x).otherwise(join(x, before(i))))

    return F.when(F.size(values) <= 1, values).otherwise(F.aggregate(rounds, values, add))


def halvings(values: Column) -> Column:
    """Step widths, the widest first, for `below` on an array of this size."""
    top = F.floor(F.log2(F.size(values).cast("double") + 1)).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def below(values: Column, steps: Column, x: Column) -> Column:
    """How many of the sorted `values` are less than x, by halving; `steps` are their halvings."""
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) < x, n + step).otherwise(n))
