"""Column names: header rules, alias lookup and selection. All of it is plan-time metadata."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded_header(name: str) -> str:
    """snake_case with accents folded and symbols dropped: 'Edição / FEF' -> 'edicao_fef'. Upper case
    comes first, which spells letters such as ß out."""
    plain = unicodedata.normalize("NFKD", (name or "").upper())
    plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    words = (re.sub(r"[^a-z0-9_]", "", w) for w in re.split(r"[^\w]+", plain))
    return "_".join(w for w in words if w).strip("_")


def ascii_header(name: str) -> str:
    """snake_case where everything but ASCII letters and digits, accents included, becomes '_'."""
    return re.sub(r"[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_")


def rename_all(df: DataFrame, rule=folded_header) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def find_column(df: DataFrame, aliases: list[str], rule=folded_header) -> str | None:
    """First alias that, after the header rule, is a column of an already renamed frame."""
    return next((rule(a) for a in aliases if rule(a) in df.columns), None)


def need_column(df: DataFrame, aliases: list[str], rule=folded_header) -> str:
    """First column whose own renamed header equals an alias; KeyError when there is none."""
    by_header = {rule(c): c for c in df.columns}
    for a in aliases:
        if rule(a) in by_header:
            return by_header[rule(a)]
    raise KeyError(f"no column for any of {aliases}")


def resolve_required(df: DataFrame, wanted: dict[str, list[str]], rule=folded_header) -> dict[str, str]:
    """Column per logical name; fails with the full list of names that cannot be resolved."""
    found = {name: find_column(df, aliases, rule) for name, aliases in wanted.items()}
    missing = [name for name, column in found.items() if column is None]
    if missing:
        raise ValueError(f"input is missing required columns: {missing}")
    return found


def select_present(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, in the wanted order, and the names of the others."""
    return df.select(*[c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]


def add_missing(df: DataFrame, names: list[str], kind: str = "string") -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def attach_constants(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def rename_and_drop(df: DataFrame, renames: dict[str, str], drops: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*drops).withColumnsRenamed(renames)
