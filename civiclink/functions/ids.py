"""Short stable identifiers from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import col

# A missing part is hashed as this word, so that identifiers equal those of earlier runs.
MISSING = "None"


def short_id(prefix: str, *parts: Column | str, length: int = 16) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit(MISSING)) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))


def candidate_id(landing: Column | str, pdf: Column | str, name: Column | str, strategy: Column | str) -> Column:
    return short_id("cand", landing, pdf, name, strategy)


def round_id(label: Column | str, url: Column | str) -> Column:
    return short_id("round", label, url, length=12)


def draw_key(seed: int | str, *parts: Column | str) -> Column:
    """Ordering key of a reproducible sample: the same rows on every engine and run."""
    return F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(str(seed))), 256)
