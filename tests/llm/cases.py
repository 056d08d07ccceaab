"""Documents with everything that may be odd about a table."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

# Extra columns carry names the operators use inside.
FIELDS = [("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()), ("n_chars", LongType())]
EXTRA = ["row", "_row", "h", "fp", "shard", "slot", "k1", "spans", "size", "words", "copies", "score", "repeated", "component_id"]
SCHEMA = StructType([StructField(n, t) for n, t in FIELDS] + [StructField(n, StringType()) for n in EXTRA])
WORDS = "the of and ing ha or schön été niño über alpha beta gamma delta stone river cloud".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 1),
        (2, prose(2, 60), "en", "a", 1),
        (3, prose(2, 59) + " other", "de", None, None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 3),
        (7, "one", "fr", "b", 3),
        (8, "one two", None, "c", 7),
        (9, long_text, "en", "a", len(long_text)),
        (10, long_text + " more", "en", "a", 0),
        (None, prose(3, 40), "en", "c", 5),
        (None, prose(3, 40), "en", "c", 5),
        (11, "ünï 漢字 😀 kelvin K ſ İ", "xx", "😀", 5),
        (12, prose(4, 50), "en", "a", 9),
        (12, prose(4, 50), "en", "a", 9),
        (12, prose(5, 50), "en", "a", 9),
        (13, "x" * 200_000, "en", "a", 9),
    ]
    return [(*r, *[f"{c}!" for c in EXTRA]) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts, **columns):
    """documents with ids 0, 1, ..; columns: name=list."""
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows = [tuple(columns[n][i] if n in columns else v for (n, _), v in zip(FIELDS, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, StructType([StructField(n, t) for n, t in FIELDS]))
