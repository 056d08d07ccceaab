"""Names of people and organisations as sets of words, so that spelling habits do not matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import let, query_key

# Words that say what kind of body or person is named, not which one.
LEGAL_FORMS = ["LTDA", "LIMITADA", "SA", "ME", "MEI", "EPP", "EIRELI", "CIA", "INC", "LLC", "CORP", "LTD", "GMBH"]
HONORIFICS = ["SR", "SRA", "DR", "DRA", "EXMO", "EXMA", "PROF", "PROFA", "ENG", "PREF", "PREFEITO", "PREFEITA"]
PARTICLES = ["DE", "DA", "DO", "DAS", "DOS", "E", "OF", "THE", "AND"]


def entity_words(c: Column | str) -> Column:
    """Distinct words of a name in order of the alphabet: upper case, accents folded, without legal forms
    (S/A, S.A. and SA alike), honorifics and particles. A name of nothing else keeps all its words; null and blank names have none."""
    key = F.regexp_replace(query_key(c), r"\bS A\b", "SA")
    words = F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda w: w != "")))
    drop = F.array(*[F.lit(w) for w in LEGAL_FORMS + HONORIFICS + PARTICLES])
    either = lambda w: let(F.array_except(w, drop), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(w))
    return let(words, either)


def entity_key(c: Column | str) -> Column:
    """The words as one text: equal for names that differ in order, form of body, title, accents or case."""
    return F.concat_ws(" ", entity_words(c))
