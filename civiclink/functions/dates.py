"""Date expressions; a text that does not fit is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import col, trim_ws


def day_first(c: Column | str) -> Column:
    """dd/mm/yyyy text as a timestamp; every other form is null."""
    text = trim_ws(col(c).cast("string"))
    return F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy"))
    )


# Forms a date column may have, most exact pattern first: test, Spark format.
FORMS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
]
# ISO times without seconds, with fractions of a second, and with a zone.
FORMS += [
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}{sep}{time}{zone}$", f"yyyy-MM-dd{mark}{time_form}{zone_form}")
    for sep, mark in ((" ", " "), ("T", "'T'"))
    for time, time_form in ((r"\d{2}:\d{2}", "HH:mm"), (r"\d{2}:\d{2}:\d{2}", "HH:mm:ss"), (r"\d{2}:\d{2}:\d{2}\.\d{1,9}", "HH:mm:ss.SSSSSSSSS"))
    for zone, zone_form in (("", ""), (r"(?:Z|[+-]\d{2}:\d{2})", "XXX"), (r"[+-]\d{4}", "XX"))
    if zone or time_form != "HH:mm:ss"
]


def has_form(c: Column | str) -> Column:
    """The text has one of the forms and is a date in it."""
    text = trim_ws(col(c).cast("string"))
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in FORMS]).isNotNull()


def like_first(c: Column | str, first: Column) -> Column:
    """Date texts as timestamps in the form of `first`, the first date text of the column; texts of
    any other form are null. Without one the form is dd/mm/yyyy."""
    text, model = trim_ws(col(c).cast("string")), F.coalesce(trim_ws(first), F.lit("01/01/2000"))
    each = [F.when(model.rlike(p) & text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in FORMS]
    return F.coalesce(*each)


def any_date(c: Column | str) -> Column:
    """A timestamp column as it is, ISO text parsed, anything else null."""
    return col(c).try_cast("timestamp")


def year_of(c: Column | str) -> Column:
    return F.year(col(c))


def iso_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def utc_stamp(c: Column | str) -> Column:
    """ISO text with Z; the session time zone is expected to be UTC."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
