"""Text expressions. Everything stays in the JVM; nothing here is a Python UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Python's str.strip and \s see it: Unicode spaces plus the four separators.
SPACE = r"[\s\x1c-\x1f]"
# Bullet and dash characters that lists put before a name.
# Fixed value.
LEADING_MARKS = r"(?U)^(?:" + SPACE + r"|[-–—•*])+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row.

    Naming the value in a select step does not help: a filter on the outcome is pushed below the
    step, and there every use of the name becomes another copy of the expression.
    """
    return F.transform(F.array(value), body)[0]


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The frame with a column computed once per row. A row of its own generator is a step that no filter or
    projection is copied across, and other than in `let` the expression is compiled."""
    return df.withColumn(name, F.explode(F.array(value)))


def text_map(pairs: dict[str, str]) -> Column:
    """Constant map, passed to the JVM as one expression."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in pairs.items()) + ")")


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_ws(c: Column | str) -> Column:
    """Runs of whitespace become one space, the ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"(?U){SPACE}+", " "))


def _spans(points: Iterable[int], gap: int = 1) -> str:
    """Character class of code points; points up to `gap` apart share a range."""
    spans: list[list[int]] = []
    for point in points:
        if spans and point - spans[-1][1] <= gap:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in spans) + "]"


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[str, str, dict[str, str], str]:
    """Compatibility folding of the whole code space, derived from the Unicode database: one-to-one pairs
    for translate, longer results as a map, and the class of combining characters. Hangul syllables
    have a rule of their own."""
    src, dst, gone, longer, marks = [], [], [], {}, []
    for point in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(point)
        if unicodedata.combining(ch):
            marks.append(point)
            continue
        base = "".join(p for p in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(p))
        if base == ch:
            continue
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
        elif base:
            longer[ch] = base
        else:
            gone.append(ch)
    # translate drops source characters that have no counterpart, so those go last.
    return "".join(src + gone), "".join(dst), longer, _spans(marks)


def replace_each(text: Column, found: Column, table: Column) -> Column:
    """Replace every string of the array `found` in `text` by its entry in the map `table`."""
    return F.aggregate(
        F.array_distinct(found), text, lambda acc, hit: F.replace(acc, hit, F.element_at(table, hit))
    )


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def _jamo(syllable: Column) -> Column:
    """Letters of a Hangul syllable, by the arithmetic of the Unicode standard."""
    n = F.ascii(syllable) - 0xAC00
    tail = n % 28
    letters = [_character(F.floor(n / 588) + 0x1100), _character(F.floor((n % 588) / 28) + 0x1161)]
    return F.concat(*letters, F.when(tail > 0, _character(tail + 0x11A7)).otherwise(""))


def fold_accents(c: Column | str) -> Column:
    """Accents off, compatibility forms spelled out; null becomes ''. Plain ASCII is left as it is, and
    rare forms cost only the texts that have some."""
    src, dst, longer, marks = _fold_rules()
    # Letters of Latin-1 alone, by far the most frequent case, need the short table only.
    near = {a: b for a, b in zip(src, dst) if "À" <= a <= "ÿ"}
    # A class is matched span by span, so it is written in spans, a coarse test goes first and ASCII is told apart before.
    rare = r"(?=[^\x00-\x7f])" + _spans(sorted(map(ord, longer)))
    # One literal, taken apart once per plan: a map of single literals takes long to plan.
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in longer.items())), F.lit("\x02"), F.lit("\x01"))

    def spell_out(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"({rare})"), F.lit(1))
        return F.when(text.rlike(_spans(map(ord, longer), 48)), replace_each(text, found, table)).otherwise(text)

    def syllables(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"([\x{ac00}-\x{d7a3}])"), F.lit(1))
        each = F.aggregate(F.array_distinct(found), text, lambda acc, hit: F.replace(acc, hit, _jamo(hit)))
        return F.when(text.rlike(r"[\x{ac00}-\x{d7a3}]"), each).otherwise(text)

    def folded(text: Column) -> Column:
        spelled = let(let(text, syllables), spell_out)
        plain = F.regexp_replace(F.translate(spelled, src, dst), rf"(?:(?=[^\x00-\x7f]){marks})+", "")
        latin = F.translate(text, "".join(near), "".join(near.values()))
        other = text.rlike(r"[^\x00-\x7f\x{c0}-\x{ff}]")
        return F.when(other, plain).when(text.rlike(r"[^\x00-\x7f]"), latin).otherwise(text)

    return let(F.coalesce(col(c), F.lit("")), folded)


def _words_only(c: Column) -> Column:
    """Punctuation becomes a space, then whitespace is collapsed."""
    return collapse_ws(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]+", " "))


def _unmark(c: Column) -> Column:
    return F.translate(F.regexp_replace(trim_ws(c), LEADING_MARKS, ""), "-/", "  ")


def match_key(c: Column | str) -> Column:
    """Join key of a place name: upper case first, accents folded afterwards."""
    return _words_only(fold_accents(_unmark(F.upper(F.coalesce(col(c), F.lit(""))))))


def query_key(c: Column | str) -> Column:
    """Search key of a place name: accents folded first, upper case afterwards."""
    return _words_only(_unmark(F.upper(fold_accents(c))))


def slug(c: Column | str, max_len: int = 80, fold: bool = True) -> Column:
    text = F.lower(fold_accents(c) if fold else trim_ws(F.coalesce(col(c), F.lit(""))))
    body = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(body, 1, max_len), F.lit("")), F.lit("item"))


def trim_name_tail(c: Column | str) -> Column:
    """Drop separators left over at the end of an extracted name."""
    return F.regexp_replace(collapse_ws(c), r"[\s,;:\-.]+$", "")


def pad_code(c: Column | str, width: int = 7) -> Column:
    """Left-pad with zeros; longer codes are never cut (plain lpad would cut them)."""
    text = col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def upper_key(c: Column | str) -> Column:
    return trim_ws(F.upper(col(c).cast("string")))


def uf_key(c: Column | str) -> Column:
    """First two letters of the trimmed upper-case text, so a list such as CE;BA gives CE."""
    return F.substring(upper_key(F.coalesce(col(c).cast("string"), F.lit(""))), 1, 2)


def join_notes(*notes: Column | str) -> Column:
    """Notes in order, separated by '; '; null and empty notes leave no trace."""
    return F.concat_ws("; ", *[F.when(col(n) != "", col(n)) for n in notes])


def clip(c: Column | str, limit: int) -> Column:
    return F.substring(col(c), 1, limit)


def text_or(c: Column | str, default: str = "") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(default))


def keep_if(c: Column | str, condition: Column, other: Column) -> Column:
    """The value where the condition holds; the other value where it fails or is null."""
    return F.when(condition, col(c)).otherwise(other)
