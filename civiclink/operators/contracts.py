"""Record contracts: JSON text in, valid records and quarantine out.

A contract is a schema plus a list of (reason, rule). Rules are plain column expressions, so a
whole table is checked in one pass. Fields are first read as raw JSON values, which keeps a
wrong type apart from a missing value.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.functions.text import bound, let


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, double or evidence
    required: bool = True
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


def _texts(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, "string") for n in names)


EVIDENCE = Field("evidence", "evidence", required=False)
CONTRACTS: dict[str, tuple[Field, ...]] = {
    "EvidenceSpan": (
        Field("source_doc_id", "string"), Field("quote", "quote"), Field("chunk_id", "string", False),
        Field("page", "int", False), Field("start_char", "int", False), Field("end_char", "int", False),
    ),
    "AuditFindingCard": (
        *_texts("finding_id", "audit_report_id", "municipality", "state", "finding_type"),
        Field("severity_level", "string", allowed=("low", "medium", "high")),
        *_texts("summary"),
        Field("amount_brl", "double", False),
        Field("confidence", "double", low=0.0, high=1.0),
        EVIDENCE,
    ),
    "MatchScore": (
        *_texts("finding_id", "decision_id"),
        Field("score", "double", low=0.0, high=1.0),
        Field("label", "string", allowed=("direct", "probable", "weak", "none")),
        *_texts("rationale"),
        EVIDENCE,
    ),
    "DecisionOutcome": (
        *_texts("decision_id", "case_id", "court", "decision_date"),
        Field("outcome_label", "string", allowed=("adverse", "neutral", "non_punishment", "unknown")),
        *_texts("outcome_summary"),
        Field("confidence", "double", low=0.0, high=1.0),
        EVIDENCE,
    ),
}
_SPARK_TYPES = {"string": "string", "quote": "string", "int": "bigint", "double": "double"}
WHOLE = 2.0**63
SPAN_TYPE = "struct<" + ",".join(f"{f.name}:{_SPARK_TYPES[f.kind]}" for f in CONTRACTS["EvidenceSpan"]) + ">"


def _raw(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _number(kind: Column, text: Column) -> Column:
    """Value of a number, of a text that reads as one, or of a boolean; null otherwise."""
    plain = kind.isin("BIGINT", "DOUBLE", "FLOAT", "STRING") | kind.startswith("DECIMAL")
    return F.when(plain, text.try_cast("double")).when(kind == "BOOLEAN", (text == "true").cast("double"))


def _scalar_errors(f: Field, kind: Column, text: Column) -> list[Column]:
    """One reason code or null per rule of a text or number field."""
    absent = kind.isNull() | (kind == "VOID")
    number = _number(kind, text)
    if f.kind in ("string", "quote"):
        fits = kind == "STRING"
    elif f.kind == "int":
        fits = F.coalesce(~F.isnan(number) & (F.abs(number) < WHOLE) & (number == F.rint(number)), F.lit(False))
    else:
        fits = number.isNotNull()
    rules = [("type", ~absent & ~fits)]
    if f.required:
        rules.insert(0, ("missing", absent))
    if f.kind == "quote":
        rules.append(("too_short", (kind == "STRING") & (F.length(text) < 1)))
    if f.allowed:
        rules.append(("not_allowed", (kind == "STRING") & ~text.isin(*f.allowed)))
    if f.low is not None:
        inside = (number >= f.low) & (number <= f.high) & ~F.isnan(number)
        rules.append(("out_of_range", number.isNotNull() & ~inside))
    return [F.when(broken, F.lit(f"{f.name}:{reason}")) for reason, broken in rules]


def _pick(fields: tuple[Field, ...], kind: str) -> list[Field]:
    return [f for f in fields if (f.kind == "evidence") == (kind == "evidence")]


def _raw_fields(v: Column, fields: Iterable[Field]) -> Column:
    return F.struct(*[_raw(v, f.name).alias(f.name) for f in fields])


def _facts(raw: Column, fields: list[Field]) -> Column:
    """JSON kind and text of every raw field as one struct: k_x, t_x."""
    return F.struct(
        *[F.schema_of_variant(raw[f.name]).alias(f"k_{f.name}") for f in fields],
        *[_text(raw[f.name]).alias(f"t_{f.name}") for f in fields],
    )


def _scalars(fields: tuple[Field, ...]) -> list[Field]:
    return [f for f in fields if f.kind != "evidence"]


def _codes(facts: Column, fields: list[Field]) -> list[Column]:
    return [e for f in fields for e in _scalar_errors(f, facts[f"k_{f.name}"], facts[f"t_{f.name}"])]


def _typed(facts: Column, f: Field) -> Column:
    kind, text = facts[f"k_{f.name}"], facts[f"t_{f.name}"]
    value = text if f.kind in ("string", "quote") else _number(kind, text)
    return value.try_cast(_SPARK_TYPES[f.kind]).alias(f.name)


def check(df: DataFrame, contract: str, payload: str = "payload") -> DataFrame:
    """Add _errors, the reason codes of each record, and _record, its typed fields.

    Parsed record, raw fields and facts are bound one after the other, so a payload is parsed once however many
    rules and filters use it, and the rules are compiled expressions."""
    fields = CONTRACTS[contract]
    scalars, spans = _scalars(fields), _scalars(CONTRACTS["EvidenceSpan"])
    has_list = len(scalars) < len(fields)
    out = bound(df, "_parsed", F.try_parse_json(payload))
    out = bound(out, "_raw", _raw_fields(F.col("_parsed"), fields))
    facts = [_facts(F.col("_raw"), scalars).alias("scalars")]
    if has_list:
        listed = F.col("_raw")[EVIDENCE.name]
        members = F.try_variant_get(listed, "$", "array<variant>")
        each = F.transform(members, lambda s: let(_raw_fields(s, spans), lambda r: _facts(r, spans)))
        facts += [listed.isNotNull().alias("given"), each.alias("spans")]
    out = bound(out, "_facts", F.struct(*facts))
    x = F.col("_facts")
    codes, typed = _codes(x["scalars"], scalars), [_typed(x["scalars"], f) for f in scalars]
    if has_list:
        broken = F.exists(x["spans"], lambda s: F.coalesce(*_codes(s, spans)).isNotNull())
        # A list may be left out, but it may not be null.
        codes.append(F.when(x["given"] & x["spans"].isNull(), F.lit("evidence:type")))
        codes.append(F.when(broken, F.lit("evidence:invalid_span")))
        good = F.transform(x["spans"], lambda s: F.struct(*[_typed(s, f) for f in spans]))
        typed.append(F.coalesce(good, F.array().cast(f"array<{SPAN_TYPE}>")).alias(EVIDENCE.name))
    not_json = F.when(F.col("_parsed").isNull(), F.array(F.lit("record:not_json")))
    whole = not_json.when(~F.ltrim(payload).startswith("{"), F.array(F.lit("record:not_an_object")))
    out = bound(out, "_errors", F.coalesce(whole, F.array_compact(F.array(*codes))))
    return out.withColumn("_record", F.struct(*typed)).drop("_parsed", "_raw", "_facts")


def valid_records(checked: DataFrame, contract: str, keep: list[str]) -> DataFrame:
    """Typed columns of the records without errors."""
    names = [F.col(f"_record.{f.name}") for f in CONTRACTS[contract]]
    return checked.where(F.size("_errors") == 0).select(*keep, *names)


def quarantine(checked: DataFrame, module: str, schema_version: str, model: str, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per broken rule with the raw text: the error log and the retry list."""
    return checked.where(F.size("_errors") > 0).select(
        *keep,
        F.explode("_errors").alias("reason_code"),
        F.lit(module).alias("module_name"),
        F.lit(schema_version).alias("schema_version"),
        F.lit(model).alias("model_id"),
        F.col(payload).alias("raw_payload"),
    )


def soften(records: DataFrame, columns: list[str], confidence: str = "confidence", below: float = 0.5) -> DataFrame:
    """Records under the confidence floor keep their identity but lose their content fields."""
    low = F.col(confidence) < below
    out = records.withColumns({c: F.when(~low, F.col(c)) for c in columns})
    return out.withColumn("abstained", low)


def retry_list(checked: DataFrame, keep: list[str]) -> DataFrame:
    return checked.where(F.size("_errors") > 0).select(*keep, F.array_join("_errors", ",").alias("reasons"))
