"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: White space as the Unicode property has it (plus U+FEFF), for regular expressions.
SPACE = r"[\t-\r    -     　﻿]"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """Trimmed, white space collapsed to one blank, lower case."""
    return F.lower(F.regexp_replace(strip_space(text), f"{SPACE}+", " "))


def round_half_up(value: Column, digits: int) -> Column:
    """Ties go toward positive infinity."""
    return F.floor(value * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def to_nearest(value: Column, step: int) -> Column:
    return (F.floor(value / step + 0.5) * step).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int"))


def redact(text: Column) -> Column:
    """Keys, bearer tokens and key assignments replaced. The patterns are fixed values."""
    out = F.regexp_replace(text, r"sk-or-v1-[A-Za-z0-9_-]+", "[REDACTED]")
    out = F.regexp_replace(out, rf"(?i)Bearer{SPACE}+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    return F.regexp_replace(out, rf"(?i)(OPENROUTER_API_KEY{SPACE}*={SPACE}*)[^{SPACE[1:]}+", "$1[REDACTED]")


def redact_nested(value: Column, kind: DataType) -> Column:
    """``redact`` on every string of a value of type ``kind``, at any depth; keys of maps and names of fields stay."""
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: redact_nested(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def redact_table(rows: DataFrame) -> DataFrame:
    """Every column redacted by its type."""
    return rows.select(*[redact_nested(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def scrub(text: Column, terms: list[str], mask: str = "[MODEL_REDACTED]") -> Column:
    """Every term replaced, whatever its case; longer terms first."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, r"(?iu)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E", mask.replace("$", r"\$"))
    return text


def truncate(text: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def verdict_ab(text: Column) -> Column:
    """A or B: the answer itself or its beginning, else the one letter that stands alone; null where both or none do."""
    t = strip_space(text)
    seen = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b([AB])\b"), F.lit(1)))
    return (
        F.when((t == "A") | t.startswith("A.") | t.startswith("A)") | (F.upper(t) == "A"), "A")
        .when((t == "B") | t.startswith("B.") | t.startswith("B)") | (F.upper(t) == "B"), "B")
        .when(F.size(seen) == 1, F.get(seen, F.lit(0)))
    )


def verdict_tie(text: Column) -> Column:
    """The first of A, B and TIE that stands alone after upper-casing; TIE if none does."""
    found = F.regexp_extract(F.upper(strip_space(text)), r"\b(A|B|TIE)\b", 1)
    return F.when(found == "", "TIE").otherwise(found)


def says_none(text: Column) -> Column:
    """Whether only the letters NONE, or nothing, are there."""
    return (F.regexp_replace(F.upper(text), "[^A-Z]", "") == "NONE") | (strip_space(text) == "")


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "-"), lambda x: x != "")


def token_split(total: Column, weights: list[float]) -> list[Column]:
    """Floors of the weighted shares, at least 1 each; the rest goes to the last. Null if there are fewer tokens than parts."""
    parts = [F.greatest(F.lit(1), F.floor(total * w).cast("long")) for w in weights]
    rest = total - sum(parts[:-1], F.lit(0))
    return [F.when(total >= len(weights), p) for p in [*parts[:-1], rest]]


def error_status(name: Column) -> Column:
    """The status that an error's class stands for."""
    pairs = {"TimeoutError": "timeout", "BudgetExceededError": "budget_exhausted", "InvalidOutputError": "invalid_output"}
    out = F.lit("provider_error")
    for error, status in pairs.items():
        out = F.when(name == error, status).otherwise(out)
    return out
