"""Grader validation: (case_index, rule) of every rule that a case's grader breaks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyframe.functions import structured as S
from tallyframe.functions.text import normalize_text
from tallyframe.operators.grading import configured_checks

MAX_CHECKS, MAX_TERM, MAX_CHOICES, MAX_REGEX, MAX_CLAIMS = 50, 200, 50, 200, 25


def text_regex_safe(pattern: Column) -> Column:
    """1 to 200 characters without groups, alternatives, repeats or an unescaped question mark."""
    return F.length(pattern).between(1, MAX_REGEX) & ~pattern.rlike(r"[()|+*{}]") & ~pattern.rlike(r"(^|[^\\])\?")


def number_regex_safe(pattern: Column) -> Column:
    """One capture of a digit class or bracket class with a simple repeat, and safe text around it."""
    group = r"\((?:\\d|\[[^\]\r\n]+\])(?:[+*?]|\{\d{1,3}(?:,\d{1,3})?\})?\)"
    escaped = F.regexp_replace(pattern, r"\\\\|\\\(|\\\)", "_")
    around = F.regexp_replace(escaped, group, "")
    captures = F.length(escaped) - F.length(F.replace(escaped, F.lit("("), F.lit("")))
    odd = pattern.rlike(r"\\[1-9]") | F.contains(pattern, F.lit("(?")) | F.contains(pattern, F.lit("|"))
    clean = (around == "") | (~around.rlike(r"[()|+*{}]") & ~around.rlike(r"(^|[^\\])\?"))
    return F.length(pattern).between(1, MAX_REGEX) & ~odd & (captures == 1) & clean


def json_problems():
    """Rules that a JSON grader (as text) breaks."""

    def run(text: str | None) -> list[str]:
        if text is None:
            return []
        spec, out = json.loads(text), []
        paths = [*(spec.get("requiredPaths") or []), *(p for k in ("equals", "includes", "arrayMinLength") for p in (spec.get(k) or {}))]
        if any(not isinstance(p, str) or not S.path_valid(p) for p in paths):
            out.append("json_path")
        if any(isinstance(v, dict | list) for v in (spec.get("equals") or {}).values()):
            out.append("json_equals_value")
        if any(not isinstance(v, str) or len(v) > MAX_TERM for v in (spec.get("includes") or {}).values()):
            out.append("json_includes_value")
        if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in (spec.get("arrayMinLength") or {}).values()):
            out.append("json_min_length_value")
        if spec.get("schemaSubset") is not None:
            out += [f"json_{p}" for p in S.schema_problems(spec["schemaSubset"])]
        return list(dict.fromkeys(out))

    return S.vectorized(run, ArrayType(StringType()))


def citation_problems():
    """Rules that a citation grader (as text) breaks."""

    def run(text: str | None) -> list[str]:
        if text is None:
            return []
        spec = json.loads(text)
        allowed, required, claims = spec.get("allowedSourceIds") or [], spec.get("requiredSourceIds") or [], spec.get("requiredClaims") or []
        bad_ids = any(not isinstance(x, str) or not S.CITATION_ID.fullmatch(x) for x in [*allowed, *required])
        rules = {
            "citation_allowed": not 1 <= len(allowed) <= 50 or len(set(allowed)) != len(allowed) or bad_ids,
            "citation_required": len(set(required)) != len(required) or not set(required) <= set(allowed),
            "citation_minimum": "minCitedSources" in spec and not 1 <= spec["minCitedSources"] <= len(allowed),
            "citation_claims": "requiredClaims" in spec and (not 1 <= len(claims) <= MAX_CLAIMS or any(c.get("sourceId") not in allowed or not c.get("text", "").strip() for c in claims)),
        }
        return [r for r, broken in rules.items() if broken]

    return S.vectorized(run, ArrayType(StringType()))


def grader_violations(rows: DataFrame) -> DataFrame:
    """Rules of all grader families over the columns of ``grading.GRADER_COLUMNS`` that are there."""
    there = set(rows.columns)
    c = lambda n, kind="string": F.col(n) if n in there else F.lit(None).cast(kind)
    arr = lambda n: c(n, "array<string>")
    json_parts = c("json_spec").isNotNull() | c("citation_spec").isNotNull()
    checks = configured_checks(rows)
    terms = F.concat(*[F.coalesce(arr(n), F.array().cast("array<string>")) for n in ("must_include", "contains_any", "must_not_include")])
    allowed = F.transform(arr("choice_allowed"), normalize_text)
    finite = lambda n: F.isnan(c(n, "double")) | (F.abs(c(n, "double")) == float("inf"))
    rules = {
        "no_check": ~c("smoke_only", "boolean") & (checks == 0) & ~json_parts,
        "too_many_checks": checks > MAX_CHECKS,
        "lengths": (c("min_length", "int") < 0) | (c("max_length", "int") < c("min_length", "int")),
        "term": F.exists(terms, lambda t: ~F.length(t).between(1, MAX_TERM)),
        "regex": F.exists(arr("regex"), lambda p: ~text_regex_safe(p)),
        "choice_allowed": ~F.size(arr("choice_allowed")).between(1, MAX_CHOICES) | (F.size(allowed) != F.size(F.array_distinct(allowed))),
        "choice_expected": c("choice_expected").isNotNull() & ~F.coalesce(F.array_contains(allowed, normalize_text(c("choice_expected"))), F.lit(False)),
        "number_finite": finite("number_expected") | finite("number_min") | finite("number_max"),
        "number_tolerance": (c("number_tolerance", "double") < 0) | (c("number_tolerance", "double").isNotNull() & c("number_expected", "double").isNull()),
        "number_bounds": c("number_max", "double") < c("number_min", "double"),
        "number_regex": ~number_regex_safe(c("number_regex")),
    }
    plain = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(r)) for r, cond in rules.items()]))
    found = [plain]
    if "json_spec" in there:
        found.append(json_problems()(F.col("json_spec")))
    if "citation_spec" in there:
        found.append(citation_problems()(F.col("citation_spec")))
    return rows.select("case_index", F.explode(F.concat(*found)).alias("rule"))
