"""Deterministic grading of answers: a check struct for each configured check, in a fixed order.

``GRADER_COLUMNS`` are the nullable columns that a row of (answer, grader) may have; missing ones count as null.
JSON and citation graders are JSON texts and run in Arrow-batched UDFs; everything else stays in the JVM.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import structured
from tallyframe.functions.text import normalize_text

MAX_ANSWER = 20_000
#: Fixed value: the grammar of a number in an answer.
NUMBER = r"[+-]?(?:(?:\d+\.?\d*)|(?:\.\d+))(?:[eE][+-]?\d+)?"
CHECK_TYPE = "struct<name:string,passed:boolean,details:string>"
GRADER_COLUMNS = {
    "smoke_only": "boolean", "exact": "string", "exact_normalized": "string", "must_include": "array<string>", "contains_any": "array<string>",
    "must_not_include": "array<string>", "regex": "array<string>", "min_length": "int", "max_length": "int", "choice_expected": "string", "choice_allowed": "array<string>",
    "number_expected": "double", "number_tolerance": "double", "number_min": "double", "number_max": "double", "number_regex": "string", "json_spec": "string", "citation_spec": "string",
}
#: The check names that a public projection may show.
PUBLIC_CHECKS = (
    "exact", "exact_normalized", "must_include", "contains_any", "must_not_include", "regex", "min_length", "max_length", "choice_valid", "choice_expected",
    "json_valid", "json_required_path", "json_equals", "json_includes", "json_array_min_length", "json_schema_subset", "json_check", "number_found", "number_expected", "number_min", "number_max",
    "citation_allowed_sources", "citation_required_source", "citation_min_sources", "citation_required_claim", "answer_size", "grader_configured", "smoke_only", "run_completed", "other_check",
)


def check(name: str | Column, passed: Column, details: Column | str | None = None) -> Column:
    label = F.lit(name) if isinstance(name, str) else name
    why = F.lit(details).cast("string") if details is None or isinstance(details, str) else details
    return F.struct(label.alias("name"), passed.alias("passed"), why.alias("details")).cast(CHECK_TYPE)


def _only(cond: Column, *checks: Column) -> Column:
    """These checks where ``cond`` holds, else none."""
    return F.when(cond, F.array(*checks)).otherwise(F.array().cast(f"array<{CHECK_TYPE}>"))


def _each(terms: Column, name: str, test) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(terms, empty), lambda t: check(name, test(t)))


def contains_term(answer: Column, term: Column) -> Column:
    return F.contains(F.lower(answer), F.lower(term))


def number_result(answer: Column, pattern: Column | None = None) -> Column:
    """A struct of value and reason: the first number, or capture 1 of the pattern; the reason is null where a value was found.

    Each step is a lambda over one element, so that an answer is searched once however often its parts are used.
    """
    head = F.left(answer, F.lit(MAX_ANSWER))
    found = F.regexp_substr(head, F.lit(NUMBER))
    if pattern is not None:
        found = F.when(pattern.isNull(), found).otherwise(F.regexp_extract(head, pattern, 1) if isinstance(pattern, str) else F.call_function("regexp_extract", head, pattern, F.lit(1)))
    raw = F.array(F.nullif(found, F.lit("")))
    read = F.transform(raw, lambda r: F.struct(r.alias("raw"), F.when(F.regexp_like(r, F.lit(f"^{NUMBER}$")), F.struct(r.try_cast("double").alias("x"))).alias("well")))

    def judge(r: Column) -> Column:
        value = r["well"]["x"]
        infinite = F.abs(value) == F.lit(float("inf"))
        reason = F.when(r["raw"].isNull(), "number_not_found").when(r["well"].isNull(), "invalid_number_text").when(value.isNull() | infinite, "number_not_finite")
        return F.struct(F.when(~infinite, value).alias("value"), reason.alias("reason"))

    return F.transform(read, judge)[0]


def extract_number(answer: Column, pattern: Column | None = None) -> tuple[Column, Column]:
    """(value, reason) of ``number_result``; where both are used often, make that a column first."""
    found = number_result(answer, pattern)
    return found["value"], found["reason"]


def choice_result(answer: Column, expected: Column, allowed: Column) -> Column:
    """A struct of valid and right; every text is normalized once."""
    texts = F.array(F.struct(normalize_text(answer).alias("given"), normalize_text(expected).alias("want")))
    return F.transform(texts, lambda t: F.struct(F.array_contains(F.transform(allowed, normalize_text), t["given"]).alias("valid"), (t["given"] == t["want"]).alias("right")))[0]


def choice_checks(found: Column) -> list[Column]:
    valid, right = found["valid"], found["right"]
    return [
        check("choice_valid", valid, F.when(~valid, "choice_not_allowed")),
        check("choice_expected", right, F.when(~right, F.when(valid, "wrong_choice").otherwise("choice_not_allowed"))),
    ]


def grade(rows: DataFrame, answer_col: str = "answer") -> DataFrame:
    """``rows`` with checks and passed. Smoke cases pass; an answer that is too long, or no check at all, fails.

    Python runs only for JSON and citation graders whose column is given.
    """
    given = set(rows.columns)
    for name, kind in GRADER_COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    c, a = F.col, F.col(answer_col)
    none = F.array().cast(f"array<{CHECK_TYPE}>")
    rows = rows.withColumn("_json", F.coalesce(structured.json_checks()(a, c("json_spec")).cast(f"array<{CHECK_TYPE}>"), none) if "json_spec" in given else none)
    rows = rows.withColumn("_cited", F.coalesce(structured.citation_checks()(a, c("citation_spec")).cast(f"array<{CHECK_TYPE}>"), none) if "citation_spec" in given else none)
    wants_number = c("number_expected").isNotNull() | c("number_min").isNotNull() | c("number_max").isNotNull()
    rows = rows.withColumn("_number", F.when(wants_number, number_result(a, c("number_regex") if "number_regex" in given else None)))
    rows = rows.withColumn("_choice", F.when(c("choice_expected").isNotNull(), choice_result(a, c("choice_expected"), c("choice_allowed"))))
    value, reason = c("_number.value"), c("_number.reason")
    parts = [
        _only(c("exact").isNotNull(), check("exact", a == c("exact"))),
        _only(c("exact_normalized").isNotNull(), check("exact_normalized", normalize_text(a) == normalize_text(c("exact_normalized")))),
        _each(c("must_include"), "must_include", lambda t: contains_term(a, t)),
        _only(c("contains_any").isNotNull(), check("contains_any", F.coalesce(F.exists(c("contains_any"), lambda t: contains_term(a, t)), F.lit(False)))),
        _each(c("must_not_include"), "must_not_include", lambda t: ~contains_term(a, t)),
        _each(c("regex"), "regex", lambda p: F.regexp_like(a, F.concat(F.lit("(?iu)"), p))),
        _only(c("min_length").isNotNull(), check("min_length", F.length(a) >= c("min_length"))),
        _only(c("max_length").isNotNull(), check("max_length", F.length(a) <= c("max_length"))),
        _only(c("choice_expected").isNotNull(), *choice_checks(c("_choice"))),
        c("_json"),
        _only(wants_number & reason.isNotNull(), check("number_found", F.lit(False), reason)),
        _only(wants_number & reason.isNull() & c("number_expected").isNotNull(), check("number_expected", F.abs(value - c("number_expected")) <= F.coalesce(c("number_tolerance"), F.lit(0.0)), "absolute_tolerance")),
        _only(wants_number & reason.isNull() & c("number_min").isNotNull(), check("number_min", value >= c("number_min"))),
        _only(wants_number & reason.isNull() & c("number_max").isNotNull(), check("number_max", value <= c("number_max"))),
        c("_cited"),
    ]
    configured = F.concat(*parts)
    checks = (
        F.when(F.coalesce(c("smoke_only"), F.lit(False)), F.array(check("smoke_only", F.lit(True))))
        .when(F.length(a) > MAX_ANSWER, F.array(check("answer_size", F.lit(False), "answer_too_large")))
        .when(F.size(configured) == 0, F.array(check("grader_configured", F.lit(False), "Case has no deterministic grader; mark smokeOnly for smoke tests.")))
        .otherwise(configured)
    )
    graded = rows.withColumn("checks", checks).drop("_json", "_cited", "_number", "_choice")
    return graded.withColumn("passed", F.forall("checks", lambda x: F.coalesce(x["passed"], F.lit(False))))


def check_kind_counts(graded: DataFrame) -> DataFrame:
    """Cases that have a check of each public kind; unknown kinds are other_check."""
    kind = F.when(F.col("check.name").isin(*PUBLIC_CHECKS), F.col("check.name")).otherwise("other_check")
    seen = graded.select("case_index", F.explode("checks").alias("check")).select("case_index", kind.alias("kind")).distinct()
    return seen.where(F.col("kind") != "run_completed").groupBy("kind").agg(F.count(F.lit(1)).alias("cases"))


def public_checks(graded: DataFrame) -> DataFrame:
    """Index, kind and result of each check, and their counts; details stay private."""
    shown = F.transform("checks", lambda x, i: F.struct(i.alias("index"), F.when(x["name"].isin(*PUBLIC_CHECKS), x["name"]).otherwise("other_check").alias("kind"), x["passed"].alias("passed")))
    good = F.size(F.filter("checks", lambda x: x["passed"]))
    return graded.select("case_index", "passed", shown.alias("checks"), F.size("checks").alias("total"), good.alias("passed_checks"), (F.size("checks") - good).alias("failed_checks"))


def configured_checks(rows: DataFrame) -> Column:
    """How many checks a grader configures (containsAny counts once, a choice twice, JSON each path and rule, citations 1 + required + minimum + claims)."""
    have = lambda n: F.coalesce(F.col(n).isNotNull().cast("int"), F.lit(0))
    many = lambda n: F.coalesce(F.size(n), F.lit(0)) if n in rows.columns else F.lit(0)
    total = F.lit(0)
    for n in ("exact", "exact_normalized", "min_length", "max_length", "number_expected", "number_min", "number_max"):
        total = total + (have(n) if n in rows.columns else F.lit(0))
    for n in ("must_include", "must_not_include", "regex"):
        total = total + F.greatest(many(n), F.lit(0))
    if "contains_any" in rows.columns:
        total = total + (F.coalesce(F.size("contains_any"), F.lit(0)) > 0).cast("int")
    if "choice_expected" in rows.columns:
        total = total + have("choice_expected") * 2
    if "json_spec" in rows.columns:
        total = total + _json_check_count(F.from_json("json_spec", JSON_SPEC))
    if "citation_spec" in rows.columns:
        spec = F.from_json("citation_spec", CITATION_SPEC)
        cited = 1 + _length(spec["requiredSourceIds"]) + spec["minCitedSources"].isNotNull().cast("int") + _length(spec["requiredClaims"])
        total = total + F.when(F.col("citation_spec").isNotNull(), cited).otherwise(0)
    return total


#: What is counted of a JSON and of a citation grader; values are not looked into.
JSON_SPEC = "requireValid boolean, requiredPaths array<string>, equals map<string,string>, includes map<string,string>, arrayMinLength map<string,string>, schemaSubset string"
CITATION_SPEC = "requiredSourceIds array<string>, minCitedSources int, requiredClaims array<string>"


def _length(x: Column) -> Column:
    return F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))


def _json_check_count(spec: Column) -> Column:
    lists = [_length(spec[n]) for n in ("requiredPaths", "equals", "includes", "arrayMinLength")]
    return sum(lists, F.coalesce(spec["requireValid"], F.lit(False)).cast("int") + spec["schemaSubset"].isNotNull().cast("int"))


def tier(rows: DataFrame) -> Column:
    """smoke_only, ungraded, mixed, structured_or_exact or surface_text, by the graders that a case has."""
    any_of = lambda conds: reduce(or_, conds, F.lit(False))
    there = lambda names: any_of([F.col(n).isNotNull() for n in names if n in rows.columns])
    exact = there(["exact", "exact_normalized", "choice_expected", "json_spec", "number_expected", "number_min", "number_max", "citation_spec"])
    filled = [F.coalesce(F.size(n), F.lit(0)) > 0 for n in ("must_include", "contains_any", "must_not_include", "regex") if n in rows.columns]
    surface = there(["min_length", "max_length"]) | any_of(filled)
    return F.when(F.col("smoke_only"), "smoke_only").when(exact & surface, "mixed").when(exact, "structured_or_exact").when(surface, "surface_text").otherwise("ungraded")
