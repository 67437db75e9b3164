"""Call records: usage by position, totals, sampling resolution, seeds, traces and retained text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.rng import fnv1a
from tallyframe.functions.text import redact, truncate


def usage_of_calls(calls: DataFrame) -> DataFrame:
    """Each call with the usage entry that its index points at; null where it has none. Calls: calls ARRAY<STRUCT<stage, usage_index>>, usage ARRAY<STRUCT<cost, tokens>>."""
    each = calls.select("attempt", "usage", F.posexplode("calls").alias("call_no", "c"))
    return each.select("attempt", "call_no", "c.stage", F.get("usage", F.col("c.usage_index")).alias("u")).select("attempt", "call_no", "stage", "u.cost", "u.tokens")


def result_total(usage: Column) -> Column:
    """Sum of an attempt's usage costs; 0 without usage."""
    return F.aggregate(F.coalesce(F.transform(usage, lambda u: u["cost"]), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("bigint")))


def derived_seed(root: Column, material: Column, stage: Column, call: Column) -> Column:
    return fnv1a(F.concat_ws(":", root.cast("string"), F.coalesce(material, F.lit("")), stage, call.cast("string")))


def seed_policy(send: Column, requested: Column, rooted: Column, supported: Column) -> Column:
    """How a seed was handled. supported: the model's parameter names; null if they aren't known."""
    wants = send & (rooted | requested)
    return (
        F.when(~send & (requested | rooted), "not_sent_disabled")
        .when(~wants, "not_requested")
        .when(supported.isNull(), "not_sent_support_unknown")
        .when(F.array_contains(supported, "seed"), "sent")
        .otherwise("not_sent_unsupported")
    )


def applied_parameter(value: Column, name: str, supported: Column) -> Column:
    """The value unless the model is known not to take it."""
    return F.when(F.coalesce(F.array_contains(supported, name), F.lit(True)), value)


def pinning_status(allow_fallbacks: Column, order: Column) -> Column:
    """How far the provider endpoint is pinned."""
    full = F.get(order, F.lit(0)).rlike(r"^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)+$")
    return (
        F.when(F.coalesce(allow_fallbacks, F.lit(True)), "fallbacks_allowed")
        .when(F.coalesce(F.size(order), F.lit(0)) <= 0, "not_configured")
        .when(F.size(order) != 1, "multiple_provider_endpoints_allowed")
        .when(full, "single_provider_endpoint_pinned")
        .otherwise("base_provider_slug_only")
    )


def degraded(candidates: Column, failures: Column) -> Column:
    return (candidates < 2) | (failures > 0)


def verification_passed(kind: Column) -> Column:
    """Only the kind ``none`` passes: nothing else is implemented."""
    return kind == "none"


def trace_rows(attempts: DataFrame, answer_col: str, keep_text: bool = False, limit: int = 10_000) -> DataFrame:
    """Digest, length and, if kept, the redacted and cut answer of each attempt."""
    text = F.col(answer_col)
    kept = truncate(redact(text), limit) if keep_text else F.lit(None).cast("string")
    return attempts.select("case_index", F.sha2(text, 256).alias("answer_sha256"), F.length(text).alias("answer_chars"), kept.alias("answer"), (F.length(text) > limit).alias("cut"))


def request_text(task: Column, constraints: Column) -> Column:
    """The request as JSON: task, constraints, verification."""
    return F.to_json(F.struct(task.alias("task"), F.coalesce(constraints, F.array().cast("array<string>")).alias("constraints"), F.lit("none").alias("verification")))


def confirmed_findings(findings: DataFrame) -> DataFrame:
    """Confirmed findings with their corrected severity, one row for each, and the roles that raised it."""
    kept = findings.where("verdict = 'confirmed'").withColumn("severity", F.coalesce("corrected_severity", "severity"))
    return kept.groupBy("finding", "severity").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def sorted_map(values: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(values)))
