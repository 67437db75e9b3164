"""Public projections: allowlisted, rounded and suppressed views, and the check of rows against aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import round_half_up, to_nearest
from tallyframe.operators.metrics import ratio_or_null, scored

#: Smallest public category, and the scored cases below which costs and latencies stay private.
MIN_CATEGORY, MIN_COST_CASES, CLAIM_CATEGORY = 5, 30, 30


def case_labels(cases: DataFrame) -> DataFrame:
    """case_index with the generated label case_0001, case_0002, ..."""
    return cases.select("case_index", F.format_string("case_%04d", F.col("case_index") + 1).alias("public_id"))


def category_labels(cases: DataFrame) -> DataFrame:
    """(category, label): generated labels in the order of each category's first scored case. Few rows: the categories."""
    first = cases.where(scored() & F.col("category").isNotNull()).groupBy("category").agg(F.min("case_index").alias("first"), F.count(F.lit(1)).alias("scored_cases"))
    return first.withColumn("label", F.format_string("category_%04d", F.row_number().over(Window.orderBy("first")))).drop("first")


def suppression(cases: DataFrame) -> DataFrame:
    """One row: why the category breakdown can't be shown; null if it can."""
    s = cases.where(scored())
    blank = s.agg(F.count_if(F.col("category").isNull()).alias("blank"))
    sizes = s.where("category IS NOT NULL").groupBy("category").count().agg(F.count(F.lit(1)).alias("groups"), F.min("count").alias("least"))
    reason = F.when(F.col("blank") > 0, "uncategorized_scored_cases").when(F.col("groups") == 0, "no_scored_categories").when(F.col("least") < MIN_CATEGORY, "small_scored_case_count_per_category")
    return blank.join(sizes).select(reason.alias("reason"))


def category_breakdown(attempts: DataFrame, cases: DataFrame) -> DataFrame:
    """Pass rates by generated category label and configuration, rounded to 4 places; no row at all when suppressed."""
    labels = category_labels(cases)
    shown = suppression(cases).where("reason IS NULL")
    rates = attempts.where(scored()).groupBy("category", "config_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("passed")).alias("passes"))
    rows = rates.join(labels, "category").join(F.broadcast(shown))
    return rows.select("label", "config_id", "scored_cases", "attempts", round_half_up(ratio_or_null(F.col("passes"), F.col("attempts")), 4).alias("task_pass_rate"), (F.col("scored_cases") >= CLAIM_CATEGORY).alias("claim_floor_met"))


def public_costs(card: DataFrame, scored_cases: int) -> DataFrame:
    """Cost rounded to 4 places and latency to the nearest 100; nulls below the minimum of scored cases."""
    open_ = F.lit(scored_cases >= MIN_COST_CASES)
    cost = lambda c: F.when(open_, round_half_up(F.col(c) / 1e6, 4))
    time = lambda c: F.when(open_, to_nearest(F.col(c), 100))
    return card.select("config_id", cost("cost_per_pass_micro").alias("cost_per_pass_usd"), cost("mean_cost_micro").alias("mean_cost_usd"), time("p50_latency_ms").alias("p50_latency_ms"), time("p95_latency_ms").alias("p95_latency_ms"), (~open_).alias("suppressed"))


def rounded(value: Column, digits: int = 4) -> Column:
    return round_half_up(value, digits)


def public_outcomes(attempts: DataFrame) -> DataFrame:
    """The allowlisted columns of an attempt under generated case labels."""
    return attempts.select(F.format_string("case_%04d", F.col("case_index") + 1).alias("public_id"), "trial_index", "config_id", "status", "passed", F.when(F.col("degraded"), True).alias("degraded"), "failure_status")


def outcome_violations(outcomes: DataFrame) -> DataFrame:
    """(public_id, trial_index, config_id, rule): passed needs completed, a failure status needs failed, ids have four digits."""
    c = F.col
    rules = {
        "passed_not_completed": c("passed") & (c("status") != "completed"),
        "failure_status_on_completed": c("failure_status").isNotNull() & (c("status") == "completed"),
        "failed_without_status": c("failure_status").isNull() & (c("status") == "failed"),
        "malformed_public_id": ~c("public_id").rlike("^case_[0-9]{4}$"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(r)) for r, cond in rules.items()]))
    return outcomes.select("public_id", "trial_index", "config_id", F.explode(found).alias("rule"))


def consistency(published: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Row for row, whether published aggregates equal those recomputed from the public rows; missing ones differ."""
    mine = recomputed.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values])
    both = published.select(*keys, *values, F.lit(True).alias("there")).join(mine.withColumn("here", F.lit(True)), keys, "full_outer")
    same = F.coalesce(F.col("there") & F.col("here"), F.lit(False))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"r_{v}"))
    return both.select(*keys, same.alias("consistent"))


def category_evidence(cases: DataFrame) -> DataFrame:
    """One row: public categories and how many lack scored cases (30) or, of the others, non-surface graders (5); nulls while suppressed."""
    evidence = F.count_if(F.col("tier").isin("structured_or_exact", "mixed"))
    each = cases.where(scored() & F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"), evidence.alias("ns"))
    c = F.col
    counts = each.agg(F.count(F.lit(1)).alias("categories"), F.count_if(c("n") < CLAIM_CATEGORY).alias("small_categories"), F.count_if((c("n") >= CLAIM_CATEGORY) & (c("ns") < MIN_CATEGORY)).alias("surface_categories"))
    return counts.join(suppression(cases)).select("categories", "small_categories", "surface_categories", c("reason").isNotNull().alias("suppressed_categories"))


def disclosure_blockers(binding: dict, case_gate: dict) -> list[str]:
    """Codes for what a report discloses of its manifest binding and of its case set's gate. Codes and values are fixed."""
    out = []
    status = binding.get("status")
    if status == "not_provided":
        out.append("case_manifest_binding_missing")
    elif status != "private_report_bound":
        out.append("case_manifest_binding_malformed")
    else:
        if binding.get("intendedUse") != "holdout":
            out.append("case_manifest_not_holdout")
        if (binding.get("hashAlgorithm"), binding.get("privacyClass")) != ("hmac-sha256", "private_audit_hmac_sha256"):
            out.append("case_manifest_not_private_audit_hmac")
    wanted = {"target": "public_cost_performance", "scope": "case_set_only", "overallClaimStatus": "external_evidence_required", "detailDisclosure": "omitted"}
    status = case_gate.get("status")
    if status == "not_provided":
        out.append("case_set_claim_gate_missing")
    elif status not in ("private_report_constraints_met", "private_report_blocked") or any(case_gate.get(k) != v for k, v in wanted.items()):
        out.append("case_set_claim_gate_malformed")
    elif status == "private_report_blocked":
        out.append("case_set_claim_gate_blocked")
    return out


def report_gate(stats: DataFrame, configs: list[str], disclosed: list[str] | None = None) -> DataFrame:
    """(severity, ordinal, code): blockers and warnings of a public report, in their fixed order, after those of ``disclosed``.

    ``stats``: one row for each configuration that was run: config_id, scored_attempts, pass_rate, complete, pass_low,
    delta_low, delta_high, cost_low, unpaired, paired, and for all the same scored_trials, scored_cases, categories,
    small_categories, surface_categories, suppressed_categories, non_surface_cases, costs_suppressed.
    """
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    c = F.col
    one = lambda name, cond: F.coalesce(F.bool_or((c("config_id") == name) & cond), F.lit(False))
    ran = {x: one(x, F.lit(True)) for x in configs}
    shown = ~any_(c("suppressed_categories"))
    some = shown & any_(c("categories") > 0)
    rules: list[tuple[str, Column]] = [(code, F.lit(True)) for code in disclosed or []]
    rules += [(f"missing_{x}_config", ~ran[x]) for x in configs]
    rules += [
        ("too_few_scored_cases", any_(c("scored_cases") < 100)),
        ("category_evidence_unavailable", ~shown),
        ("category_evidence_empty", shown & ~some),
        ("category_underpowered", some & any_(c("small_categories") > 0)),
        ("category_non_surface_grader_evidence_underpowered", some & any_(c("surface_categories") > 0)),
        ("insufficient_non_surface_grader_evidence", any_(c("non_surface_cases") < MIN_CATEGORY)),
    ]
    for x in configs:
        rules += [
            (f"{x}_scored_attempts_unavailable", one(x, F.coalesce(c("scored_attempts") <= 0, F.lit(True)))),
            (f"{x}_scored_attempt_coverage_incomplete", one(x, ~c("complete"))),
            (f"{x}_task_pass_rate_unavailable", one(x, c("pass_rate").isNull())),
            (f"{x}_task_pass_rate_interval_unavailable", one(x, c("pass_low").isNull())),
        ]
    both = ran.get("direct", F.lit(False)) & ran.get("fusion", F.lit(False))
    unpaired = one("fusion", F.coalesce(c("paired"), F.lit(0)) == 0)
    suppressed = any_(c("costs_suppressed"))
    rules += [
        ("fusion_pairing_unavailable", both & unpaired),
        ("fusion_pairing_incomplete", both & ~unpaired & one("fusion", (c("unpaired") > 0) | (c("paired") != c("scored_trials")))),
        ("fusion_pass_rate_delta_interval_unavailable", both & one("fusion", c("delta_low").isNull())),
        ("cost_latency_suppressed", suppressed),
        *[(f"{x}_cost_per_pass_interval_unavailable", ~suppressed & one(x, c("cost_low").isNull())) for x in configs],
    ]
    warnings = [
        ("public_projection_with_private_attestations", F.lit(True)),
        ("fusion_advantage_not_established", ran.get("fusion", F.lit(False)) & ~one("fusion", F.coalesce(c("delta_low") > 0, F.lit(False)))),
    ]
    rows = [F.when(cond, F.struct(F.lit(kind).alias("severity"), F.lit(i).alias("ordinal"), F.lit(code).alias("code"))) for kind, found in (("blocker", rules), ("warning", warnings)) for i, (code, cond) in enumerate(found)]
    fired = stats.agg(F.array_compact(F.array(*rows)).alias("f"))
    return fired.select(F.explode("f").alias("f")).select("f.*")
