"""Public reports: built from attempts by allowlist, and verified by recomputing aggregates and the gate from rows.

A report is a few tables: outcomes (a row for each public attempt), metrics and intervals (a row for each
configuration) and the gate's findings. Verification never trusts an aggregate: it recomputes each from the outcomes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import disclosure as D
from tallyframe.operators import metrics as M
from tallyframe.operators import resample as B
from tallyframe.operators.casesets import tier_profile

#: Columns that a public report may show.
OUTCOME_COLUMNS = ("public_id", "smoke_only", "trial_index", "config_id", "status", "passed", "degraded", "failure_status")
METRIC_COLUMNS = ("config_id", "scored_attempts", "passes", "task_pass_rate", "paired_n", "unpaired_n", "wins", "losses")


@dataclass
class PublicReport:
    outcomes: DataFrame
    metrics: DataFrame
    intervals: DataFrame
    findings: DataFrame


def metrics_of(outcomes: DataFrame, configs: list[str]) -> DataFrame:
    """Counts, rounded pass rates and pairing of each configuration, from public rows alone."""
    rows = outcomes.select("public_id", "trial_index", "config_id", "smoke_only", "passed", F.lit(0).cast("long").alias("cost_micro"), F.monotonically_increasing_id().alias("event_id")).withColumnRenamed("public_id", "case_index")
    counts = rows.where(M.scored()).groupBy("config_id").agg(F.count(F.lit(1)).alias("scored_attempts"), F.count_if(F.col("passed")).alias("passes"))
    targets = [c for c in configs if c != "direct"]
    paired = M.paired_comparison(M.paired_outcomes(rows, "direct", targets)).select("config_id", "paired_n", "unpaired_n", "wins", "losses")
    rate = D.rounded(M.ratio_or_null(F.col("passes"), F.col("scored_attempts")))
    return counts.join(paired, "config_id", "left").withColumn("task_pass_rate", rate).select(*METRIC_COLUMNS)


def gate_of(metrics: DataFrame, intervals: DataFrame, cases: DataFrame, coverage: DataFrame, configs: list[str], disclosed: list[str] | None = None) -> DataFrame:
    """The report's gate from its own metrics and intervals, case tiers and coverage. A configuration without scored attempts wasn't run."""
    c = F.col
    profile = tier_profile(cases).select((c("n_structured_or_exact") + c("n_mixed")).alias("non_surface_cases"), c("cases").alias("scored_cases"))
    trials = coverage.agg(F.coalesce(F.max("expected"), F.lit(0)).alias("scored_trials"))
    of_all = profile.join(trials).join(D.category_evidence(cases))
    stats = metrics.join(coverage.select("config_id", "complete"), "config_id", "left").join(intervals, "config_id", "left").join(of_all)
    named = {"scored_attempts": c("scored_attempts"), "pass_rate": c("task_pass_rate"), "paired": c("paired_n"), "unpaired": c("unpaired_n"), "costs_suppressed": c("scored_cases") < D.MIN_COST_CASES, "complete": F.coalesce("complete", F.lit(False))}
    return D.report_gate(stats.withColumns(named), configs, disclosed)


def build(attempts: DataFrame, cases: DataFrame, configs_table: DataFrame, samples: int = 500, disclosed: list[str] | None = None) -> PublicReport:
    """Everything is read from ``attempts`` several times: store it first if it is costly."""
    configs = [r["config_id"] for r in configs_table.orderBy("config_order").collect()]
    outcomes = D.public_outcomes(attempts).join(attempts.select(F.format_string("case_%04d", F.col("case_index") + 1).alias("public_id"), "smoke_only").distinct(), "public_id").select(*OUTCOME_COLUMNS)
    metrics = metrics_of(outcomes, configs)
    coverage = M.coverage(attempts, configs_table)
    pairs = M.paired_outcomes(attempts, "direct", [c for c in configs if c != "direct"])
    intervals = B.bootstrap_all(attempts, pairs, coverage, "direct", samples)
    return PublicReport(outcomes, metrics, intervals, gate_of(metrics, intervals, cases, coverage, configs, disclosed))


def verify(report: PublicReport, recomputed_gate: DataFrame, configs: list[str]) -> DataFrame:
    """(code, where) of everything that is wrong: strange columns, impossible rows, aggregates or a gate that differ."""
    found = []
    for name, table, allowed in (("outcomes", report.outcomes, OUTCOME_COLUMNS), ("metrics", report.metrics, METRIC_COLUMNS)):
        for column in sorted(set(table.columns) ^ set(allowed)):
            found.append((f"{name}_columns", column))
    spark = report.outcomes.sparkSession
    out = spark.createDataFrame(found, "code string, where string") if found else spark.createDataFrame([], "code string, where string")
    if found:
        return out
    broken = D.outcome_violations(report.outcomes).select(F.col("rule").alias("code"), F.concat_ws("/", "public_id", "trial_index", "config_id").alias("where"))
    values = [c for c in METRIC_COLUMNS if c != "config_id"]
    differs = D.consistency(report.metrics, metrics_of(report.outcomes, configs), ["config_id"], values).where("NOT consistent").select(F.lit("case_metrics_mismatch").alias("code"), F.col("config_id").alias("where"))
    stale = report.findings.select("code").exceptAll(recomputed_gate.select("code")).unionByName(recomputed_gate.select("code").exceptAll(report.findings.select("code")))
    return out.unionByName(broken).unionByName(differs).unionByName(stale.select(F.lit("claim_gate_mismatch").alias("code"), F.col("code").alias("where")))
