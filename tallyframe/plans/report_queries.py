"""Report queries: a public report, and its verification after a few falsifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import disclosure as D
from tallyframe.operators import metrics as M
from tallyframe.operators import resample as B
from tallyframe.operators import verifier as R
from tallyframe.plans import proxy as P
from tallyframe.plans.metric_queries import PAIRS_SQL
from tallyframe.plans.resample_queries import INDEX_SQL, Q, RESAMPLES


def _report(s, d):
    return R.build(P.attempts(s, d), P.cases(s, d), P.configs(s))


def _verify(s, d):
    """One configuration's passes and one outcome are falsified."""
    report = _report(s, d)
    gate = report.findings
    report.metrics = report.metrics.withColumn("passes", F.when(F.col("config_id") == "repeated", F.col("passes") + 1).otherwise(F.col("passes")))
    report.findings = gate.where("code <> 'category_underpowered'")
    found = R.verify(report, gate, list(P.CONFIGS))
    return found


_METRICS = f"""{PAIRS_SQL}, c AS (SELECT config_id, count(*) AS scored_attempts, count(*) FILTER (WHERE passed) AS passes FROM attempts WHERE NOT smoke_only GROUP BY config_id),
q AS (SELECT config_id, count(*) FILTER (WHERE base_passed IS NOT NULL AND target_passed IS NOT NULL) AS paired_n, count(*) FILTER (WHERE base_passed IS NULL OR target_passed IS NULL) AS unpaired_n, count(*) FILTER (WHERE target_passed AND NOT base_passed) AS wins, count(*) FILTER (WHERE NOT target_passed AND base_passed) AS losses FROM pairs GROUP BY config_id)"""

#: Disclosures of the gate's query: a binding to a development manifest by bare digests, and a case set that was blocked.
BINDING = {"status": "private_report_bound", "intendedUse": "dev", "hashAlgorithm": "sha256", "privacyClass": "public_or_frozen_sha256"}
CASE_GATE = {"status": "private_report_blocked", "target": "public_cost_performance", "scope": "case_set_only", "overallClaimStatus": "external_evidence_required", "detailDisclosure": "omitted"}


def _intervals(s, d):
    """Coverage as if complete, so that the intervals themselves are compared."""
    attempts = P.attempts(s, d)
    pairs = M.paired_outcomes(attempts, "direct", ["self_review", "repeated", "fusion"])
    return B.bootstrap_all(attempts, pairs, P.configs(s).select("config_id", F.lit(True).alias("complete")), "direct", RESAMPLES)


def _gate(s, d):
    return R.build(P.attempts(s, d), P.cases(s, d), P.configs(s), RESAMPLES, D.disclosure_blockers(BINDING, CASE_GATE)).findings.select("severity", "code")


def _bounds(value: str, shown: str) -> str:
    low, high = (Q.format(at).replace("(v)", f"({value})").replace("v IS", f"{value} IS") for at in ("0.025", "0.975"))
    return f"CASE WHEN {shown} THEN {low} END AS {value}_low, CASE WHEN {shown} THEN {high} END AS {value}_high"


INTERVALS_SQL = f"""{INDEX_SQL},
own AS (SELECT case_index, config_id, count(*) AS n, count(*) FILTER (WHERE passed) AS p, sum(cost_micro) AS c FROM attempts WHERE NOT smoke_only GROUP BY ALL),
two AS (SELECT case_index, config_id, count(*) AS pn, sum(target_passed::INT - base_passed::INT) AS net FROM pairs WHERE base_passed IS NOT NULL AND target_passed IS NOT NULL GROUP BY ALL),
drawn AS (SELECT sample, own.config_id, CAST(sum(p * times) AS BIGINT) / nullif(CAST(sum(n * times) AS BIGINT), 0) AS pass, CAST(sum(coalesce(net, 0) * times) AS BIGINT) / nullif(CAST(sum(coalesce(pn, 0) * times) AS BIGINT), 0) AS delta,
    CAST(sum(c * times) AS BIGINT) / nullif(CAST(sum(p * times) AS BIGINT), 0) AS cost FROM ix JOIN sc USING (ordinal) JOIN own USING (case_index) LEFT JOIN two ON two.case_index = own.case_index AND two.config_id = own.config_id GROUP BY ALL),
iv AS (SELECT config_id, {_bounds('pass', 'true')}, {_bounds('delta', "config_id <> 'direct'")}, {_bounds('cost', f'count(cost) > 0 AND count(cost) >= {RESAMPLES} / 2')}, {RESAMPLES} - count(cost) AS zero_pass_samples FROM drawn GROUP BY config_id)"""

_CASES = P.CASES_SQL[len(P.ATTEMPTS_SQL) :]
GATE_SQL = f"""WITH RECURSIVE {_METRICS}{_CASES}, {INTERVALS_SQL},
tr2 AS (SELECT DISTINCT case_index, trial_index FROM attempts WHERE NOT smoke_only),
grid AS (SELECT tr2.case_index, tr2.trial_index, k.config_id, count(a.event_id) AS n FROM tr2 CROSS JOIN configs k LEFT JOIN attempts a ON a.case_index = tr2.case_index AND a.trial_index = tr2.trial_index AND a.config_id = k.config_id AND NOT a.smoke_only GROUP BY ALL),
cov AS (SELECT config_id, count(*) AS expected, count(*) FILTER (WHERE n <> 1) = 0 AS complete FROM grid GROUP BY config_id),
stat AS (SELECT c.*, q.paired_n, q.unpaired_n, cov.expected, coalesce(cov.complete, false) AS whole, (SELECT complete FROM cov WHERE config_id = 'direct') AS base_whole, pass_low, delta_low, cost_low
  FROM c LEFT JOIN q ON q.config_id = c.config_id LEFT JOIN cov ON cov.config_id = c.config_id LEFT JOIN iv ON iv.config_id = c.config_id),
each_cat AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE tier IN ('structured_or_exact', 'mixed')) AS ns FROM cases WHERE NOT smoke_only AND category IS NOT NULL GROUP BY category),
o AS (SELECT count(*) AS scored, count(*) FILTER (WHERE tier IN ('structured_or_exact', 'mixed')) AS evidence, count(*) FILTER (WHERE category IS NULL) AS blank, (SELECT count(*) FROM each_cat) AS cats, (SELECT min(n) FROM each_cat) AS least FROM cases WHERE NOT smoke_only),
f AS (SELECT *, blank > 0 OR cats = 0 OR least < 5 AS hidden FROM o)
SELECT 'blocker' AS severity, 'case_manifest_not_holdout' AS code UNION ALL SELECT 'blocker', 'case_manifest_not_private_audit_hmac' UNION ALL SELECT 'blocker', 'case_set_claim_gate_blocked'
UNION ALL SELECT 'blocker', 'missing_' || config_id || '_config' FROM configs WHERE config_id NOT IN (SELECT config_id FROM stat)
UNION ALL SELECT 'blocker', 'too_few_scored_cases' FROM f WHERE scored < 100
UNION ALL SELECT 'blocker', 'category_evidence_unavailable' FROM f WHERE hidden
UNION ALL SELECT 'blocker', 'category_underpowered' FROM f WHERE NOT hidden AND least < 30
UNION ALL SELECT 'blocker', 'category_non_surface_grader_evidence_underpowered' FROM f WHERE NOT hidden AND EXISTS (SELECT 1 FROM each_cat WHERE n >= 30 AND ns < 5)
UNION ALL SELECT 'blocker', 'insufficient_non_surface_grader_evidence' FROM f WHERE evidence < 5
UNION ALL SELECT 'blocker', config_id || '_scored_attempt_coverage_incomplete' FROM stat WHERE NOT whole
UNION ALL SELECT 'blocker', config_id || '_task_pass_rate_interval_unavailable' FROM stat WHERE NOT whole OR pass_low IS NULL
UNION ALL SELECT 'blocker', 'fusion_pairing_unavailable' FROM stat WHERE config_id = 'fusion' AND paired_n = 0
UNION ALL SELECT 'blocker', 'fusion_pairing_incomplete' FROM stat WHERE config_id = 'fusion' AND paired_n > 0 AND (unpaired_n > 0 OR paired_n <> expected)
UNION ALL SELECT 'blocker', 'fusion_pass_rate_delta_interval_unavailable' FROM stat WHERE config_id = 'fusion' AND NOT (whole AND base_whole AND delta_low IS NOT NULL)
UNION ALL SELECT 'blocker', 'cost_latency_suppressed' FROM f WHERE scored < 30
UNION ALL SELECT 'blocker', config_id || '_cost_per_pass_interval_unavailable' FROM stat, f WHERE scored >= 30 AND cost_low IS NULL
UNION ALL SELECT 'warning', 'public_projection_with_private_attestations'
UNION ALL SELECT 'warning', 'fusion_advantage_not_established' FROM stat WHERE config_id = 'fusion' AND NOT coalesce(whole AND base_whole AND delta_low > 0, false)"""

QUERIES = {
    "report_intervals": (_intervals, f"WITH RECURSIVE {PAIRS_SQL}, {INTERVALS_SQL} SELECT * FROM iv"),
    "public_gate_findings": (_gate, GATE_SQL),
    "public_report_metrics": (
        lambda s, d: _report(s, d).metrics,
        f"WITH {_METRICS} SELECT c.config_id, scored_attempts, passes, floor(passes / scored_attempts * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS task_pass_rate, paired_n, unpaired_n, wins, losses FROM c LEFT JOIN q ON c.config_id = q.config_id",
    ),
    "public_report_verification": (_verify, "SELECT * FROM (VALUES ('case_metrics_mismatch', 'repeated'), ('claim_gate_mismatch', 'category_underpowered')) t(code, \"where\")"),
}
