"""Metric queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import metrics as M
from tallyframe.plans import proxy as P

_CASE_RATE = "CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE {0}) / count(*) END"


def _card(spark, d):
    return M.scorecard(P.attempts(spark, d), P.configs(spark))


CARD_SQL = (
    P.ATTEMPTS_SQL
    + """,
s AS (SELECT config_id, count(*) AS n, count(*) FILTER (WHERE NOT smoke_only) AS scored_n, count(*) FILTER (WHERE NOT smoke_only AND passed) AS passes,
    CAST(sum(cost_micro) FILTER (WHERE NOT smoke_only) AS BIGINT) AS scored_cost, CAST(sum(cost_micro) AS BIGINT) AS total_cost,
    quantile_disc(latency_ms, 0.5) FILTER (WHERE status = 'completed') AS p50, quantile_disc(latency_ms, 0.95) FILTER (WHERE status = 'completed') AS p95,
    count(*) FILTER (WHERE failure_status = 'timeout') AS f1, count(*) FILTER (WHERE failure_status = 'provider_error') AS f2,
    count(*) FILTER (WHERE failure_status = 'invalid_output') AS f3, count(*) FILTER (WHERE failure_status = 'budget_exhausted') AS f4,
    count(*) FILTER (WHERE degraded) AS dg, count(*) FILTER (WHERE smoke_only) AS sm, count(*) FILTER (WHERE smoke_only AND status = 'completed') AS smd
  FROM attempts GROUP BY config_id),
card AS (SELECT c.config_id, coalesce(scored_n, 0) AS scored_attempt_n, passes / nullif(scored_n, 0) AS task_pass_rate, scored_cost / nullif(passes, 0) AS cost_per_pass_micro,
    scored_cost / nullif(scored_n, 0) AS mean_cost_micro, coalesce(total_cost, 0) AS total_cost_micro, CAST(coalesce(p50, 0) AS BIGINT) AS p50_latency_ms, CAST(coalesce(p95, 0) AS BIGINT) AS p95_latency_ms,
    coalesce(f1 / n, 0.0) AS timeout_rate, coalesce(f2 / n, 0.0) AS provider_error_rate, coalesce(f3 / n, 0.0) AS invalid_output_rate, coalesce(f4 / n, 0.0) AS budget_exhausted_rate,
    coalesce(dg / n, 0.0) AS partial_failure_rate, coalesce(smd / nullif(sm, 0), 0.0) AS smoke_completion_rate
  FROM configs c LEFT JOIN s ON c.config_id = s.config_id)"""
)

PAIRS_SQL = (
    P.ATTEMPTS_SQL
    + """,
fo AS (SELECT case_index, trial_index, config_id, arg_min(passed, event_id) AS passed, arg_min(cost_micro, event_id) AS cost_micro FROM attempts WHERE NOT smoke_only GROUP BY ALL),
tr AS (SELECT DISTINCT case_index, trial_index, category FROM attempts WHERE NOT smoke_only),
pairs AS (SELECT tr.case_index, tr.trial_index, tr.category, t.config_id, b.passed AS base_passed, x.passed AS target_passed, x.cost_micro - b.cost_micro AS cost_delta
  FROM tr CROSS JOIN (SELECT config_id FROM configs WHERE config_id <> 'direct') t
  LEFT JOIN fo b ON b.case_index = tr.case_index AND b.trial_index = tr.trial_index AND b.config_id = 'direct'
  LEFT JOIN fo x ON x.case_index = tr.case_index AND x.trial_index = tr.trial_index AND x.config_id = t.config_id)"""
)


def _comparison_sql(keys: str) -> str:
    return f"""WITH {PAIRS_SQL},
q AS (SELECT config_id{keys}, count(*) FILTER (WHERE base_passed IS NOT NULL AND target_passed IS NOT NULL) AS paired_n, count(*) FILTER (WHERE base_passed IS NULL OR target_passed IS NULL) AS unpaired_n,
  count(*) FILTER (WHERE target_passed AND NOT base_passed) AS wins, count(*) FILTER (WHERE NOT target_passed AND base_passed) AS losses, count(*) FILTER (WHERE target_passed = base_passed) AS ties, CAST(sum(cost_delta) AS BIGINT) AS cd
  FROM pairs GROUP BY config_id{keys})
SELECT config_id{keys}, paired_n, unpaired_n, wins, losses, ties, (wins - losses) / nullif(paired_n, 0) AS pass_rate_delta, cd / nullif(paired_n, 0) AS mean_cost_delta_micro,
  CASE WHEN wins > losses THEN cd / (wins - losses) END AS incremental_cost_micro, losses / nullif(paired_n, 0) AS harm_rate FROM q"""


def _pairs(spark, d, keys=None):
    return M.paired_outcomes(P.attempts(spark, d), "direct", ["self_review", "repeated", "fusion"], keys)


def _schedule(spark, d):
    return M.schedule(P.cases(spark, d), P.configs(spark), 3)


SCHEDULE_SQL = (
    P.CASES_SQL
    + """,
sch AS (SELECT case_index, t AS trial_index, smoke_only, config_id, CAST(((config_order - (case_index * 3 + t)) % 4 + 4) % 4 AS INT) AS position FROM cases, range(0, 3) r(t), configs)"""
)
ROLLUP_SQL = """SELECT coalesce(d, 'all') AS difficulty, config_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE passed) AS passed
FROM (SELECT *, coalesce(difficulty, 'none') AS d FROM {0}) x GROUP BY GROUPING SETS ((d, config_id), (config_id))"""
HEADROOM_SQL = "SELECT case_index FROM attempts WHERE NOT smoke_only AND config_id = 'direct' GROUP BY case_index HAVING NOT bool_and(passed)"

QUERIES = {
    "config_scorecard": (_card, f"WITH {CARD_SQL} SELECT * FROM card"),
    "pass_rate": (lambda s, d: _card(s, d).select("config_id", "scored_attempt_n", "task_pass_rate"), f"WITH {CARD_SQL} SELECT config_id, scored_attempt_n, task_pass_rate FROM card"),
    "cost_per_pass": (lambda s, d: _card(s, d).select("config_id", "cost_per_pass_micro", "mean_cost_micro", "total_cost_micro"), f"WITH {CARD_SQL} SELECT config_id, cost_per_pass_micro, mean_cost_micro, total_cost_micro FROM card"),
    "latency_p50_p95": (lambda s, d: _card(s, d).select("config_id", "p50_latency_ms", "p95_latency_ms"), f"WITH {CARD_SQL} SELECT config_id, p50_latency_ms, p95_latency_ms FROM card"),
    "status_rates": (lambda s, d: _card(s, d).select("config_id", "timeout_rate", "provider_error_rate", "invalid_output_rate", "budget_exhausted_rate"), f"WITH {CARD_SQL} SELECT config_id, timeout_rate, provider_error_rate, invalid_output_rate, budget_exhausted_rate FROM card"),
    "partial_failure_rate": (lambda s, d: _card(s, d).select("config_id", "partial_failure_rate", "smoke_completion_rate"), f"WITH {CARD_SQL} SELECT config_id, partial_failure_rate, smoke_completion_rate FROM card"),
    "runtime_failure_max": (lambda s, d: M.max_failure_rate(_card(s, d)), f"WITH {CARD_SQL} SELECT config_id, greatest(timeout_rate, provider_error_rate, invalid_output_rate, budget_exhausted_rate, partial_failure_rate) AS max_failure_rate FROM card"),
    "verification_failure_rate": (
        lambda s, d: M.verification_failure_rate(P.attempts(s, d), F.col("latency_ms") % 7 != 0),
        f"WITH {P.ATTEMPTS_SQL} SELECT config_id, coalesce(count(*) FILTER (WHERE NOT smoke_only AND status = 'completed' AND latency_ms % 7 = 0) / nullif(count(*) FILTER (WHERE NOT smoke_only), 0), 0.0) AS verification_failure_rate FROM attempts GROUP BY config_id",
    ),
    "paired_vs_direct": (lambda s, d: M.paired_comparison(_pairs(s, d)), _comparison_sql("")),
    "paired_by_category": (lambda s, d: M.paired_comparison(_pairs(s, d, ["category"]), ["category"]), _comparison_sql(", category")),
    "harm_flags": (lambda s, d: M.harm_flags(_pairs(s, d)), f"WITH {PAIRS_SQL} SELECT case_index, trial_index, config_id, coalesce(base_passed AND NOT target_passed, false) AS harm FROM pairs"),
    "schedule_rotation": (lambda s, d: _schedule(s, d).drop("smoke_only"), f"WITH {SCHEDULE_SQL} SELECT case_index, CAST(trial_index AS INT) AS trial_index, config_id, position FROM sch"),
    "position_counts": (lambda s, d: M.position_counts(_schedule(s, d)), f"WITH {SCHEDULE_SQL} SELECT config_id, position, count(*) AS all_n, count(*) FILTER (WHERE NOT smoke_only) AS scored_n FROM sch GROUP BY ALL"),
    "scored_attempt_coverage": (
        lambda s, d: M.coverage(P.attempts(s, d), P.configs(s)),
        f"""WITH {P.ATTEMPTS_SQL}, t AS (SELECT DISTINCT case_index, trial_index FROM attempts WHERE NOT smoke_only),
g AS (SELECT t.case_index, t.trial_index, c.config_id, count(a.event_id) AS n FROM t CROSS JOIN configs c LEFT JOIN attempts a ON a.case_index = t.case_index AND a.trial_index = t.trial_index AND a.config_id = c.config_id AND NOT a.smoke_only GROUP BY ALL)
SELECT config_id, count(*) AS expected, CAST(sum(n) AS BIGINT) AS observed, count(*) FILTER (WHERE n <> 1) AS incomplete_trials, count(*) FILTER (WHERE n <> 1) = 0 AS complete FROM g GROUP BY config_id""",
    ),
    "completion_quality_rollup": (lambda s, d: M.completion_rollup(P.attempts(s, d)), f"WITH {P.ATTEMPTS_SQL} {ROLLUP_SQL.format('attempts')}"),
    "headroom_cases": (lambda s, d: M.headroom_cases(P.attempts(s, d), "direct"), f"WITH {P.ATTEMPTS_SQL} {HEADROOM_SQL}"),
    "headroom_rollup": (lambda s, d: M.headroom_rollup(P.attempts(s, d), "direct"), f"WITH {P.ATTEMPTS_SQL}, h AS (SELECT * FROM attempts WHERE case_index IN ({HEADROOM_SQL})) {ROLLUP_SQL.format('h')}"),
    "budget_breaches": (
        lambda s, d: M.running_budget(P.attempts(s, d), 100_000),
        f"WITH {P.ATTEMPTS_SQL}, r AS (SELECT case_index, event_id, CAST(sum(cost_micro) OVER (PARTITION BY case_index ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_micro FROM attempts) SELECT case_index, event_id, spent_micro, 100000 - spent_micro AS left_micro, spent_micro > 100000 AS over FROM r",
    ),
}
