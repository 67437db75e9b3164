"""Resampling queries; the SQL twins walk the stream with a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import rng
from tallyframe.operators import metrics as M
from tallyframe.operators import resample as R
from tallyframe.plans import proxy as P
from tallyframe.plans.metric_queries import PAIRS_SQL

#: Resamples of the queries: the reference's default, and the least it publishes intervals for.
RESAMPLES = 500
#: Resamples of the SQL twins, which walk the stream by recursion: as many.
SAMPLES = RESAMPLES


def _stream_sql(n: str) -> str:
    return f"st AS (SELECT CAST(1 AS BIGINT) AS place, CAST(({rng.BOOTSTRAP_SEED} * {rng.MULTIPLIER}::BIGINT + {rng.INCREMENT}) % 4294967296 AS BIGINT) AS state UNION ALL SELECT place + 1, CAST((state * {rng.MULTIPLIER} + {rng.INCREMENT}) % 4294967296 AS BIGINT) FROM st WHERE place < {n})"


INDEX_SQL = f"""sc AS (SELECT case_index, CAST(row_number() OVER (ORDER BY case_index) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT case_index FROM attempts WHERE NOT smoke_only) x),
n AS (SELECT count(*) AS n FROM sc), {_stream_sql(f'(SELECT n * {SAMPLES} FROM n)')},
ix AS (SELECT CAST((place - 1) // (SELECT n FROM n) AS INT) AS sample, CAST(floor(state / 4294967296.0::DOUBLE * (SELECT n FROM n)) AS INT) AS ordinal, count(*) AS times FROM st GROUP BY ALL)"""
WITH = f"WITH RECURSIVE {PAIRS_SQL}, {INDEX_SQL}"
Q = "list_sort(list(v) FILTER (WHERE v IS NOT NULL))[CAST(floor((count(v) - 1) * {0}::DOUBLE) AS INT) + 1]"
LOW, HIGH = Q.format("0.025"), Q.format("0.975")


def _pairs(s, d):
    return M.paired_outcomes(P.attempts(s, d), "direct", ["self_review", "repeated", "fusion"])


def _complete(s, d):
    """Coverage as if complete, so that the intervals themselves are compared."""
    return P.configs(s).select("config_id", F.lit(True).alias("complete"))


def _first_trials(s, d):
    """First trials of the cases that have a direct one, without some of fusion: direct is complete there, fusion isn't."""
    first = P.attempts(s, d).where("trial_index = 0 AND NOT (config_id = 'fusion' AND case_index % 7 = 0)")
    return first.join(first.where("config_id = 'direct'").select("case_index").distinct(), "case_index", "left_semi")


def _delta(s, d):
    return R.bootstrap_pass_delta(_pairs(s, d), P.attempts(s, d), RESAMPLES)


DELTA_SQL = f"""{WITH}, pc AS (SELECT case_index, config_id, count(*) AS paired, sum(target_passed::INT - base_passed::INT) AS net FROM pairs WHERE base_passed IS NOT NULL AND target_passed IS NOT NULL GROUP BY ALL),
r AS (SELECT sample, config_id, CAST(sum(net * times) AS BIGINT) / nullif(CAST(sum(paired * times) AS BIGINT), 0) AS v FROM ix JOIN sc USING (ordinal) JOIN pc USING (case_index) GROUP BY ALL),
b AS (SELECT config_id, {LOW} AS low, {HIGH} AS high FROM r GROUP BY config_id)"""

QUERIES = {
    "lcg_stream": (lambda s, d: R.stream(s, P.table(s, d, "part").count()), f"WITH RECURSIVE {_stream_sql('(SELECT count(*) FROM part)')} SELECT place, state FROM st"),
    "fnv_seeds": (
        lambda s, d: P.table(s, d, "part").select("p_partkey", rng.fnv1a(F.col("p_brand")).alias("seed")),
        "SELECT p_partkey, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS seed FROM part",
    ),
    "resample_index": (
        lambda s, d: R.resample_index(s, R.numbered_cases(P.attempts(s, d)).count(), RESAMPLES),
        f"{WITH} SELECT sample, ordinal, times FROM ix",
    ),
    "boot_pass_rate": (
        lambda s, d: R.bootstrap_pass_rate(P.attempts(s, d), _complete(s, d), RESAMPLES),
        f"""{WITH}, pc AS (SELECT case_index, config_id, count(*) AS n, count(*) FILTER (WHERE passed) AS p FROM attempts WHERE NOT smoke_only GROUP BY ALL),
r AS (SELECT sample, config_id, CAST(sum(p * times) AS BIGINT) / nullif(CAST(sum(n * times) AS BIGINT), 0) AS v FROM ix JOIN sc USING (ordinal) JOIN pc USING (case_index) GROUP BY ALL)
SELECT config_id, {LOW} AS low, {HIGH} AS high FROM r GROUP BY config_id""",
    ),
    "boot_pass_rate_gated": (
        lambda s, d: R.bootstrap_pass_rate(_first_trials(s, d), M.coverage(_first_trials(s, d), P.configs(s)), RESAMPLES),
        f"""WITH RECURSIVE {P.ATTEMPTS_SQL.replace("attempts AS (", "every AS (")}, attempts AS (SELECT * FROM every WHERE trial_index = 0 AND NOT (config_id = 'fusion' AND case_index % 7 = 0) AND case_index IN (SELECT case_index FROM every WHERE trial_index = 0 AND config_id = 'direct')), {INDEX_SQL},
pc AS (SELECT case_index, config_id, count(*) AS n, count(*) FILTER (WHERE passed) AS p FROM attempts WHERE NOT smoke_only GROUP BY ALL),
t AS (SELECT DISTINCT case_index, trial_index FROM attempts WHERE NOT smoke_only),
g AS (SELECT k.config_id, t.case_index, t.trial_index, count(a.event_id) AS n FROM t CROSS JOIN (VALUES ('direct'), ('self_review'), ('repeated'), ('fusion')) k(config_id)
  LEFT JOIN attempts a ON a.case_index = t.case_index AND a.trial_index = t.trial_index AND a.config_id = k.config_id AND NOT a.smoke_only GROUP BY ALL),
cov AS (SELECT config_id, bool_and(n = 1) AS whole FROM g GROUP BY config_id),
r AS (SELECT sample, config_id, CAST(sum(p * times) AS BIGINT) / nullif(CAST(sum(n * times) AS BIGINT), 0) AS v FROM ix JOIN sc USING (ordinal) JOIN pc USING (case_index) GROUP BY ALL),
b AS (SELECT config_id, {LOW} AS low, {HIGH} AS high FROM r GROUP BY config_id)
SELECT cov.config_id, CASE WHEN whole THEN low END AS low, CASE WHEN whole THEN high END AS high FROM cov LEFT JOIN b ON b.config_id = cov.config_id""",
    ),
    "boot_pass_delta": (_delta, f"{DELTA_SQL} SELECT * FROM b"),
    "boot_cost_per_pass": (
        lambda s, d: R.bootstrap_cost_per_pass(P.attempts(s, d), RESAMPLES),
        f"""{WITH}, pc AS (SELECT case_index, config_id, sum(cost_micro) AS c, count(*) FILTER (WHERE passed) AS p FROM attempts WHERE NOT smoke_only GROUP BY ALL),
r AS (SELECT sample, config_id, CAST(sum(c * times) AS BIGINT) / nullif(CAST(sum(p * times) AS BIGINT), 0) AS v FROM ix JOIN sc USING (ordinal) JOIN pc USING (case_index) GROUP BY ALL)
SELECT config_id, {LOW} AS low, {HIGH} AS high, {SAMPLES} - count(v) AS zero_pass_samples, ({SAMPLES} - count(v)) / {SAMPLES} AS undefined_rate FROM r GROUP BY config_id""",
    ),
    "directional_comparison": (
        lambda s, d: _delta(s, d).select("config_id", R.direction(F.col("low"), F.col("high")).alias("direction")),
        f"{DELTA_SQL} SELECT config_id, CASE WHEN low IS NULL THEN 'indeterminate' WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'no_clear_difference' END AS direction FROM b",
    ),
}
