"""Evaluation queries: whole documents as recorded answers of cases of eight, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import evaluation as E
from tallyframe.operators import grading as G
from tallyframe.operators import metrics as M
from tallyframe.plans import proxy as P

TRIALS = 2
PER_CASE = TRIALS * len(P.CONFIGS)


def _cases(s, d):
    """One for each group of eight documents; its grader is a function of its number."""
    rows = P.with_case_columns(P.table(s, d, "documents").select(F.floor(F.col("doc_id") / PER_CASE).alias("case_index")).distinct())
    i = F.col("case_index")
    return rows.withColumns(
        {
            "must_include": F.when(i % 5 < 3, F.array(F.lit("The"), F.lit("a"))),
            "contains_any": F.when(i % 5 == 1, F.array(F.lit("and"), F.lit("und"))),
            "must_not_include": F.when(i % 5 == 2, F.array(F.lit("http"))),
            "min_length": F.when(i % 5 == 3, F.lit(200)),
            "max_length": F.when(i % 5 == 3, F.lit(4000)),
        }
    )


def _responses(s, d):
    """A document is the answer of its place among its eight; one of thirteen runs failed."""
    doc = P.table(s, d, "documents")
    i = F.col("doc_id")
    slot = i % PER_CASE
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return doc.select(
        F.floor(i / PER_CASE).alias("case_index"), F.floor(slot / len(P.CONFIGS)).alias("trial_index"), pick(P.CONFIGS, slot % len(P.CONFIGS)).alias("config_id"), i.alias("event_id"),
        F.when(i % 13 != 5, F.col("text")).alias("answer"), F.when(i % 13 == 5, pick(P.FAILURES, i % 4)).alias("failure_status"), (i % 10 == 9).alias("degraded"), size.alias("cost_micro"), (size % 997).alias("latency_ms"),
    )


def evaluated(s, d):
    return E.evaluate(_cases(s, d), _responses(s, d), P.configs(s), TRIALS)


#: The same attempts: checks as a list of name=result.
EVALUATED_SQL = """r AS (SELECT doc_id // 8 AS case_index, doc_id % 8 // 4 AS trial_index, doc_id % 4 AS config_order, doc_id AS event_id, coalesce(text, '') AS a, CAST(coalesce(length(text), 0) AS BIGINT) AS size,
    doc_id % 13 = 5 AS failed, doc_id // 8 % 10 = 0 AS smoke_only, doc_id // 8 % 5 AS g FROM documents),
c AS (SELECT *, CASE WHEN failed THEN ['run_completed=false'] WHEN smoke_only THEN ['smoke_only=true'] WHEN length(a) > 20000 THEN ['answer_size=false'] WHEN g = 4 THEN ['grader_configured=false']
    ELSE list_concat(list_concat(CASE WHEN g < 3 THEN ['must_include=' || contains(lower(a), 'the'), 'must_include=' || contains(lower(a), 'a')] ELSE [] END,
      CASE WHEN g = 1 THEN ['contains_any=' || (contains(lower(a), 'and') OR contains(lower(a), 'und'))] ELSE [] END), list_concat(CASE WHEN g = 2 THEN ['must_not_include=' || (NOT contains(lower(a), 'http'))] ELSE [] END,
      CASE WHEN g = 3 THEN ['min_length=' || (length(a) >= 200), 'max_length=' || (length(a) <= 4000)] ELSE [] END)) END AS checks FROM r),
attempts AS (SELECT case_index, trial_index, ['direct', 'self_review', 'repeated', 'fusion'][config_order + 1] AS config_id, event_id, smoke_only, 'cat_' || (case_index % 5) AS category,
    CAST(((config_order - (case_index * 2 + trial_index)) % 4 + 4) % 4 AS INT) AS position, trial_index * 4 + config_order AS ordinal, CASE WHEN failed THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN failed THEN ['timeout', 'provider_error', 'invalid_output', 'budget_exhausted'][event_id % 4 + 1] END AS failure_status, NOT failed AND event_id % 10 = 9 AS degraded,
    len(list_filter(checks, lambda x: x LIKE '%=false')) = 0 AS passed, array_to_string(checks, ',') AS checks, size AS cost_micro, size % 997 AS latency_ms FROM c),
configs AS (SELECT * FROM (VALUES ('direct', 0), ('self_review', 1), ('repeated', 2), ('fusion', 3)) t(config_id, config_order))"""


def _shown(rows):
    return rows.withColumn("checks", F.concat_ws(",", F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["passed"].cast("string")))))


def _requests(s, d):
    cases = P.table(s, d, "documents").select(F.col("doc_id").alias("case_index"), F.col("doc_id").cast("string").alias("case_id"), (F.col("doc_id") % 10 == 0).alias("smoke_only"), F.coalesce("text", F.lit("")).alias("task"), F.when(F.col("doc_id") % 3 == 0, F.array("lang")).alias("constraints"))
    return E.requests(cases, P.configs(s), 1).select("case_index", "config_id", "position", "seed_material")


def _gaps(s, d):
    """Cells without a response and responses outside the schedule, after responses of a few cases have moved."""
    moved = _responses(s, d).withColumn("trial_index", F.when(F.col("event_id") % 97 == 3, F.col("trial_index") + 5).otherwise(F.col("trial_index")))
    cells = ["case_index", "trial_index", "config_id"]
    gone = E.unanswered(_cases(s, d), moved, P.configs(s), TRIALS).select(*[F.col(c).cast("string") for c in cells], F.lit("unanswered").alias("gap"))
    return gone.unionByName(E.unexpected(_cases(s, d), moved, P.configs(s), TRIALS).select(*[F.col(c).cast("string") for c in cells], F.lit("unexpected").alias("gap")))


QUERIES = {
    "evaluate_responses": (
        lambda s, d: _shown(evaluated(s, d)).drop("category", "difficulty"),
        f"WITH {EVALUATED_SQL} SELECT case_index, trial_index, config_id, event_id, position, ordinal, smoke_only, status, failure_status, degraded, passed, checks, cost_micro, latency_ms FROM attempts",
    ),
    "evaluation_scorecard": (
        lambda s, d: M.scorecard(evaluated(s, d), P.configs(s)).select("config_id", "scored_attempt_n", "task_pass_rate", "cost_per_pass_micro", "total_cost_micro", "p50_latency_ms", "p95_latency_ms", "timeout_rate", "partial_failure_rate", "smoke_completion_rate"),
        f"""WITH {EVALUATED_SQL} SELECT config_id, count(*) FILTER (WHERE NOT smoke_only) AS scored_attempt_n, count(*) FILTER (WHERE NOT smoke_only AND passed) / nullif(count(*) FILTER (WHERE NOT smoke_only), 0) AS task_pass_rate,
CAST(sum(cost_micro) FILTER (WHERE NOT smoke_only) AS BIGINT) / nullif(count(*) FILTER (WHERE NOT smoke_only AND passed), 0) AS cost_per_pass_micro, CAST(sum(cost_micro) AS BIGINT) AS total_cost_micro,
CAST(quantile_disc(latency_ms, 0.5) FILTER (WHERE status = 'completed') AS BIGINT) AS p50_latency_ms, CAST(quantile_disc(latency_ms, 0.95) FILTER (WHERE status = 'completed') AS BIGINT) AS p95_latency_ms,
count(*) FILTER (WHERE failure_status = 'timeout') / count(*) AS timeout_rate, count(*) FILTER (WHERE degraded) / count(*) AS partial_failure_rate,
count(*) FILTER (WHERE smoke_only AND status = 'completed') / nullif(count(*) FILTER (WHERE smoke_only), 0) AS smoke_completion_rate FROM attempts GROUP BY config_id""",
    ),
    "evaluation_case_results": (
        lambda s, d: E.case_results(evaluated(s, d)),
        f"""WITH {EVALUATED_SQL}, n AS (SELECT case_index, smoke_only, count(*) AS attempts, count(*) FILTER (WHERE passed) AS passes FROM attempts GROUP BY ALL),
h AS (SELECT DISTINCT x.case_index FROM attempts x JOIN attempts y ON x.case_index = y.case_index AND x.trial_index = y.trial_index WHERE x.config_id = 'direct' AND y.config_id = 'fusion' AND x.passed AND NOT y.passed AND NOT x.smoke_only)
SELECT n.*, h.case_index IS NOT NULL AS harm FROM n LEFT JOIN h ON n.case_index = h.case_index""",
    ),
    "evaluation_gaps": (
        _gaps,
        f"""WITH {EVALUATED_SQL}, m AS (SELECT case_index, CASE WHEN event_id % 97 = 3 THEN trial_index + 5 ELSE trial_index END AS trial_index, config_id FROM attempts),
g AS (SELECT case_index, t AS trial_index, config_id FROM (SELECT DISTINCT case_index FROM attempts) x, range(0, 2) r(t), (SELECT config_id FROM configs) y)
SELECT CAST(case_index AS VARCHAR) AS case_index, CAST(trial_index AS VARCHAR) AS trial_index, config_id, 'unanswered' AS gap FROM g ANTI JOIN m USING (case_index, trial_index, config_id)
UNION ALL SELECT CAST(case_index AS VARCHAR), CAST(trial_index AS VARCHAR), config_id, 'unexpected' FROM m WHERE trial_index > 1""",
    ),
    "request_seeds": (
        _requests,
        """WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS th, CASE WHEN doc_id % 3 = 0 THEN '["' || lang || '"]' ELSE '[]' END AS cs, (doc_id % 3 = 0)::INT AS n FROM documents),
j AS (SELECT doc_id, sha256('{"constraintsCount":' || n || ',"constraintsHash":"' || sha256(cs) || '","id":"' || doc_id || '","seedVersion":"model-visible-eval-case-v1","taskHash":"' || th || '"}') AS seed FROM t)
SELECT doc_id AS case_index, config_id, CAST(((o - doc_id) % 4 + 4) % 4 AS INT) AS position, seed || ':trial-0:' || config_id AS seed_material FROM j, (VALUES ('direct', 0), ('self_review', 1), ('repeated', 2), ('fusion', 3)) t(config_id, o)""",
    ),
    "grade_all_checks": (
        lambda s, d: G.public_checks(E.grade_answers(_cases(s, d), _responses(s, d).select("case_index", "event_id", F.coalesce("answer", F.lit("")).alias("answer")))).groupBy("case_index").agg(F.count(F.lit(1)).alias("answers"), F.sum("total").alias("total"), F.sum("passed_checks").alias("passed_checks"), F.sum("failed_checks").alias("failed_checks")),
        f"""WITH {EVALUATED_SQL.replace("doc_id % 13 = 5 AS failed", "false AS failed").replace("coalesce(text, '') AS a", "CASE WHEN doc_id % 13 = 5 THEN '' ELSE coalesce(text, '') END AS a")}, k AS (SELECT case_index, string_split(checks, ',') AS x FROM attempts)
SELECT case_index, count(*) AS answers, CAST(sum(len(x)) AS BIGINT) AS total, CAST(sum(len(list_filter(x, lambda y: y LIKE '%=true'))) AS BIGINT) AS passed_checks, CAST(sum(len(list_filter(x, lambda y: y LIKE '%=false'))) AS BIGINT) AS failed_checks FROM k GROUP BY case_index""",
    ),
}
