"""Queries over JSON documents: a document for each trial, built from the attempts, some of its outcomes spoilt by their event's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import artifact as A
from tallyframe.operators import shapes as S
from tallyframe.plans import proxy as P

#: The part of a report that its public rows make up.
ROWS = S.obj(configs=S.array(S.text(*A.CONFIGS), least=1), cases=S.array(A.CASE))


def trial_documents(s, d) -> DataFrame:
    """report_id (case/trial) and body. A trial has one attempt of each configuration at most, so a document is small."""
    c, how = F.col, F.col("event_id") % 9
    good = F.coalesce("passed", F.lit(False))
    grader = F.struct(
        good.alias("passed"), F.col("smoke_only").alias("smokeOnly"),
        F.struct((1 + F.when(how == 3, 1).otherwise(0)).alias("total"), good.cast("int").alias("passed"), (1 - good.cast("int")).alias("failed")).alias("checkCounts"),
        F.array(F.struct(F.lit(0).alias("checkIndex"), F.when(how == 4, "secret").otherwise("exact").alias("kind"), good.alias("passed"))).alias("checks"),
    )
    order = F.create_map(*[F.lit(x) for i, k in enumerate(P.CONFIGS) for x in (k, i)])
    outcome = F.struct(
        order[c("config_id")].alias("place"), F.when(how == 1, "other").otherwise(c("config_id")).alias("configId"), "status", F.when(how != 6, good).alias("passed"), F.when(c("degraded"), True).alias("degraded"),
        F.when(how == 2, "timeout").otherwise(c("failure_status")).alias("failureStatus"), F.when(how == 5, "x").alias("note"), grader.alias("grader"),
    )
    trials = P.attempts(s, d).groupBy("case_index", "trial_index", "smoke_only").agg(F.array_sort(F.collect_list(outcome)).alias("o"))
    outcomes = F.transform("o", lambda o: o.dropFields("place"))
    case = F.struct(F.format_string("case_%04d", c("case_index") % 10000).alias("publicId"), c("smoke_only").alias("smokeOnly"), F.array(F.struct(c("trial_index").alias("trialIndex"), F.lit(False).alias("fusionHarm"), outcomes.alias("outcomes"))).alias("trials"))
    body = F.to_json(F.struct(F.array(*map(F.lit, P.CONFIGS)).alias("configs"), F.array(case).alias("cases")))
    return trials.select(F.concat_ws("/", "case_index", "trial_index").alias("report_id"), body.alias("body"))


def _recount(s, d):
    return A.recount(A.parsed(trial_documents(s, d))).drop("cases")


_PLACED = f"""WITH {P.ATTEMPTS_SQL}, o AS (SELECT case_index || '/' || trial_index AS report_id, smoke_only, config_id, event_id % 9 AS how, status, passed, 'cases[0].trials[0].outcomes[' ||
  (row_number() OVER (PARTITION BY case_index, trial_index ORDER BY CASE config_id WHEN 'direct' THEN 0 WHEN 'self_review' THEN 1 WHEN 'repeated' THEN 2 ELSE 3 END) - 1) || ']' AS spot FROM attempts)"""

FINDINGS_SQL = f"""{_PLACED}
SELECT report_id, spot || '.configId' AS path, 'wrong_value' AS code FROM o WHERE how = 1
UNION ALL SELECT report_id, spot, 'broken_rule' FROM o WHERE how = 2 AND status = 'completed'
UNION ALL SELECT report_id, spot || '.grader', 'broken_rule' FROM o WHERE how = 3
UNION ALL SELECT report_id, spot || '.grader.checks[0].kind', 'wrong_value' FROM o WHERE how = 4
UNION ALL SELECT report_id, spot || '.note', 'unknown_key' FROM o WHERE how = 5
UNION ALL SELECT report_id, spot || '.passed', 'missing_key' FROM o WHERE how = 6
UNION ALL SELECT report_id, spot, 'broken_rule' FROM o WHERE how = 6 AND NOT coalesce(passed, false)"""

_OWN = ", ".join(
    f"count(*) FILTER (WHERE NOT smoke_only AND config_id = '{k}') AS n_{k}, count(*) FILTER (WHERE NOT smoke_only AND config_id = '{k}' AND passed) AS p_{k}, "
    f"(bool_and(NOT smoke_only) AND count(*) FILTER (WHERE NOT smoke_only AND config_id = '{k}') <> 1)::BIGINT AS x_{k}"
    for k in P.CONFIGS
)
RECOUNT_SQL = f"""{_PLACED}, r AS (SELECT report_id, smoke_only, CASE WHEN how <> 1 THEN config_id ELSE 'other' END AS config_id, passed AND how <> 6 AS passed FROM o),
g AS (SELECT report_id, bool_and(NOT smoke_only)::BIGINT AS live, {_OWN} FROM r GROUP BY report_id)
SELECT report_id, live AS scored_cases, live AS trials, {", ".join(f"n_{k}, p_{k}, x_{k}" for k in P.CONFIGS)},
  live * (n_direct > 0 AND n_fusion > 0)::BIGINT AS paired, live * (n_direct = 0 OR n_fusion = 0)::BIGINT AS unpaired, live * (n_direct > 0 AND p_fusion > 0 AND p_direct = 0)::BIGINT AS wins,
  live * (n_fusion > 0 AND p_direct > 0 AND p_fusion = 0)::BIGINT AS losses, live * (p_direct > 0 AND p_fusion = 0)::BIGINT AS wrong_harms FROM g"""

QUERIES = {
    "document_shape_findings": (lambda s, d: A.shape_findings(trial_documents(s, d), shape=ROWS), FINDINGS_SQL),
    "document_recount": (_recount, RECOUNT_SQL),
}
