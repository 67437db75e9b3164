"""Disclosure and fingerprint queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.text import round_half_up
from tallyframe.operators import disclosure as D
from tallyframe.operators import fingerprints as FP
from tallyframe.operators import metrics as M
from tallyframe.plans import proxy as P
from tallyframe.plans.metric_queries import CARD_SQL

_R4 = "floor({0} * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE"


def _card(s, d):
    return M.scorecard(P.attempts(s, d), P.configs(s))


def _case_json(s, d):
    c = P.cases(s, d)
    return c.withColumn("case_json", F.to_json(F.struct(F.col("tier").alias("z"), F.col("case_index").alias("id"), F.array(F.lit(1), F.col("case_index")).alias("a"))))


CASE_JSON_SQL = "'{\"a\":[1,' || case_index || '],\"id\":' || case_index || ',\"z\":\"' || tier || '\"}'"


def _consistency(s, d):
    """Published rates with a few falsified ones against those recomputed from the rows."""
    a = P.attempts(s, d)
    values = lambda rows: rows.where(~F.col("smoke_only")).groupBy("case_index", "config_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("passed")).alias("passes"))
    published = values(a).withColumn("passes", F.when(F.col("case_index") % 13 == 0, F.col("passes") + 1).otherwise(F.col("passes")))
    return D.consistency(published, values(a), ["case_index", "config_id"], ["n", "passes"])


KEY = b"0123456789abcdef0123456789abcdef"


def _hmac_sql(message: str) -> str:
    """HMAC-SHA-256 by its definition: two digests over the key, padded and masked, and the message parts, each ended by NUL but the last."""
    inner, outer = (bytes(k ^ mask for k in KEY.ljust(64, b"\0")).hex() for mask in (0x36, 0x5C))
    prefix = b"manifest-hmac-v1\0canonical-row\0".hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}{prefix}') || encode({message}))))"


QUERIES = {
    "category_breakdown": (
        lambda s, d: D.category_breakdown(P.attempts(s, d), P.cases(s, d)),
        f"""WITH {P.CASES_SQL}, f AS (SELECT category, min(case_index) AS fi, count(*) AS scored_cases FROM cases WHERE NOT smoke_only GROUP BY category),
l AS (SELECT category, scored_cases, 'category_' || lpad(CAST(row_number() OVER (ORDER BY fi) AS VARCHAR), 4, '0') AS label FROM f),
r AS (SELECT category, config_id, count(*) AS attempts, count(*) FILTER (WHERE passed) AS p FROM attempts WHERE NOT smoke_only GROUP BY ALL)
SELECT label, config_id, scored_cases, attempts, {_R4.format('p / attempts')} AS task_pass_rate, scored_cases >= 30 AS claim_floor_met FROM r JOIN l USING (category) WHERE (SELECT min(scored_cases) FROM f) >= 5""",
    ),
    "category_suppression": (
        lambda s, d: D.suppression(P.cases(s, d)),
        f"WITH {P.CASES_SQL}, f AS (SELECT count(*) AS n FROM cases WHERE NOT smoke_only GROUP BY category) SELECT CASE WHEN count(*) = 0 THEN 'no_scored_categories' WHEN min(n) < 5 THEN 'small_scored_case_count_per_category' END AS reason FROM f",
    ),
    "public_rounding": (
        lambda s, d: P.table(s, d, "customer").select("c_custkey", round_half_up(F.col("c_acctbal") / 7, 4).alias("r4"), (F.floor(F.col("c_acctbal") / 100 + 0.5) * 100).cast("long").alias("bucket")),
        f"SELECT c_custkey, {_R4.format('(c_acctbal / 7)')} AS r4, CAST(floor(c_acctbal / 100 + 0.5) * 100 AS BIGINT) AS bucket FROM customer",
    ),
    "suppressed_cost_latency": (
        lambda s, d: D.public_costs(_card(s, d), P.cases(s, d).where(~F.col("smoke_only")).count()).unionByName(D.public_costs(_card(s, d), 29)),
        f"""WITH {CARD_SQL} SELECT config_id, {_R4.format('(cost_per_pass_micro / 1e6::DOUBLE)')} AS cost_per_pass_usd, {_R4.format('(mean_cost_micro / 1e6::DOUBLE)')} AS mean_cost_usd, CAST(floor(p50_latency_ms / 100 + 0.5) * 100 AS BIGINT) AS p50_latency_ms, CAST(floor(p95_latency_ms / 100 + 0.5) * 100 AS BIGINT) AS p95_latency_ms, false AS suppressed FROM card
UNION ALL SELECT config_id, NULL, NULL, NULL, NULL, true FROM card""",
    ),
    "public_outcomes": (
        lambda s, d: D.public_outcomes(P.attempts(s, d)),
        f"WITH {P.ATTEMPTS_SQL} SELECT 'case_' || lpad(CAST(case_index + 1 AS VARCHAR), 4, '0') AS public_id, trial_index, config_id, status, passed, CASE WHEN degraded THEN true END AS degraded, failure_status FROM attempts",
    ),
    "outcome_violations": (
        lambda s, d: D.outcome_violations(D.public_outcomes(P.attempts(s, d)).withColumn("passed", F.col("passed") | (F.col("trial_index") % 5 == 0))).groupBy("rule").count(),
        f"WITH {P.ATTEMPTS_SQL} SELECT 'passed_not_completed' AS rule, count(*) AS count FROM attempts WHERE status <> 'completed' AND trial_index % 5 = 0",
    ),
    "row_metric_consistency": (
        _consistency,
        f"WITH {P.ATTEMPTS_SQL} SELECT DISTINCT case_index, config_id, case_index % 13 <> 0 AS consistent FROM attempts WHERE NOT smoke_only",
    ),
    "case_digests": (lambda s, d: FP.case_digests(_case_json(s, d)), f"WITH {P.CASES_SQL} SELECT case_index, sha256({CASE_JSON_SQL}) AS canonical_sha256 FROM cases"),
    "manifest_rows": (
        lambda s, d: FP.manifest_rows(_case_json(s, d), labels=True),
        f"WITH {P.CASES_SQL} SELECT case_index, smoke_only, tier, category, 'case_' || lpad(CAST(case_index + 1 AS VARCHAR), 4, '0') AS public_id, sha256({CASE_JSON_SQL}) AS row_digest FROM cases",
    ),
    "manifest_hmac_rows": (
        lambda s, d: FP.manifest_rows(_case_json(s, d), key=KEY),
        f"WITH {P.CASES_SQL} SELECT case_index, smoke_only, tier, 'case_' || lpad(CAST(case_index + 1 AS VARCHAR), 4, '0') AS public_id, {_hmac_sql(CASE_JSON_SQL)} AS row_digest FROM cases",
    ),
    "manifest_mismatches": (
        lambda s, d: FP.locate_mismatches(FP.manifest_rows(_case_json(s, d)), FP.manifest_rows(_case_json(s, d).where("case_index % 11 <> 0").withColumn("case_json", F.when(F.col("case_index") % 7 == 0, F.lit("{}")).otherwise(F.col("case_json"))))),
        f"WITH {P.CASES_SQL} SELECT 'case_' || lpad(CAST(case_index + 1 AS VARCHAR), 4, '0') AS public_id, CASE WHEN case_index % 11 = 0 THEN 'removed' ELSE 'changed' END AS difference FROM cases WHERE case_index % 11 = 0 OR case_index % 7 = 0",
    ),
}
