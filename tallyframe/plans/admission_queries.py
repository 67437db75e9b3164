"""Admission of the attempts of each case under one budget, and blinding of each document's candidates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import admission, blinding
from tallyframe.plans import proxy as P

MAX_COST, MAX_TOKENS = 60_000, 4_000


def _admitted(s, d):
    a = P.attempts(s, d)
    calls = a.select(F.col("case_index").alias("request"), F.col("event_id").alias("call"), (F.col("cost_micro") + F.col("event_id") % 7 * 100).alias("estimate"), F.col("cost_micro").alias("cost"), (F.col("event_id") % 11 * 50).alias("max_tokens"), (F.col("event_id") % 11 * 40).alias("tokens"))
    budgets = a.select(F.col("case_index").alias("request")).distinct().where("request % 19 <> 0").select("request", (F.lit(MAX_COST) - F.col("request") % 5 * 1000).alias("max_cost"), F.lit(MAX_TOKENS).alias("max_tokens"))
    return admission.admit(calls, budgets)


#: The fold as a recursion, one call of every request at a time.
ADMIT_SQL = f"""WITH RECURSIVE {P.ATTEMPTS_SQL},
c AS (SELECT case_index AS request, event_id AS call, CAST(row_number() OVER (PARTITION BY case_index ORDER BY event_id) AS BIGINT) AS i, cost_micro + event_id % 7 * 100 AS estimate, cost_micro AS cost, event_id % 11 * 50 AS ceiling, event_id % 11 * 40 AS tokens,
  case_index % 19 <> 0 AS has, {MAX_COST} - case_index % 5 * 1000 AS most FROM attempts),
f AS (SELECT request, 0::BIGINT AS i, NULL::BIGINT AS call, '' AS verdict, 0::BIGINT AS spent_cost, 0::BIGINT AS spent_tokens FROM (SELECT DISTINCT request FROM c)
  UNION ALL SELECT c.request, c.i, c.call, v.verdict, CAST(f.spent_cost + CASE WHEN v.verdict = 'admitted' THEN c.cost ELSE 0 END AS BIGINT), CAST(f.spent_tokens + CASE WHEN v.verdict = 'admitted' THEN c.tokens ELSE 0 END AS BIGINT)
  FROM f JOIN c ON c.request = f.request AND c.i = f.i + 1, LATERAL (SELECT CASE WHEN NOT c.has THEN 'no_budget' WHEN f.spent_cost > c.most OR c.estimate > c.most - f.spent_cost THEN 'refused_cost'
    WHEN f.spent_tokens > {MAX_TOKENS} OR c.ceiling > {MAX_TOKENS} - f.spent_tokens THEN 'refused_tokens' ELSE 'admitted' END AS verdict) v)
SELECT request, call, verdict, spent_cost, spent_tokens FROM f WHERE i > 0"""


def _blinded(s, d):
    """1 to 4 candidates a document, 1 to 3 claims each; the ledger names the first claims, those of the last candidate, and one unknown."""
    k = F.col("doc_id")
    claims = lambda c: F.transform(F.sequence(F.lit(0), ((k + c) % 3).cast("int")), lambda j: F.struct(F.concat(F.lit("c"), c, F.lit("-"), j).alias("claim_id"), F.lit("t").alias("text")))
    candidates = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda c: F.struct(F.concat(F.lit("id"), c).alias("candidate_id"), F.concat(F.lit("m"), c).alias("model_id"), claims(c).alias("claims")))
    rows = P.table(s, d, "documents").select(k.alias("request"), F.concat(F.lit("task "), k).alias("task"), candidates.alias("candidates"))
    ids = lambda x: F.transform(x["claims"], lambda y: y["claim_id"])
    rows = rows.withColumns({"consensus": F.transform("candidates", lambda x: x["claims"][0]["claim_id"]), "adopted": ids(F.element_at("candidates", -1)), "rejected": F.array(F.lit("nobody"))})
    out = blinding.blind(rows)
    back = blinding.unblind(out).select(F.col("request").alias("r"), F.concat_ws(",", "consensus").alias("c"), F.concat_ws(",", "adopted").alias("a"))
    named = F.concat_ws(",", F.transform("aliases", lambda x: F.concat(x["alias"], F.lit("="), x["model_id"])))
    told = out.select("request", named.alias("aliases"), *[F.concat_ws(",", c).alias(c) for c in ("consensus", "adopted", "rejected")])
    return told.join(back, F.col("request") == F.col("r")).select("request", "aliases", "consensus", "adopted", "rejected", F.concat_ws("|", "c", "a").alias("restored"))


BLIND_SQL = """WITH d AS (SELECT doc_id AS k, 'task ' || doc_id AS task, CAST(doc_id % 4 AS INT) + 1 AS n FROM documents),
s AS (SELECT k, n, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(task, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 2 = 1 AS odd FROM d),
c AS (SELECT k, n, odd, c, CASE WHEN odd THEN n - c ELSE c + 1 END AS place, CAST((k + c) % 3 AS INT) + 1 AS m FROM s, range(0, 4) r(c) WHERE c < n)
SELECT k AS request, string_agg('candidate_' || place || '=m' || c, ',' ORDER BY place) AS aliases, string_agg('candidate_' || place || '_claim_1', ',' ORDER BY c) AS consensus,
  any_value(array_to_string(list_transform(range(1, m + 1), lambda j: 'candidate_' || place || '_claim_' || j), ',')) FILTER (WHERE c = n - 1) AS adopted, 'nobody' AS rejected,
  string_agg('c' || c || '-0', ',' ORDER BY c) || '|' || any_value(array_to_string(list_transform(range(0, m), lambda j: 'c' || c || '-' || j), ',')) FILTER (WHERE c = n - 1) AS restored FROM c GROUP BY k"""

QUERIES = {"budget_admission": (_admitted, ADMIT_SQL), "candidate_blinding": (_blinded, BLIND_SQL)}
