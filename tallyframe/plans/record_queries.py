"""Validation and record queries and their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyframe.operators import records as R
from tallyframe.operators import validation as V
from tallyframe.plans import proxy as P


def _graders(s, d):
    k = F.col("p_partkey")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    bad_json, good_json = json.dumps({"requiredPaths": ["a..b"], "equals": {"x": [1]}}), json.dumps({"requireValid": True, "requiredPaths": ["a.b[0]"]})
    bad_cites, good_cites = json.dumps({"allowedSourceIds": ["S1"], "requiredSourceIds": ["S2"], "minCitedSources": 2}), json.dumps({"allowedSourceIds": ["S1"]})
    rows = P.table(s, d, "part").select(
        k.alias("case_index"), F.lit(False).alias("smoke_only"), F.when(k % 2 == 0, "x").alias("exact"), F.when(k % 3 == 0, F.lit(9)).otherwise(F.lit(2)).alias("min_length"), F.lit(5).alias("max_length"),
        F.when(k % 5 == 0, arr("a(b)")).otherwise(arr("a[bc]")).alias("regex"), F.when(k % 7 == 0, "Z").otherwise(" y").alias("choice_expected"), F.when(k % 11 == 0, arr("y", "Y ")).otherwise(arr("y", "n")).alias("choice_allowed"),
        F.when(k % 13 == 0, F.lit(-1.0)).alias("number_tolerance"), F.when(k % 17 == 0, "(a|b)").otherwise("^t=([0-9.]+)$").alias("number_regex"),
        F.when(k % 19 == 0, bad_json).otherwise(good_json).alias("json_spec"), F.when(k % 23 == 0, bad_cites).otherwise(good_cites).alias("citation_spec"),
    )
    return V.grader_violations(rows)


GRADERS_SQL = """SELECT CAST(p_partkey AS BIGINT) AS case_index, rule FROM part, LATERAL (VALUES ('lengths', p_partkey % 3 = 0), ('regex', p_partkey % 5 = 0), ('choice_expected', p_partkey % 7 = 0), ('choice_allowed', p_partkey % 11 = 0), ('number_tolerance', p_partkey % 13 = 0), ('number_regex', p_partkey % 17 = 0),
('json_path', p_partkey % 19 = 0), ('json_equals_value', p_partkey % 19 = 0), ('citation_required', p_partkey % 23 = 0), ('citation_minimum', p_partkey % 23 = 0)) v(rule, broken) WHERE broken"""


def _calls(s, d):
    lines = P.table(s, d, "lineitem")
    usage = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.floor("l_extendedprice").cast("long").alias("cost"), F.floor("l_quantity").cast("long").alias("tokens"), F.col("l_partkey").alias("p"))))
    attempts = lines.groupBy(F.col("l_orderkey").alias("attempt")).agg(usage.alias("usage"))
    calls = F.transform("usage", lambda u, i: F.struct(F.format_string("stage_%d", u["n"]).alias("stage"), F.when(u["p"] % 9 != 0, i).alias("usage_index")))
    return attempts.withColumn("calls", calls)


USAGE_SQL = """WITH z AS (SELECT l_orderkey AS attempt, l_linenumber AS n, CAST(floor(l_extendedprice) AS BIGINT) AS cost, CAST(floor(l_quantity) AS BIGINT) AS tokens, l_partkey AS p FROM lineitem),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY attempt ORDER BY n, cost, tokens, p) - 1 AS INT) AS call_no FROM z)"""


def _seeds(s, d):
    k = F.col("c_custkey")
    names = F.when(k % 3 == 0, F.array(F.lit("seed"), F.lit("temperature"))).when(k % 3 == 1, F.array(F.lit("top_p")))
    return P.table(s, d, "customer").select(
        "c_custkey", R.seed_policy(k % 4 != 0, k % 5 == 0, k % 2 == 0, names).alias("policy"), R.applied_parameter(F.lit(0.7), "temperature", names).alias("temperature"),
        R.derived_seed(F.lit(7), F.col("c_mktsegment"), F.lit("direct"), k % 3).alias("seed"),
        R.pinning_status(F.when(k % 7 != 0, k % 2 == 0), F.when(k % 6 == 0, F.array(F.lit("a/b"))).when(k % 6 == 1, F.array(F.lit("a"))).when(k % 6 == 3, F.array(F.lit("a/b"), F.lit("c")))).alias("pinning"),
    )


SEEDS_SQL = """WITH c AS (SELECT c_custkey, c_custkey % 4 <> 0 AS send, c_custkey % 5 = 0 AS req, c_custkey % 2 = 0 AS rooted, c_custkey % 3 AS m, '7:' || c_mktsegment || ':direct:' || (c_custkey % 3) AS material FROM customer)
SELECT c_custkey, CASE WHEN NOT send AND (req OR rooted) THEN 'not_sent_disabled' WHEN NOT (send AND (rooted OR req)) THEN 'not_requested' WHEN m = 2 THEN 'not_sent_support_unknown' WHEN m = 0 THEN 'sent' ELSE 'not_sent_unsupported' END AS policy,
CASE WHEN m <> 1 THEN 0.7::DOUBLE END AS temperature, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(material, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS seed,
CASE WHEN c_custkey % 7 = 0 OR c_custkey % 2 = 0 THEN 'fallbacks_allowed' WHEN c_custkey % 6 = 1 THEN 'base_provider_slug_only' WHEN c_custkey % 6 = 3 THEN 'multiple_provider_endpoints_allowed' ELSE 'not_configured' END AS pinning FROM c"""

QUERIES = {
    "grader_violations": (_graders, GRADERS_SQL),
    "usage_of_calls": (lambda s, d: R.usage_of_calls(_calls(s, d)), f"{USAGE_SQL} SELECT attempt, call_no, 'stage_' || n AS stage, CASE WHEN p % 9 <> 0 THEN cost END AS cost, CASE WHEN p % 9 <> 0 THEN tokens END AS tokens FROM y"),
    "result_totals": (lambda s, d: _calls(s, d).select("attempt", R.result_total(F.col("usage")).alias("total")), f"{USAGE_SQL} SELECT attempt, CAST(sum(cost) AS BIGINT) AS total FROM y GROUP BY attempt"),
    "sampling_resolution": (_seeds, SEEDS_SQL),
    "trace_rows": (
        lambda s, d: R.trace_rows(P.table(s, d, "documents").select(F.col("doc_id").alias("case_index"), F.coalesce("text", F.lit("")).alias("answer")), "answer", limit=1000).drop("answer"),
        "SELECT doc_id AS case_index, sha256(coalesce(text, '')) AS answer_sha256, CAST(length(coalesce(text, '')) AS INT) AS answer_chars, length(coalesce(text, '')) > 1000 AS cut FROM documents",
    ),
    "confirmed_findings": (
        lambda s, d: R.confirmed_findings(P.table(s, d, "lineitem").select(F.col("l_partkey").alias("finding"), F.when(F.col("l_linestatus") == "O", "confirmed").otherwise("rejected").alias("verdict"), F.col("l_returnflag").alias("severity"), F.when(F.col("l_linenumber") == 1, "high").alias("corrected_severity"), F.concat(F.lit("role"), F.col("l_linenumber").cast("string")).alias("role"))).withColumn("roles", F.concat_ws(",", "roles")),
        "SELECT l_partkey AS finding, CASE WHEN l_linenumber = 1 THEN 'high' ELSE l_returnflag END AS severity, string_agg(DISTINCT 'role' || l_linenumber, ',' ORDER BY 'role' || l_linenumber) AS roles FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL",
    ),
}
