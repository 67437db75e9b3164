"""Planning queries (integer prices in billionths) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import planning as L
from tallyframe.plans import proxy as P

PRICES = [("direct", 50, 200), ("self_review", 50, 200), ("repeated", 50, 200), ("aggregator", 400, 1600), ("candidate_a", 60, 240), ("candidate_b", 80, 320)]
_PRICE_ROWS = ", ".join(map(str, PRICES))
_CALL_ROWS = ", ".join(f"('{m}', {i}, '{s}', '{r}', {w}::DOUBLE, {str(k).lower()})" for m, i, s, r, w, k in L.CALLS)


def _budgets(spark, d):
    k = F.col("doc_id")
    return P.table(spark, d, "documents").select(
        k.alias("request"), (k % 4000 + 1).alias("max_tokens"), (k % 3).cast("int").alias("max_candidates"), (k % 2).cast("int").alias("max_repairs"),
        F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long").alias("prompt_tokens"), (k % 900 * 1000).alias("max_cost"),
    )


def _prices(spark):
    return spark.createDataFrame([p for p in PRICES], "role string, prompt_price long, completion_price long")


def _calls(s, d):
    return L.planned_calls(_budgets(s, d), L.call_shapes(s))


CALLS_SQL = f"""b AS (SELECT doc_id AS request, doc_id % 4000 + 1 AS max_tokens, doc_id % 3 AS mc, doc_id % 2 AS mr, CAST(greatest(1, ceil(length(coalesce(text, '')) / 4)) AS BIGINT) AS prompt_tokens, doc_id % 900 * 1000 AS max_cost FROM documents),
sh AS (SELECT * FROM (VALUES {_CALL_ROWS}) t(mode, call_no, stage, role, share, prompt_known)), pr AS (SELECT * FROM (VALUES {_PRICE_ROWS}) t(role, prompt_price, completion_price)),
z AS (SELECT b.*, sh.*, count(*) OVER (PARTITION BY request, mode) AS n, greatest(1, CAST(floor(max_tokens * share) AS BIGINT)) AS fl FROM b, sh),
y AS (SELECT *, sum(CASE WHEN call_no < n - 1 THEN fl ELSE 0 END) OVER (PARTITION BY request, mode) AS used FROM z WHERE max_tokens >= n AND NOT (mode = 'self_review' AND mr < 1) AND NOT (mode IN ('repeated', 'fusion') AND mc < 2)),
calls AS (SELECT request, mode, call_no, stage, role, prompt_known, CAST(CASE WHEN call_no = n - 1 THEN max_tokens - used ELSE fl END AS BIGINT) AS max_output_tokens, prompt_tokens, max_cost FROM y)"""


def _auto(s, d):
    return L.auto_mode(L.mode_estimates(_calls(s, d), _prices(s), _budgets(s, d)), _budgets(s, d))


AUTO_SQL = f"""WITH {CALLS_SQL}, e AS (SELECT request, mode, CAST(sum(max_output_tokens * completion_price + CASE WHEN prompt_known THEN prompt_tokens * prompt_price ELSE 0 END) AS BIGINT) AS cost, any_value(max_cost) AS mx FROM calls JOIN pr USING (role) GROUP BY ALL),
f AS (SELECT request, arg_min(mode, list_position(['fusion', 'repeated', 'self_review', 'direct'], mode)) AS mode, arg_min(cost, list_position(['fusion', 'repeated', 'self_review', 'direct'], mode)) AS cost FROM e WHERE cost <= mx GROUP BY request)
SELECT b.request, coalesce(f.mode, 'direct') AS mode, CASE WHEN f.mode IS NULL THEN 'fell_back_to_direct_over_budget' ELSE 'selected_richest_within_budget' END AS reason, coalesce(f.cost, 0) AS estimate FROM b LEFT JOIN f ON b.request = f.request"""


def _preflight(s, d):
    one = s.createDataFrame([(0, 4000, 2, 1, 500, 10**9)], "request long, max_tokens long, max_candidates int, max_repairs int, prompt_tokens long, max_cost long")
    n = P.table(s, d, "benchmark").count()
    return L.preflight(L.planned_calls(one, L.call_shapes(s)), _prices(s), n * 3)


PREFLIGHT_SQL = f"""WITH pr AS (SELECT * FROM (VALUES {_PRICE_ROWS}) t(role, pp, cp)), k AS (SELECT count(*) * 3 AS n FROM benchmark),
c AS (SELECT * FROM (VALUES ('direct', 'direct', 'direct', 4000), ('self_review', 'self_review_draft', 'direct', 2400), ('self_review', 'self_review_final', 'self_review', 1600), ('repeated', 'repeated_sample', 'repeated', 1520), ('repeated', 'repeated_sample', 'repeated', 1520), ('repeated', 'aggregator', 'aggregator', 960),
('fusion', 'candidate', 'candidate_a', 1520), ('fusion', 'candidate', 'candidate_b', 1520), ('fusion', 'aggregator', 'aggregator', 960)) t(mode, stage, role, cap))
SELECT coalesce(mode, 'all') AS mode, coalesce(stage, 'all') AS stage, count(*) * any_value(n) AS attempts, CAST(sum(cap) * any_value(n) AS BIGINT) AS max_tokens, CAST(sum(cap * cp) * any_value(n) AS BIGINT) AS completion_cost FROM c JOIN pr USING (role), k GROUP BY ROLLUP (mode, stage)"""


def _usage(s, d):
    k = F.col("l_orderkey")
    u = P.table(s, d, "lineitem").select(
        (k * 10 + F.col("l_linenumber")).alias("call"), F.lit("direct").alias("planned_model"), F.when(k % 31 == 0, "other").otherwise("direct").alias("model"), F.when(k % 29 == 0, "error").otherwise("ok").alias("status"),
        (k % 23).alias("input_tokens"), (F.col("l_linenumber") * 300).cast("long").alias("output_tokens"), F.lit(1800).alias("max_output_tokens"), F.when(k % 37 == 0, None).otherwise(F.floor(F.col("l_quantity")) * 10000).cast("long").alias("cost"), (k % 41 - 1).alias("latency_ms"),
    )
    return L.usage_violations(u, _prices(s).withColumnRenamed("role", "model"))


USAGE_SQL = """WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS call, l_orderkey AS k, l_orderkey % 23 AS i, l_linenumber * 300 AS o, CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE CAST(floor(l_quantity) * 10000 AS BIGINT) END AS c FROM lineitem)
SELECT call, rule FROM u, LATERAL (VALUES ('other_model', k % 31 = 0), ('status', k % 29 = 0), ('input_tokens', i <= 0), ('output_tokens', o > 1800), ('cost_below_price', c IS NULL OR c < i * 50 + o * 200), ('latency', k % 41 = 0)) v(rule, bad) WHERE bad"""


def _ledgers(s, d):
    k = F.col("doc_id")
    ids = F.array(*[F.lit(x) for x in ("a1", "a2", "b1", "b2")])
    pick = lambda m, *xs: F.when(k % m == 0, F.array(*[F.lit(x) for x in xs]))
    return P.table(s, d, "documents").select(
        k.alias("ledger"), ids.alias("claim_ids"), F.create_map(*[F.lit(x) for x in ("a1", "A", "a2", "A", "b1", "B", "b2", "B")]).alias("candidate_of"),
        pick(5, "a1", "a2").otherwise(F.array(F.lit("a1"), F.lit("b1"))).alias("consensus"), pick(7, "a2", "a2").otherwise(F.array(F.lit("a2"))).alias("adopted"),
        pick(3, "b2").otherwise(F.array(F.lit("a2"))).alias("unique_adopted"), pick(11, "zz").otherwise(F.array().cast("array<string>")).alias("rejected"),
    )


LEDGER_SQL = """SELECT doc_id AS ledger, rule FROM documents, LATERAL (VALUES ('duplicate_claim', doc_id % 7 = 0), ('unknown_claim', doc_id % 11 = 0), ('unique_not_adopted', doc_id % 3 = 0), ('unique_in_consensus', doc_id % 5 = 0 AND doc_id % 3 <> 0), ('consensus_of_one', doc_id % 5 = 0)) v(rule, bad) WHERE bad"""


def _gaps(s, d):
    nation, supplier = P.table(s, d, "nation"), P.table(s, d, "supplier")
    prices = supplier.select((F.col("s_nationkey") % 20 + F.when(F.col("s_suppkey") % 9 == 0, 15).otherwise(0)).cast("long").alias("model"), (F.col("s_suppkey") % 2).alias("prompt_price"), F.lit(1).alias("completion_price"))
    return L.price_gaps(nation.select(F.col("n_nationkey").cast("long").alias("model")), prices)


GAPS_SQL = """WITH p AS (SELECT CAST(s_nationkey % 20 + CASE WHEN s_suppkey % 9 = 0 THEN 15 ELSE 0 END AS BIGINT) AS model, s_suppkey % 2 AS a FROM supplier), r AS (SELECT CAST(n_nationkey AS BIGINT) AS model FROM nation)
SELECT model, 'missing' AS problem FROM r WHERE model NOT IN (SELECT model FROM p) UNION ALL SELECT DISTINCT model, 'unexpected' FROM p WHERE model NOT IN (SELECT model FROM r) UNION ALL SELECT model, 'conflicting' FROM p GROUP BY model HAVING count(DISTINCT a) > 1"""

QUERIES = {
    "planned_calls": (_calls, f"WITH {CALLS_SQL} SELECT request, mode, call_no, stage, role, prompt_known, max_output_tokens FROM calls"),
    "auto_mode": (_auto, AUTO_SQL),
    "preflight_rollup": (_preflight, PREFLIGHT_SQL),
    "usage_violations": (_usage, USAGE_SQL),
    "claim_ledger_violations": (lambda s, d: L.ledger_violations(_ledgers(s, d)), LEDGER_SQL),
    "price_gaps": (_gaps, GAPS_SQL),
    "token_split": (
        lambda s, d: L.split_columns(P.table(s, d, "part").select("p_partkey", (F.col("p_size") * 7).cast("long").alias("total")), "total", [0.38, 0.38, 0.24]),
        "WITH t AS (SELECT p_partkey, CAST(p_size * 7 AS BIGINT) AS total FROM part), f AS (SELECT *, greatest(1, CAST(floor(total * 0.38::DOUBLE) AS BIGINT)) AS a FROM t) SELECT p_partkey, total, CASE WHEN total >= 3 THEN a END AS part_0, CASE WHEN total >= 3 THEN a END AS part_1, CASE WHEN total >= 3 THEN total - 2 * a END AS part_2 FROM f",
    ),
    "token_estimates": (
        lambda s, d: P.table(s, d, "documents").select("doc_id", F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long").alias("tokens")),
        "SELECT doc_id, CAST(greatest(1, ceil(length(coalesce(text, '')) / 4)) AS BIGINT) AS tokens FROM documents",
    ),
    "usage_costs": (
        lambda s, d: P.table(s, d, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"),
            L.usage_cost((F.col("l_orderkey") % 23).cast("long"), (F.col("l_linenumber") * 300).cast("long"), F.lit(50), F.lit(200), F.when(F.col("l_orderkey") % 37 != 0, F.floor(F.col("l_quantity")) * 10000).cast("long")).alias("cost"),
        ),
        "SELECT l_orderkey * 10 + l_linenumber AS call, CASE WHEN l_orderkey % 23 > 0 THEN CAST(greatest(l_orderkey % 23 * 50 + l_linenumber * 60000, CASE WHEN l_orderkey % 37 <> 0 THEN floor(l_quantity) * 10000 ELSE 0 END) AS BIGINT) END AS cost FROM lineitem",
    ),
    "stale_prices": (
        lambda s, d: L.stale_prices(P.table(s, d, "orders").select(F.col("o_orderkey").alias("model"), (F.col("o_orderkey") % 5).alias("prompt_price"), F.lit(1).alias("completion_price"), F.when(F.col("o_orderkey") % 7 == 0, "long ago").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("fetched_at")), "1996-01-01T00:00:00", 24 * 365),
        "SELECT o_orderkey AS model, CASE WHEN o_orderkey % 5 = 0 THEN 'not_positive' ELSE 'stale' END AS problem FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 365 DAY",
    ),
    "failed_call_usage": (
        lambda s, d: L.failed_call_violations(P.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("call"))),
        "SELECT l_orderkey AS call FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey HAVING count(*) > 1",
    ),
}
