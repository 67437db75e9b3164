"""Call plans, token and cost bounds, the budget-aware mode ladder, usage validation and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import token_split

#: Mode, call number, stage, role, share of the completion budget, whether the prompt is known beforehand.
CALLS = [
    ("direct", 0, "direct", "direct", 1.0, True),
    ("self_review", 0, "self_review_draft", "direct", 0.6, True),
    ("self_review", 1, "self_review_final", "self_review", 0.4, False),
    ("repeated", 0, "repeated_sample", "repeated", 0.38, True),
    ("repeated", 1, "repeated_sample", "repeated", 0.38, True),
    ("repeated", 2, "aggregator", "aggregator", 0.24, False),
    ("fusion", 0, "candidate", "candidate_a", 0.38, True),
    ("fusion", 1, "candidate", "candidate_b", 0.38, True),
    ("fusion", 2, "aggregator", "aggregator", 0.24, False),
]
LADDER = ("fusion", "repeated", "self_review", "direct")


def call_shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALLS, "mode string, call_no int, stage string, role string, share double, prompt_known boolean")


def planned_calls(budgets: DataFrame, shapes: DataFrame) -> DataFrame:
    """The calls of each mode that a budget can fund, with their output token caps.

    Budgets: request, max_tokens, max_candidates, max_repairs. Floors of the shares, at least 1 token each, the rest to
    the last call. Modes that need more calls than tokens, a second candidate or a repair round that isn't there have none.
    """
    parts = shapes.groupBy("mode").agg(F.sort_array(F.collect_list(F.struct("call_no", "stage", "role", "share", "prompt_known"))).alias("calls"))
    funded = budgets.join(F.broadcast(parts)).where(
        (F.col("max_tokens") >= F.size("calls"))
        & ~((F.col("mode") == "self_review") & (F.col("max_repairs") < 1))
        & ~(F.col("mode").isin("repeated", "fusion") & (F.col("max_candidates") < 2))
    )
    floors = F.transform("calls", lambda c: F.greatest(F.lit(1).cast("long"), F.floor(F.col("max_tokens") * c["share"]).cast("long")))
    used = F.aggregate(F.slice(floors, F.lit(1), F.size("calls") - 1), F.lit(0).cast("long"), lambda s, x: s + x)
    each = funded.withColumns({"floors": floors, "used": used}).select("request", "mode", "max_tokens", "floors", "used", F.size("calls").alias("n"), F.posexplode("calls").alias("i", "c"))
    cap = F.when(F.col("i") == F.col("n") - 1, F.col("max_tokens") - F.col("used")).otherwise(F.get("floors", F.col("i")))
    return each.select("request", "mode", "c.call_no", "c.stage", "c.role", "c.prompt_known", cap.alias("max_output_tokens"))


def mode_estimates(calls: DataFrame, prices: DataFrame, budgets: DataFrame) -> DataFrame:
    """Estimated cost of each mode in price units: completions at their caps, prompts where they are known.

    Prices: role, prompt_price, completion_price (null: missing). A mode with a missing price has no estimate.
    """
    priced = calls.join(prices, "role", "left").join(budgets.select("request", "prompt_tokens"), "request")
    cost = F.col("max_output_tokens") * F.col("completion_price") + F.when(F.col("prompt_known"), F.col("prompt_tokens") * F.col("prompt_price")).otherwise(0)
    missing = F.count_if(F.col("completion_price").isNull() | F.col("prompt_price").isNull())
    return priced.groupBy("request", "mode").agg(F.sum(cost).alias("cost"), (missing > 0).alias("missing")).withColumn("cost", F.when(~F.col("missing"), F.col("cost")))


def auto_mode(estimates: DataFrame, budgets: DataFrame) -> DataFrame:
    """The richest mode within each budget; else direct, with the reason. Requests that fund no mode appear too."""
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(LADDER) for x in (m, i)])
    joined = budgets.select("request", "max_cost").join(estimates, "request", "left")
    fits = (F.col("cost") <= F.col("max_cost")) & ~F.col("missing")
    best = joined.groupBy("request").agg(F.min_by(F.struct("mode", "cost"), F.when(fits, rank[F.col("mode")])).alias("best"), F.bool_or(fits).alias("any"), F.bool_or("missing").alias("missing"))
    found = F.coalesce("any", F.lit(False))
    return best.select(
        "request",
        F.when(found, F.col("best.mode")).otherwise("direct").alias("mode"),
        F.when(found, "selected_richest_within_budget").when(F.coalesce("missing", F.lit(False)), "estimate_unavailable_defaulted_to_direct").otherwise("fell_back_to_direct_over_budget").alias("reason"),
        F.when(found, F.col("best.cost")).otherwise(0).alias("estimate"),
    )


def preflight(calls: DataFrame, prices: DataFrame, case_trials: int) -> DataFrame:
    """Planned attempts, token ceilings and completion cost by configuration and stage, with totals (nulls as ``all``)."""
    priced = calls.join(prices, "role")
    sums = priced.rollup("mode", "stage").agg((F.count(F.lit(1)) * case_trials).alias("attempts"), (F.sum("max_output_tokens") * case_trials).alias("max_tokens"), (F.sum(F.col("max_output_tokens") * F.col("completion_price")) * case_trials).alias("completion_cost"))
    return sums.withColumns({"mode": F.coalesce("mode", F.lit("all")), "stage": F.coalesce("stage", F.lit("all"))})


def guard(plan: DataFrame, max_attempts: int | None, max_cost: int | None) -> list[str]:
    """What the plan's totals exceed; empty if nothing."""
    total = plan.where("mode = 'all' AND stage = 'all'").first()
    out = []
    if max_attempts is not None and total["attempts"] > max_attempts:
        out.append("planned_attempts_above_limit")
    if max_cost is not None and total["completion_cost"] > max_cost:
        out.append("completion_cost_above_limit")
    return out


def usage_violations(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(call, rule) of unacceptable usage rows: model, status, token counts, cost under price and latency.

    Usage: call, model, planned_model, status, input_tokens, output_tokens, max_output_tokens, cost, latency_ms.
    """
    known = usage.join(prices.select(F.col("model").alias("planned_model"), "prompt_price", "completion_price"), "planned_model", "left")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double"))
    c = F.col
    rules = {
        "missing_price": c("prompt_price").isNull(),
        "other_model": ~c("model").eqNullSafe(c("planned_model")),
        "status": ~c("status").eqNullSafe(F.lit("ok")),
        "input_tokens": bad(c("input_tokens")) | (c("input_tokens") <= 0),
        "output_tokens": bad(c("output_tokens")) | (c("output_tokens") < 0) | (c("output_tokens") > c("max_output_tokens")),
        "cost_below_price": bad(c("cost")) | (c("cost") < c("input_tokens") * c("prompt_price") + c("output_tokens") * c("completion_price")),
        "latency": bad(c("latency_ms")) | (c("latency_ms") < 0),
    }
    return known.select("call", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(r)) for r, cond in rules.items()]))).alias("rule"))


def usage_cost(input_tokens: Column, output_tokens: Column, prompt_price: Column, completion_price: Column, reported: Column) -> Column:
    """The larger of what the provider reports and tokens times price; null without valid token counts."""
    local = input_tokens * prompt_price + output_tokens * completion_price
    return F.when((input_tokens > 0) & (output_tokens >= 0), F.greatest(F.coalesce(reported, local), local))


def failed_call_violations(usage: DataFrame) -> DataFrame:
    """Failed calls with more than one usage row."""
    return usage.groupBy("call").count().where("count > 1").select("call")


def stale_prices(prices: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Models whose price is older than ``hours`` at ``now``, unparsable, or not positive."""
    age = F.lit(now).cast("timestamp").cast("double") - F.try_to_timestamp("fetched_at").cast("double")
    fresh = F.coalesce(age <= hours * 3600, F.lit(False))
    positive = F.coalesce((F.col("prompt_price") > 0) & (F.col("completion_price") > 0), F.lit(False))
    return prices.where(~fresh | ~positive).select("model", F.when(~positive, "not_positive").otherwise("stale").alias("problem"))


def price_gaps(required: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, problem): required models without a price, prices nobody requires, and conflicting prices."""
    distinct = prices.select("model", "prompt_price", "completion_price").distinct()
    missing = required.select("model").distinct().join(prices, "model", "left_anti").withColumn("problem", F.lit("missing"))
    unexpected = prices.select("model").distinct().join(required, "model", "left_anti").withColumn("problem", F.lit("unexpected"))
    conflicting = distinct.groupBy("model").count().where("count > 1").select("model").withColumn("problem", F.lit("conflicting"))
    return missing.unionByName(unexpected).unionByName(conflicting)


def ledger_violations(ledgers: DataFrame) -> DataFrame:
    """(ledger, rule) of broken rules. Ledger: claim_ids, candidate_of (map claim -> candidate), consensus, adopted, unique_adopted, rejected."""
    c = F.col
    lists = ("consensus", "adopted", "unique_adopted", "rejected")
    twice = F.exists(F.array(*[F.size(c(x)) != F.size(F.array_distinct(c(x))) for x in lists]), lambda x: x)
    unknown = F.size(F.array_except(F.concat(*[c(x) for x in lists]), c("claim_ids"))) > 0
    spans = F.size(F.array_distinct(F.transform("consensus", lambda x: c("candidate_of")[x])))
    rules = {
        "duplicate_claim": twice,
        "unknown_claim": unknown,
        "unique_not_adopted": F.size(F.array_except("unique_adopted", "adopted")) > 0,
        "unique_in_consensus": F.arrays_overlap("unique_adopted", "consensus"),
        "rejected_overlaps": F.arrays_overlap("rejected", F.concat("adopted", "unique_adopted", "consensus")),
        "consensus_of_one": (F.size("consensus") > 0) & (spans < 2),
    }
    return ledgers.select("ledger", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(r)) for r, cond in rules.items()]))).alias("rule"))


def split_columns(rows: DataFrame, total: str, weights: list[float]) -> DataFrame:
    return rows.select("*", *[p.alias(f"part_{i}") for i, p in enumerate(token_split(F.col(total), weights))])


def blinded_order(items: Column, seed: Column) -> Column:
    """Candidates in their order for even seeds, reversed for odd ones."""
    return F.when(F.pmod(seed, F.lit(2)) == 0, items).otherwise(F.reverse(items))
