"""Grouped and paired metrics over attempts.

Attempts: case_index, trial_index, config_id, event_id (stored order), status, passed, degraded, smoke_only,
cost_micro (millionths of a dollar), latency_ms, failure_status, category. Costs stay integers until the last division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored() -> Column:
    return ~F.col("smoke_only")


def done() -> Column:
    return F.col("status") == "completed"


def ratio(part: Column, whole: Column) -> Column:
    """0 for an empty denominator."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / F.nullif(whole, F.lit(0)))


def _count(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def latency_ranks(attempts: DataFrame) -> DataFrame:
    """(config_id, p50, p95): nearest-rank latencies of completed attempts, from counts of each different latency."""
    counts = attempts.where(done() & F.col("latency_ms").isNotNull()).groupBy("config_id", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("config_id")
    upto = counts.withColumns({"upto": F.sum("n").over(own.orderBy("latency_ms")), "total": F.sum("n").over(own)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("latency_ms")))
    return upto.groupBy("config_id").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def scorecard(attempts: DataFrame, configs: DataFrame) -> DataFrame:
    """All metrics of each configuration in one aggregation; configurations without attempts appear with zeros and nulls.

    Latency percentiles are nearest-rank; status, partial-failure, verification and smoke rates are 0 when empty,
    pass rate and costs per pass or attempt are null.
    """
    cost = F.coalesce(F.col("cost_micro"), F.lit(0))
    stats = attempts.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n"),
        _count(scored()).alias("scored_n"),
        _count(scored() & F.col("passed")).alias("passes"),
        F.sum(F.when(scored(), cost)).alias("scored_cost"),
        F.sum(cost).alias("total_cost_micro"),
        *[_count(F.col("failure_status") == s).alias(f"n_{s}") for s in ("timeout", "provider_error", "invalid_output", "budget_exhausted")],
        _count(done() & F.col("degraded")).alias("n_degraded"),
        _count(~scored()).alias("smoke_n"),
        _count(~scored() & done()).alias("smoke_done"),
    )
    zero = ["n", "scored_n", "passes", "total_cost_micro", "n_timeout", "n_provider_error", "n_invalid_output", "n_budget_exhausted", "n_degraded", "smoke_n", "smoke_done"]
    s = configs.select("config_id").join(stats, "config_id", "left").na.fill(0, zero).join(latency_ranks(attempts), "config_id", "left")
    c = F.col
    return s.select(
        "config_id", c("scored_n").alias("scored_attempt_n"), ratio_or_null(c("passes"), c("scored_n")).alias("task_pass_rate"),
        ratio_or_null(c("scored_cost"), c("passes")).alias("cost_per_pass_micro"), ratio_or_null(c("scored_cost"), c("scored_n")).alias("mean_cost_micro"), "total_cost_micro",
        F.coalesce(c("p50").cast("long"), F.lit(0)).alias("p50_latency_ms"), F.coalesce(c("p95").cast("long"), F.lit(0)).alias("p95_latency_ms"),
        *[ratio(c(f"n_{s_}"), c("n")).alias(f"{s_}_rate") for s_ in ("timeout", "provider_error", "invalid_output", "budget_exhausted")],
        ratio(c("n_degraded"), c("n")).alias("partial_failure_rate"), ratio(c("smoke_done"), c("smoke_n")).alias("smoke_completion_rate"),
    )


def max_failure_rate(card: DataFrame) -> DataFrame:
    """The largest of the five runtime failure rates of each configuration."""
    rates = ["timeout_rate", "provider_error_rate", "invalid_output_rate", "budget_exhausted_rate", "partial_failure_rate"]
    return card.select("config_id", F.greatest(*rates).alias("max_failure_rate"))


def verification_failure_rate(attempts: DataFrame, verified: Column) -> DataFrame:
    """Completed scored attempts whose verification failed, among the scored ones."""
    return attempts.groupBy("config_id").agg(ratio(_count(scored() & done() & ~verified), _count(scored())).alias("verification_failure_rate"))


def first_outcomes(attempts: DataFrame) -> DataFrame:
    """The first attempt in stored order of each (case, trial, config)."""
    values = F.struct("event_id", "passed", "cost_micro")
    best = attempts.where(scored()).groupBy("case_index", "trial_index", "config_id").agg(F.min(values).alias("v"))
    return best.select("case_index", "trial_index", "config_id", F.col("v.passed").alias("passed"), F.coalesce("v.cost_micro", F.lit(0)).alias("cost_micro"))


def paired_outcomes(attempts: DataFrame, baseline: str, targets: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each scored (case, trial) against the baseline, for each target; nulls where one is missing.

    One shuffle by (case, trial): both sides come from the same pivoted aggregate instead of two self-joins.
    """
    extra = keys or []
    trials = attempts.where(scored()).select("case_index", "trial_index", *extra).distinct()
    firsts = first_outcomes(attempts)
    side = lambda c: F.first(F.when(F.col("config_id") == c, F.struct("passed", "cost_micro")), ignorenulls=True)
    wide = firsts.groupBy("case_index", "trial_index").agg(*[side(c).alias(c) for c in [baseline, *targets]])
    both = trials.join(wide, ["case_index", "trial_index"], "left")
    rows = both.select("case_index", "trial_index", *extra, F.col(baseline).alias("base"), F.explode(F.array(*[F.struct(F.lit(t).alias("config_id"), F.col(t).alias("target")) for t in targets])).alias("x"))
    return rows.select("case_index", "trial_index", *extra, "x.config_id", F.col("base.passed").alias("base_passed"), F.col("x.target.passed").alias("target_passed"), (F.col("x.target.cost_micro") - F.col("base.cost_micro")).alias("cost_delta"))


def paired_comparison(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Wins, losses, ties and deltas; the incremental cost is null unless wins exceed losses."""
    both = F.col("base_passed").isNotNull() & F.col("target_passed").isNotNull()
    win, loss = F.col("target_passed") & ~F.col("base_passed"), ~F.col("target_passed") & F.col("base_passed")
    s = pairs.groupBy("config_id", *(keys or [])).agg(
        _count(both).alias("paired_n"), _count(~both).alias("unpaired_n"), _count(both & win).alias("wins"), _count(both & loss).alias("losses"),
        _count(both & (F.col("target_passed") == F.col("base_passed"))).alias("ties"), F.sum(F.when(both, F.col("cost_delta"))).alias("cost_delta"),
    )
    net = F.col("wins") - F.col("losses")
    return s.select(
        "config_id", *(keys or []), "paired_n", "unpaired_n", "wins", "losses", "ties", ratio_or_null(net, F.col("paired_n")).alias("pass_rate_delta"),
        ratio_or_null(F.col("cost_delta"), F.col("paired_n")).alias("mean_cost_delta_micro"), F.when(net > 0, F.col("cost_delta") / F.nullif(net, F.lit(0))).alias("incremental_cost_micro"),
        ratio_or_null(F.col("losses"), F.col("paired_n")).alias("harm_rate"),
    )


def harm_flags(pairs: DataFrame) -> DataFrame:
    """Trials that the baseline passed and the target failed."""
    return pairs.select("case_index", "trial_index", "config_id", F.coalesce(F.col("base_passed") & ~F.col("target_passed"), F.lit(False)).alias("harm"))


def schedule(cases: DataFrame, configs: DataFrame, trials: int) -> DataFrame:
    """Counterbalanced order: configurations rotated left by (case * trials + trial) mod their number."""
    k = F.lit(configs.count())
    grid = cases.select("case_index", "smoke_only").withColumn("trial_index", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    placed = grid.join(F.broadcast(configs))  # a handful of fixed configurations
    return placed.select("case_index", "trial_index", "smoke_only", "config_id", F.pmod(F.col("config_order") - (F.col("case_index") * trials + F.col("trial_index")), k).cast("int").alias("position"))


def position_counts(scheduled: DataFrame) -> DataFrame:
    """How often each configuration ran at each position, over all and over scored trials."""
    return scheduled.groupBy("config_id", "position").agg(F.count(F.lit(1)).alias("all_n"), _count(scored()).alias("scored_n"))


def coverage(attempts: DataFrame, configs: DataFrame) -> DataFrame:
    """Scored trials x configurations: expected and observed attempts, and trials without exactly one."""
    trials = attempts.where(scored()).select("case_index", "trial_index").distinct()
    seen = attempts.where(scored()).groupBy("case_index", "trial_index", "config_id").count()
    grid = trials.join(F.broadcast(configs.select("config_id")))
    joined = grid.join(seen, ["case_index", "trial_index", "config_id"], "left").na.fill(0, ["count"])
    return joined.groupBy("config_id").agg(F.count(F.lit(1)).alias("expected"), F.sum("count").alias("observed"), _count(F.col("count") != 1).alias("incomplete_trials"), (_count(F.col("count") != 1) == 0).alias("complete"))


def completion_rollup(attempts: DataFrame) -> DataFrame:
    """Completion and passes by difficulty and configuration, with the totals over difficulties as ``all``."""
    known = attempts.withColumn("difficulty", F.coalesce("difficulty", F.lit("none")))
    sets = known.groupingSets([["difficulty", "config_id"], ["config_id"]], "difficulty", "config_id")
    return sets.agg(F.count(F.lit(1)).alias("n"), _count(done()).alias("completed"), _count(F.col("passed")).alias("passed")).select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "config_id", "n", "completed", "passed")


def headroom_cases(attempts: DataFrame, baseline: str) -> DataFrame:
    """Scored cases that the baseline did not always pass (its attempts only)."""
    own = attempts.where(scored() & (F.col("config_id") == baseline)).groupBy("case_index").agg(F.bool_and("passed").alias("always"))
    return own.where(~F.col("always")).select("case_index")


def headroom_rollup(attempts: DataFrame, baseline: str) -> DataFrame:
    return completion_rollup(attempts.join(headroom_cases(attempts, baseline), "case_index", "left_semi"))


def running_budget(attempts: DataFrame, budget_micro: int) -> DataFrame:
    """Spending of each case in stored order, what is left, and whether the budget is exceeded."""
    so_far = Window.partitionBy("case_index").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("cost_micro").over(so_far)
    return attempts.select("case_index", "event_id", spent.alias("spent_micro"), (F.lit(budget_micro) - spent).alias("left_micro"), (spent > budget_micro).alias("over"))
