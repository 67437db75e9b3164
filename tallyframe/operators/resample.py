"""Case-cluster bootstrap: resampling cases with replacement from a reproducible 32-bit stream.

Draw j of sample s is a function of its place s * n + j + 1 in the stream, so the index table is built in parallel
and is shared by all statistics; only per-case sums meet it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.rng import BOOTSTRAP_SEED, NET_WIN_SEED, lcg31_cycle, lcg31_slot, lcg_index, lcg_state
from tallyframe.operators.metrics import ratio, ratio_or_null, scored


def stream(spark: SparkSession, n: int, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(place, state) of the first n draws."""
    return spark.range(1, n + 1).select(F.col("id").alias("place"), lcg_state(F.col("id"), seed).alias("state"))


def resample_index(spark: SparkSession, n: int, samples: int, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(sample, ordinal, times): how often each of n cases is drawn in each sample."""
    draws = spark.range(n * samples).select(F.floor(F.col("id") / n).cast("int").alias("sample"), lcg_index(F.col("id") + 1, n, seed).alias("ordinal"))
    return draws.groupBy("sample", "ordinal").agg(F.count(F.lit(1)).alias("times"))


def numbered_cases(attempts: DataFrame) -> DataFrame:
    """(case_index, ordinal) of the scored cases, by case_index from 0.

    Ranks are taken inside ranges of case_index and offset by the ranges' counts, so no task gets all cases.
    """
    c = attempts.where(scored()).select("case_index").distinct().withColumn("part", F.floor(F.col("case_index") / 4096))
    counts = c.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("case_index")) - 1
    return c.withColumn("at", inside).join(before, "part").select("case_index", (F.col("base") + F.col("at")).cast("int").alias("ordinal"))


def lower_quantile(values: Column, p: float) -> Column:
    """sorted[floor((n - 1) * p)] of an array; null if it is empty."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) * p).cast("int"))


def interval(grouped, value: Column) -> DataFrame:
    """low and high of a 95 % percentile interval over the non-null values, and their number."""
    listed = grouped.agg(F.collect_list(value).alias("v"), F.count(F.lit(1)).alias("samples"))
    return listed.withColumns({"low": lower_quantile(F.col("v"), 0.025), "high": lower_quantile(F.col("v"), 0.975), "defined": F.size("v")}).drop("v")


def _resampled(per_case: DataFrame, ordinals: DataFrame, samples: int, sums: list[str]) -> DataFrame:
    """Sums over each sample of per-case columns: (sample, config_id, sums)."""
    n = ordinals.count()
    index = resample_index(per_case.sparkSession, n, samples)
    placed = per_case.join(ordinals, "case_index")
    joined = index.join(placed, "ordinal")
    return joined.groupBy("sample", "config_id").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums])


def complete_configs(coverage: DataFrame) -> DataFrame:
    return coverage.where("complete").select("config_id")


def bootstrap_pass_rate(attempts: DataFrame, coverage: DataFrame, samples: int) -> DataFrame:
    """Interval of each configuration's pass rate; null bounds unless every scored trial has exactly one attempt."""
    per_case = attempts.where(scored()).groupBy("case_index", "config_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("passed")).alias("passes"))
    rates = _resampled(per_case, numbered_cases(attempts), samples, ["attempts", "passes"])
    return _bounds(interval(rates.groupBy("config_id"), ratio_or_null(F.col("passes"), F.col("attempts"))), coverage)


def _bounds(intervals: DataFrame, coverage: DataFrame) -> DataFrame:
    whole = coverage.select("config_id", "complete")
    return whole.join(intervals, "config_id", "left").select("config_id", *[F.when(F.col("complete"), F.col(c)).alias(c) for c in ("low", "high")])


def bootstrap_pass_delta(pairs: DataFrame, attempts: DataFrame, samples: int) -> DataFrame:
    """Interval of the pass-rate difference from the baseline, over the complete pairs of each sample."""
    both = pairs.where("base_passed IS NOT NULL AND target_passed IS NOT NULL")
    per_case = both.groupBy("case_index", "config_id").agg(F.count(F.lit(1)).alias("paired"), F.sum(F.col("target_passed").cast("int") - F.col("base_passed").cast("int")).alias("net"))
    rates = _resampled(per_case, numbered_cases(attempts), samples, ["paired", "net"])
    return interval(rates.groupBy("config_id"), ratio_or_null(F.col("net"), F.col("paired"))).select("config_id", "low", "high")


def bootstrap_cost_per_pass(attempts: DataFrame, samples: int) -> DataFrame:
    """Interval of the cost per pass; samples without a pass are counted, and too many of them leave no interval."""
    per_case = attempts.where(scored()).groupBy("case_index", "config_id").agg(F.sum(F.coalesce("cost_micro", F.lit(0))).alias("cost"), F.count_if(F.col("passed")).alias("passes"))
    rates = _resampled(per_case, numbered_cases(attempts), samples, ["cost", "passes"])
    got = interval(rates.groupBy("config_id"), ratio_or_null(F.col("cost"), F.col("passes")))
    enough = (F.col("defined") > 0) & (F.col("defined") >= samples / 2)
    return got.select("config_id", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), (F.lit(samples) - F.col("defined")).cast("long").alias("zero_pass_samples"), ratio(F.lit(samples) - F.col("defined"), F.lit(samples)).alias("undefined_rate"))


def bootstrap_all(attempts: DataFrame, pairs: DataFrame, coverage: DataFrame, baseline: str, samples: int) -> DataFrame:
    """All intervals of each configuration from one pass: per-case sums of rates, pairs and costs meet the index table once.

    pass_* are null unless every scored trial has exactly one attempt, delta_* unless that holds for the baseline too,
    cost_* (millionths) unless half the samples have a pass. zero_pass_samples counts those without.
    """
    c = F.col
    own = attempts.where(scored()).groupBy("case_index", "config_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(c("passed")).alias("passes"), F.sum(F.coalesce("cost_micro", F.lit(0))).alias("cost"))
    both = pairs.where("base_passed IS NOT NULL AND target_passed IS NOT NULL")
    paired = both.groupBy("case_index", "config_id").agg(F.count(F.lit(1)).alias("paired"), F.sum(c("target_passed").cast("int") - c("base_passed").cast("int")).alias("net"))
    sums = ["attempts", "passes", "cost", "paired", "net"]
    per_case = own.join(paired, ["case_index", "config_id"], "left").na.fill(0, sums)
    drawn = _resampled(per_case, numbered_cases(attempts), samples, sums)
    rates = {"pass": ("passes", "attempts"), "delta": ("net", "paired"), "cost": ("cost", "passes")}
    listed = drawn.groupBy("config_id").agg(*[F.collect_list(ratio_or_null(c(part), c(whole))).alias(name) for name, (part, whole) in rates.items()])
    whole = coverage.select("config_id", "complete", F.max(F.when(c("config_id") == baseline, c("complete"))).over(Window.partitionBy()).alias("base_complete"))  # a row for each configuration
    defined = F.coalesce(F.size("cost"), F.lit(0))
    shown = {"pass": c("complete"), "delta": c("complete") & c("base_complete") & (c("config_id") != baseline), "cost": (defined > 0) & (defined >= samples / 2)}
    bounds = [F.when(shown[name], lower_quantile(c(name), at)).alias(f"{name}_{end}") for name in rates for end, at in (("low", 0.025), ("high", 0.975))]
    return whole.join(listed, "config_id", "left").select("config_id", *bounds, (F.lit(samples) - defined).cast("long").alias("zero_pass_samples"))


def net_win_intervals(outcomes: DataFrame, keys: list[str], order_col: str, value_col: str, samples: int = 2000, seed: int = NET_WIN_SEED) -> DataFrame:
    """keys, tasks, low, high: 95 % bounds of the net win rate of each group of judged tasks, values -1, 0 and 1, in their order.

    The 31-bit stream rounds in doubles and so has no closed form, but it soon runs into a cycle. So a group meets its tasks at
    the states of that cycle only (some thousand), and running sums of the values there give the sum of any stretch of the
    stream, whole rounds of the cycle included: a sample is the difference of two of them, and no draw is a row. Each group
    starts the stream anew. A draw of exactly 1 takes the last task. Nulls are no outcomes; ties in the order go by value.
    """
    spark = outcomes.sparkSession
    states, back = lcg31_cycle(seed)
    if back == 0:  # the seed is no draw at first
        states, back = [*states, states[0]], 1
    last = len(states) - 1
    table = spark.createDataFrame(list(enumerate(states)), "slot int, state long").where("slot > 0")
    # ranks are taken inside ranges of the order and offset by the ranges' counts, so no task gets a whole group
    parted = outcomes.where(F.col(value_col).isNotNull()).select(*keys, F.floor(F.col(order_col) / 4096).alias("part"), F.col(order_col).alias("place"), F.col(value_col).cast("long").alias("value"))
    counts = parted.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), (F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("place", "value")) - 1
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "part")])
    judged = parted.withColumn("at", inside).join(before, same).select(*keys, "value", (F.col("base") + F.col("at")).cast("int").alias("ordinal"))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("tasks"))
    drawn = sizes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).join(F.broadcast(table), F.col("slot") <= F.col("tasks") * samples)  # some thousand states
    index = F.least(F.col("tasks") - 1, F.floor(F.col("state") / float(0x7FFFFFFF) * F.col("tasks"))).cast("int")
    met = drawn.select(*keys, "slot", index.alias("ordinal")).join(judged, [*keys, "ordinal"])
    sums = met.select(*keys, "slot", F.sum("value").over(Window.partitionBy(*keys).orderBy("slot")).alias("upto"))
    ends = sizes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples)))).withColumn("place", F.col("sample") * F.col("tasks"))
    # the sum up to a place is that up to its slot, and a whole round for each time that the stream has come back before
    rounds = F.greatest(F.floor((F.col("place") - back) / (last + 1 - back)), F.lit(0))
    placed = ends.select(*keys, "tasks", "sample", lcg31_slot(F.col("place"), last + 1, back).alias("slot"), rounds.alias("rounds")).join(sums, [*keys, "slot"], "left")
    whole = sums.groupBy(*keys).agg((F.max(F.when(F.col("slot") == last, F.col("upto"))) - F.coalesce(F.max(F.when(F.col("slot") == back - 1, F.col("upto"))), F.lit(0))).alias("round"))
    summed = placed.join(whole, keys).select(*keys, "tasks", "sample", (F.coalesce("upto", F.lit(0)) + F.when(F.col("rounds") > 0, F.col("rounds") * F.col("round")).otherwise(0)).alias("upto"))
    nets = summed.withColumn("net", F.col("upto") - F.lag("upto").over(Window.partitionBy(*keys).orderBy("sample"))).where("sample > 0")
    bounds = nets.groupBy(*keys, "tasks").agg(F.array_sort(F.collect_list(F.col("net") / F.col("tasks"))).alias("v"))
    return bounds.select(*keys, "tasks", F.get("v", F.lit(int(samples * 0.025))).alias("low"), F.get("v", F.lit(int(samples * 0.975))).alias("high"))


def direction(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "indeterminate").when(low > 0, "better").when(high < 0, "worse").otherwise("no_clear_difference")


def sample_warnings(scored_cases: int) -> list[str]:
    if scored_cases == 0:
        return ["No scored cases; confidence intervals are degenerate."]
    return ["Fewer than 30 scored cases; bootstrap intervals are exploratory."] if scored_cases < 30 else []
