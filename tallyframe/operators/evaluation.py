"""The evaluation loop over recorded answers: cases x trials x configurations -> graded attempts -> score card.

Cases: case_index, smoke_only, category, difficulty and any of ``grading.GRADER_COLUMNS``. Responses: case_index,
trial_index, config_id, event_id (recorded order), answer, failure_status (null unless the run failed), degraded,
cost_micro, latency_ms. The plan is one join on case_index; places in schedule and order are closed forms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import grading as G
from tallyframe.operators import metrics as M
from tallyframe.operators import resample as R

#: Version tag of the seed material, name of the schedule.
SEED_VERSION, SCHEDULE = "model-visible-eval-case-v1", "case-trial-rotation-v1"


def _placed(responses: DataFrame, configs: DataFrame) -> DataFrame:
    return responses.join(F.broadcast(configs), "config_id")  # a handful of fixed configurations


def unanswered(cases: DataFrame, responses: DataFrame, configs: DataFrame, trials: int) -> DataFrame:
    """(case_index, trial_index, config_id) that the schedule has and nobody recorded."""
    cells = ["case_index", "trial_index", "config_id"]
    return M.schedule(cases, configs, trials).select(*cells).join(responses.select(*cells), cells, "left_anti")


def unexpected(cases: DataFrame, responses: DataFrame, configs: DataFrame, trials: int) -> DataFrame:
    """Responses whose case, configuration or trial the schedule doesn't have; a null in one of them is none of its."""
    in_range = F.coalesce(F.col("trial_index").between(0, trials - 1), F.lit(False))
    marked = responses.join(cases.select("case_index", F.lit(True).alias("_case")).distinct(), "case_index", "left").join(F.broadcast(configs.select("config_id", F.lit(True).alias("_config"))), "config_id", "left")
    return marked.where(~in_range | F.col("_case").isNull() | F.col("_config").isNull()).select(responses.columns)


def evaluate(cases: DataFrame, responses: DataFrame, configs: DataFrame, trials: int) -> DataFrame:
    """Attempts with position, ordinal, checks and passed: a row for each recorded response that fits the schedule.

    A failed run fails with the one check ``run_completed``, smoke cases too; else the answer is graded, and a null
    answer is the empty one. ``position`` is the place in the counterbalanced schedule, ``ordinal`` that among the
    case's outcomes by trial and configuration. A cell that is recorded twice stays two attempts: pairing takes the
    first and coverage calls it incomplete. Cells without a response are no attempts (see ``unanswered``).
    """
    k = F.lit(configs.count())
    c = F.col
    fit = _placed(responses.where(c("trial_index").between(0, trials - 1)), configs).join(cases, "case_index")
    failed = c("failure_status").isNotNull()
    rows = fit.withColumns(
        {
            "answer": F.coalesce("answer", F.lit("")),
            "status": F.when(failed, "failed").otherwise("completed"),
            "degraded": ~failed & F.coalesce("degraded", F.lit(False)),
            "position": F.pmod(c("config_order") - (c("case_index") * trials + c("trial_index")), k).cast("int"),
            "ordinal": c("trial_index") * k + c("config_order"),
        }
    )
    graded = G.grade(rows)
    never_ran = F.array(G.check("run_completed", F.lit(False)))
    graded = graded.withColumns({"checks": F.when(failed, never_ran).otherwise(c("checks")), "passed": ~failed & c("passed")})
    return graded.select(
        "case_index", "trial_index", "config_id", "event_id", "position", "ordinal", "smoke_only", "category", "difficulty",
        "status", "failure_status", "degraded", "passed", "checks", "cost_micro", "latency_ms",
    )


def grade_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers alone, without run, trial or configuration: (case_index, answer) -> checks and passed."""
    return G.grade(answers.join(cases, "case_index")).select("case_index", "passed", "checks")


def case_results(attempts: DataFrame, baseline: str = "direct", target: str = "fusion") -> DataFrame:
    """A row for each case: attempts, passes, and whether ``target`` failed in a trial that ``baseline`` passed."""
    counts = attempts.groupBy("case_index", "smoke_only").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("passed").alias("passes"))
    harm = M.harm_flags(M.paired_outcomes(attempts, baseline, [target])).groupBy("case_index").agg(F.bool_or("harm").alias("harm"))
    return counts.join(harm, "case_index", "left").select("case_index", "smoke_only", "attempts", "passes", F.coalesce("harm", F.lit(False)).alias("harm"))


@dataclass
class Report:
    """Tables of an evaluation: one row a configuration, but ``positions`` (configuration, position) and ``cases`` (case)."""

    scorecard: DataFrame
    paired: DataFrame
    coverage: DataFrame
    positions: DataFrame
    cases: DataFrame
    pass_rates: DataFrame
    pass_deltas: DataFrame
    costs_per_pass: DataFrame


def report(attempts: DataFrame, configs: DataFrame, baseline: str = "direct", samples: int = 500) -> Report:
    """All metrics and intervals of evaluated attempts; store ``attempts`` first, for every table reads them."""
    others = [r["config_id"] for r in configs.orderBy("config_order").collect() if r["config_id"] != baseline]
    pairs = M.paired_outcomes(attempts, baseline, others)
    cover = M.coverage(attempts, configs)
    return Report(
        M.scorecard(attempts, configs), M.paired_comparison(pairs), cover, M.position_counts(attempts), case_results(attempts, baseline),
        R.bootstrap_pass_rate(attempts, cover, samples), R.bootstrap_pass_delta(pairs, attempts, samples), R.bootstrap_cost_per_pass(attempts, samples),
    )


def seed_material(case_id: Column, task: Column, constraints: Column) -> Column:
    """Digest of what a model sees of a case, as canonical JSON (keys in order, no blanks; control characters in upper-case hex)."""
    listed = F.coalesce(constraints, F.array().cast("array<string>"))
    fields = {"constraintsCount": F.size(listed), "constraintsHash": F.sha2(F.to_json(listed), 256), "id": case_id, "seedVersion": F.lit(SEED_VERSION), "taskHash": F.sha2(task, 256)}
    return F.sha2(F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()])), 256)


def requests(cases: DataFrame, configs: DataFrame, trials: int) -> DataFrame:
    """The schedule's requests: (case_index, trial_index, config_id, position, seed_material); task and constraints stay with the case.

    ``cases``: case_index, case_id, smoke_only, task, constraints (may be null).
    """
    seeds = cases.select("case_index", "smoke_only", seed_material(F.col("case_id"), F.col("task"), F.col("constraints")).alias("seed"))
    grid = M.schedule(seeds, configs, trials).join(seeds.select("case_index", "seed"), "case_index")
    seed = F.concat(F.col("seed"), F.lit(":trial-"), F.col("trial_index").cast("string"), F.lit(":"), F.col("config_id"))
    return grid.select("case_index", "trial_index", "config_id", "position", seed.alias("seed_material"))


def run_id(started_at: str, case_set: str, configs: list[str], trials: int, samples: int) -> Column:
    """The digest that names a run."""
    return F.sha2(F.lit(f"{started_at}:{case_set}:{','.join(configs)}:{trials}:{samples}:{SCHEDULE}"), 256)
