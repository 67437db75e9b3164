"""Bindings of the star schema (attempts, cases, votes, ...) to the tables of a scale-factor folder.

The folders hold no evaluation runs; these views derive them with integer arithmetic only, so that another SQL
engine gives the same rows. ``*_SQL`` are the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The configurations in their fixed order, and the statuses of a failed call.
CONFIGS = ("direct", "self_review", "repeated", "fusion")
EVENT_CONFIG = {"view": "direct", "click": "self_review", "signup": "repeated", "purchase": "fusion"}
FAILURES = ("timeout", "provider_error", "invalid_output", "budget_exhausted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CONFIGS)], "config_id string, config_order int")


def with_case_columns(rows: DataFrame) -> DataFrame:
    """smoke_only, category and difficulty, functions of case_index."""
    c = F.col("case_index")
    return rows.withColumns(
        {
            "smoke_only": c % 10 == 0,
            "category": F.concat(F.lit("cat_"), (c % 5).cast("string")),
            "difficulty": F.when(c % 17 == 0, None).when(c % 3 == 0, "easy").when(c % 3 == 1, "medium").otherwise("hard"),
        }
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each attempt: an event that isn't an error."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_CONFIG.items() for x in pair])
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    k = F.get_json_object("props", "$.k").cast("int")
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = e.select(
        F.col("user_id").alias("case_index"),
        (F.row_number().over(order) - 1).cast("long").alias("trial_index"),
        kinds[F.col("event_type")].alias("config_id"),
        "event_id",
        k.alias("k"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cost_micro"),
        F.floor(F.col("value") * 10 + 0.5).cast("long").alias("latency_ms"),
        (F.col("value") < 35).alias("good"),
    )
    failed = F.col("k") < 8
    rows = rows.select(
        "case_index", "trial_index", "config_id", "event_id", "cost_micro", "latency_ms",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.element_at(F.array(*[F.lit(x) for x in FAILURES]), (F.col("k") % 4 + 1).cast("int"))).alias("failure_status"),
        (~failed & (F.col("k") % 10 == 9)).alias("degraded"),
        (~failed & F.col("good")).alias("passed"),
    )
    return with_case_columns(rows)


ATTEMPTS_SQL = """e AS (
  SELECT user_id AS case_index, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS trial_index,
    CASE event_type WHEN 'view' THEN 'direct' WHEN 'click' THEN 'self_review' WHEN 'signup' THEN 'repeated' ELSE 'fusion' END AS config_id,
    CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cost_micro,
    CAST(floor(value * 10 + 0.5) AS BIGINT) AS latency_ms, value < 35 AS good
  FROM events WHERE event_type <> 'error'),
attempts AS (
  SELECT case_index, trial_index, config_id, event_id, cost_micro, latency_ms, CASE WHEN k < 8 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN k < 8 THEN ['timeout', 'provider_error', 'invalid_output', 'budget_exhausted'][k % 4 + 1] END AS failure_status,
    k >= 8 AND k % 10 = 9 AS degraded, k >= 8 AND good AS passed, case_index % 10 = 0 AS smoke_only, 'cat_' || (case_index % 5) AS category,
    CASE WHEN case_index % 17 = 0 THEN NULL WHEN case_index % 3 = 0 THEN 'easy' WHEN case_index % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty
  FROM e),
configs AS (SELECT * FROM (VALUES ('direct', 0), ('self_review', 1), ('repeated', 2), ('fusion', 3)) t(config_id, config_order))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each case with an attempt, with the tier of its (derived) grader."""
    c = with_case_columns(attempts(spark, sf_dir).select("case_index").distinct())
    i = F.col("case_index")
    return c.withColumn("tier", F.when(F.col("smoke_only"), "smoke_only").when(i % 7 == 0, "surface_text").when(i % 7 == 1, "mixed").when(i % 23 == 5, "ungraded").otherwise("structured_or_exact"))


CASES_SQL = (
    ATTEMPTS_SQL
    + """,
cases AS (SELECT *, CASE WHEN smoke_only THEN 'smoke_only' WHEN case_index % 7 = 0 THEN 'surface_text' WHEN case_index % 7 = 1 THEN 'mixed' WHEN case_index % 23 = 5 THEN 'ungraded' ELSE 'structured_or_exact' END AS tier
  FROM (SELECT DISTINCT case_index, smoke_only, category, difficulty FROM attempts))"""
)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges see each document's pair in both orders."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    grid = d.withColumn("judge", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2)]))).withColumn("order", F.explode(F.array(F.lit(1), F.lit(2))))
    pick = (F.col("doc_id") * 7 + F.col("judge") * 3 + F.col("order") * 5 + F.floor(F.col("doc_id") / 11)) % 3
    return grid.withColumn("verdict", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), (pick + 1).cast("int")))


VOTES_SQL = """votes AS (
  SELECT doc_id, source, judge, o AS "order", ['A', 'B', 'TIE'][CAST((doc_id * 7 + judge * 3 + o * 5 + doc_id // 11) % 3 AS INT) + 1] AS verdict
  FROM documents, (VALUES (0), (1), (2)) j(judge), (VALUES (1), (2)) r(o))"""
