"""Readers of case files, manifests, prices, reports and tasks, and the JSON sink."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRADER = """struct<exact:string,exactNormalized:string,mustInclude:array<string>,containsAny:array<string>,mustNotInclude:array<string>,regex:array<string>,
minLength:int,maxLength:int,choice:struct<expected:string,allowed:array<string>>,number:struct<expected:double,tolerance:double,min:double,max:double,extractionRegex:string>>"""
CASE = f"id string, task string, constraints array<string>, category string, difficulty string, smokeOnly boolean, grader {GRADER}"
CASE_KEYS = ["id", "task", "constraints", "category", "difficulty", "smokeOnly", "grader"]
RESPONSE = "id string, trialIndex long, configId string, answer string, failureStatus string, degraded boolean, costUsd double, latencyMs long"
PRICE = "modelId string, name string, provider string, supportedParameters array<string>, promptPriceUsdPerToken double, completionPriceUsdPerToken double, fetchedAt string, source string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, index, raw): 1-based physical line numbers within each file, and the place among all lines that aren't
    blank, files in order of their paths. Lines end with a line feed; blank ones are counted and left out.

    A file is read by as many tasks as it has splits. The tasks count the lines of their splits first; sums over the splits
    before give each split's first number, and a line adds its place in the task. Only a row for each split is shuffled.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # Spark numbers the rows of a task from 0, in reading order
    split = ["task", "file", "start"]
    every = spark.read.text(path, lineSep="\n").select(
        F.spark_partition_id().alias("task"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("at"), F.regexp_replace("value", "\r$", "").alias("raw")
    )
    kept = every.where(F.regexp_replace("raw", r"\s", "") != "").withColumn("kept_at", place)
    counts = every.groupBy(*split).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    counts = counts.join(kept.groupBy(*split).agg(F.min("kept_at").alias("first_kept"), F.count(F.lit(1)).alias("n_kept")), split, "left").fillna(0)
    in_file = Window.partitionBy("file").orderBy("start", "task").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy("file", "start", "task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of the input
    base = counts.select(*split, "first", "first_kept", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("n_kept").over(in_all), F.lit(0)).alias("kept_before"))
    line, index = F.col("at") - F.col("first") + F.col("lines_before") + 1, F.col("kept_at") - F.col("first_kept") + F.col("kept_before")
    # a split that was dealt to other tasks this time has no numbers: fail rather than lose its lines
    known = F.when(line.isNull(), F.raise_error(F.lit("the input was split anew between two readings"))).otherwise(line)
    return kept.join(base, split, "left").select("file", known.cast("int").alias("line"), index.cast("long").alias("index"), "raw")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case rows: case_index (in file and line order), line, raw, the case's fields, and JSON and citation graders as texts.

    Lines that are no JSON object stay with null fields; ``case_problems`` names them.
    """
    lines = read_lines(spark, path)
    numbered = lines.withColumn("c", F.from_json("raw", CASE, {"mode": "PERMISSIVE"})).withColumnRenamed("index", "case_index")
    g = F.col("c.grader")
    return numbered.select(
        "case_index", "line", "raw", "c.id", "c.task", "c.constraints", "c.category", "c.difficulty", F.coalesce("c.smokeOnly", F.lit(False)).alias("smoke_only"),
        g["exact"].alias("exact"), g["exactNormalized"].alias("exact_normalized"), g["mustInclude"].alias("must_include"), g["containsAny"].alias("contains_any"), g["mustNotInclude"].alias("must_not_include"), g["regex"].alias("regex"),
        g["minLength"].alias("min_length"), g["maxLength"].alias("max_length"), g["choice"]["expected"].alias("choice_expected"), g["choice"]["allowed"].alias("choice_allowed"),
        g["number"]["expected"].alias("number_expected"), g["number"]["tolerance"].alias("number_tolerance"), g["number"]["min"].alias("number_min"), g["number"]["max"].alias("number_max"), g["number"]["extractionRegex"].alias("number_regex"),
        F.get_json_object("raw", "$.grader.json").alias("json_spec"), F.get_json_object("raw", "$.grader.citations").alias("citation_spec"),
    )


def case_problems(cases: DataFrame) -> DataFrame:
    """(line, problem): lines that are no JSON object, and unknown keys."""
    keys = F.json_object_keys("raw")
    strange = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in CASE_KEYS]))) > 0
    problem = F.when(keys.isNull(), "not_a_json_object").when(strange, "unknown_key")
    return cases.select("line", problem.alias("problem")).where("problem IS NOT NULL")


def read_responses(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """Recorded answers as ``evaluation`` takes them, by the ids of ``cases``; event_id is the order of files and lines.

    An answer to an unknown case stays, with case_index null, so that it is counted as unexpected; of several cases with one
    id the first takes the answers.
    """
    lines = read_lines(spark, path).withColumn("r", F.from_json("raw", RESPONSE, {"mode": "PERMISSIVE"}))
    numbered = lines.select("r.*", F.col("index").alias("event_id"))
    known = cases.where("id IS NOT NULL").groupBy("id").agg(F.min("case_index").alias("case_index"))
    micro = F.floor(F.coalesce("costUsd", F.lit(0.0)) * 1_000_000 + 0.5).cast("long")
    return numbered.join(known, "id", "left").select(
        "case_index", F.coalesce("trialIndex", F.lit(0)).alias("trial_index"), F.col("configId").alias("config_id"), "event_id", "answer", F.col("failureStatus").alias("failure_status"),
        F.coalesce("degraded", F.lit(False)).alias("degraded"), micro.alias("cost_micro"), F.coalesce("latencyMs", F.lit(0)).alias("latency_ms"),
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price entries: model, prompt_price, completion_price, fetched_at; duplicates and non-positive prices are refused."""
    rows = spark.read.schema(PRICE).json(path, multiLine=True)
    prices = rows.select(F.col("modelId").alias("model"), F.col("promptPriceUsdPerToken").alias("prompt_price"), F.col("completionPriceUsdPerToken").alias("completion_price"), F.col("fetchedAt").alias("fetched_at"))
    bad = prices.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("prompt_price", "completion_price")).alias("least")).where("n > 1 OR least IS NULL OR least <= 0")
    if not bad.isEmpty():
        raise ValueError(f"unacceptable prices: {[r['model'] for r in bad.limit(5).collect()]}")
    return prices


def catalog_prices(rows: DataFrame) -> DataFrame:
    """Catalog entries with both prices above zero."""
    return rows.where("prompt_price > 0 AND completion_price > 0")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a whole-file JSON report, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("traces").alias("trace")).select("trace.*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, task string, constraints array<string>").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document as (body)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


def same_path(left: str, right: str) -> bool:
    """Whether two paths are one place, through links and missing ends."""
    return os.path.realpath(left) == os.path.realpath(right)


def write_json(path: str, value: object, inputs: tuple[str, ...] = ()) -> None:
    """A pretty JSON file; an input is never written over."""
    if any(same_path(path, i) for i in inputs):
        raise ValueError("the output is one of the inputs")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def write_document(path: str, head: dict, list_key: str, rows: Iterable[dict], inputs: tuple[str, ...] = ()) -> None:
    """A JSON document with the keys of ``head`` and one long list, written item by item; an input is never written over."""
    if any(same_path(path, i) for i in inputs):
        raise ValueError("the output is one of the inputs")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head, indent=2, ensure_ascii=False).removesuffix("\n}") + f',\n  "{list_key}": [')
        for i, row in enumerate(rows):
            f.write((",\n    " if i else "\n    ") + json.dumps(row, ensure_ascii=False))
        f.write("\n  ]\n}\n")
