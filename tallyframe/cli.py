"""Commands on case files: validate (summary, gate, manifest), evaluate, plan and verify. Exit codes: 0 fine, 2 blocked."""

from __future__ import annotations

import argparse
import json
import os
import sys

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import structured
from tallyframe.operators import artifact, casesets, evaluation, fingerprints, grading, manifest, planning
from tallyframe.sources import jsonl


def _session() -> SparkSession:
    return SparkSession.builder.appName("tallyframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


#: Name of the schema of manifests that this program writes.
MANIFEST_SCHEMA = "tallyframe-case-set-manifest-v4"


def _key(args: argparse.Namespace) -> bytes | None:
    """The manifest's key, from the environment variable that is named; never an argument itself."""
    return os.environ[args.hmac_key_env].encode() if getattr(args, "hmac_key_env", None) else None


def _canonical(cases):
    return manifest.canonical_cases(cases.withColumns({"tier": grading.tier(cases), "checks": grading.configured_checks(cases)}))


def _without_nulls(rows):
    for r in rows.toLocalIterator():
        yield {k: v for k, v in r.asDict().items() if v is not None and k != "case_index"}


def validate(args: argparse.Namespace) -> int:
    """Counts of problems go to the output, the problems themselves to the table named by --problems."""
    spark = _session()
    cases = jsonl.read_cases(spark, args.cases)
    cases = cases.withColumns({"tier": grading.tier(cases), "checks": grading.configured_checks(cases), "fp": fingerprints.content_fingerprint(F.col("task"), F.col("constraints"), F.col("smoke_only"), F.struct(*[c for c in grading.GRADER_COLUMNS if c in cases.columns and c != "smoke_only"]))})
    problems = jsonl.case_problems(cases).unionByName(casesets.violations(cases).select(F.col("case_index").alias("line"), F.col("rule").alias("problem")))
    if args.problems:
        problems.write.mode("errorifexists").json(args.problems)
    kinds = {r["problem"]: r["count"] for r in problems.groupBy("problem").count().collect()}  # a row for each rule
    duplicates = casesets.exact_duplicates(cases.where(~F.col("smoke_only")), "fp").first()
    texts = cases.where(~F.col("smoke_only")).groupBy("task").agg(F.min("case_index").alias("id"))
    near = casesets.near_duplicate_pairs(texts.select("id", structured.words()("task").alias("tokens"))).count()
    stats = casesets.gate_statistics(cases, duplicates["groups"], near)
    use = {"dev": "development", "public_sample": "public_example"}.get(args.intended_use, args.intended_use)
    findings = [r.asDict() for r in casesets.gate_findings(stats, use, "sha256" if args.manifest else None, bool(args.manifest)).orderBy("severity", "ordinal").collect()]
    blocked = any(f["severity"] == "blocker" for f in findings) and args.gate
    if args.manifest and not blocked and not kinds:
        key, ready = _key(args), _canonical(cases)
        head = manifest.header(ready, args.intended_use, MANIFEST_SCHEMA, key)
        open_ = args.labels and key is None
        jsonl.write_document(args.manifest, head, "rows", _without_nulls(manifest.manifest_rows(ready, open_, open_, key).orderBy("case_index")), (args.cases,))
    print(json.dumps({"cases": cases.count(), "problems": kinds, "findings": findings if args.gate else []}))
    return 2 if blocked or kinds else 0


def evaluate(args: argparse.Namespace) -> int:
    """Grades recorded answers; blocked while a scheduled run has no answer or an answer no scheduled run."""
    spark = _session()
    names = args.configs.split(",")
    configs = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "config_id string, config_order int")
    cases = jsonl.read_cases(spark, args.cases)
    responses = jsonl.read_responses(spark, args.responses, cases)
    attempts = evaluation.evaluate(cases, responses, configs, args.trials).persist()
    found = evaluation.report(attempts, configs, names[0], args.bootstrap_samples)
    tables = {name: [r.asDict() for r in table.orderBy(*table.columns[:2]).collect()] for name, table in vars(found).items()}
    gaps = {"unanswered": evaluation.unanswered(cases, responses, configs, args.trials).count(), "unexpected": evaluation.unexpected(cases, responses, configs, args.trials).count()}
    attempts.unpersist()
    if args.out:
        jsonl.write_json(args.out, tables | gaps, (args.cases, args.responses))
    print(json.dumps({"scorecard": tables["scorecard"], **gaps}))
    return 2 if any(gaps.values()) else 0


def plan(args: argparse.Namespace) -> int:
    spark = _session()
    budget = spark.createDataFrame([(0, args.max_tokens, 2, 1, 1, 0)], "request long, max_tokens long, max_candidates int, max_repairs int, prompt_tokens long, max_cost long")
    prices = jsonl.read_prices(spark, args.prices)
    n = jsonl.read_cases(spark, args.cases).count() * args.trials
    calls = planning.planned_calls(budget, planning.call_shapes(spark))
    rows = planning.preflight(calls, prices.withColumnRenamed("model", "role"), n)
    breaches = planning.guard(rows, args.max_attempts, None)
    print(json.dumps({"plan": [r.asDict() for r in rows.orderBy("mode", "stage").collect()], "breaches": breaches}))
    return 2 if breaches else 0


def verify(args: argparse.Namespace) -> int:
    """A manifest against the cases: its shape, the digest of the whole set, and where rows differ, these."""
    spark = _session()
    body = jsonl.read_document(spark, args.manifest)
    key = _key(args)
    strange = manifest.shape_findings(body.select(F.lit("m").alias("manifest_id"), "body"), key is not None).groupBy("code").count().collect()  # a row for each code
    found: dict = {"shape": {r["code"]: r["count"] for r in strange}}
    if not strange:
        kind = "Sha256" if key is None else "HmacSha256"
        stated = body.select(F.get_json_object("body", "$.intendedUse").alias("use"), F.get_json_object("body", f"$.fingerprint.canonical{kind}").alias("digest")).first()
        ready = _canonical(jsonl.read_cases(spark, args.cases))
        found["digest_matches"] = manifest.set_digest(ready, stated["use"], key) == stated["digest"]
        if not found["digest_matches"]:
            was = body.select(F.explode(F.expr(f"try_variant_get(try_parse_json(body), '$.rows', 'array<struct<publicId:string,canonicalRow{kind}:string>>')")).alias("r")).select(F.col("r.publicId").alias("public_id"), F.col(f"r.canonicalRow{kind}").alias("row_digest"))
            now = manifest.manifest_rows(ready, key=key).select(F.col("publicId").alias("public_id"), F.col(f"canonicalRow{kind}").alias("row_digest"))
            differing = fingerprints.locate_mismatches(was, now)
            if args.differences:
                differing.write.mode("errorifexists").json(args.differences)
            found["rows"] = {r["difference"]: r["count"] for r in differing.groupBy("difference").count().collect()}  # three kinds at most
    print(json.dumps(found))
    return 0 if found.get("digest_matches") else 2


def verify_report(args: argparse.Namespace) -> int:
    """A public report's document, checked on its own: shape, rows against figures, gate. Nothing of its content is printed."""
    spark = _session()
    try:
        body = spark.read.text(args.cases, wholetext=True).select(F.lit("report").alias("report_id"), F.col("value").alias("body"))
        row = artifact.verify(body).first()
    except (AnalysisException, Py4JError):
        row = None
    if row is None:
        row = artifact.verify(spark.createDataFrame([("report", None)], "report_id string, body string")).first()
    print(json.dumps(row.asDict(True)))
    return 0 if row["status"] == "public_report_verified" else 2


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyframe", description=__doc__)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("validate-cases")
    one.add_argument("cases")
    one.add_argument("--gate", action="store_true")
    one.add_argument("--intended-use", default="dev", choices=manifest.USES)
    one.add_argument("--manifest")
    one.add_argument("--labels", action="store_true", help="show ids and categories in the manifest")
    one.add_argument("--hmac-key-env", help="environment variable with the key of a keyed manifest")
    one.add_argument("--problems", help="folder for a table of all problems")
    one.set_defaults(run=validate)
    two = commands.add_parser("plan")
    two.add_argument("cases")
    two.add_argument("prices")
    two.add_argument("--trials", type=int, default=1)
    two.add_argument("--max-tokens", type=int, default=4000)
    two.add_argument("--max-attempts", type=int)
    two.set_defaults(run=plan)
    three = commands.add_parser("verify-manifest")
    three.add_argument("cases")
    three.add_argument("manifest")
    three.add_argument("--hmac-key-env")
    three.add_argument("--differences", help="folder for a table of rows that differ")
    three.set_defaults(run=verify)
    four = commands.add_parser("evaluate")
    four.add_argument("cases")
    four.add_argument("responses")
    four.add_argument("--configs", default="direct,self_review,repeated,fusion")
    four.add_argument("--trials", type=int, default=1)
    four.add_argument("--bootstrap-samples", type=int, default=500)
    four.add_argument("--out")
    four.set_defaults(run=evaluate)
    five = commands.add_parser("verify-public-report")
    five.add_argument("cases", metavar="report")
    five.set_defaults(run=verify_report)
    args = parser.parse_args(argv)
    for path in (args.cases,):
        if args.run is not verify_report and not os.path.exists(path):
            parser.error(f"no such file: {path}")
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
