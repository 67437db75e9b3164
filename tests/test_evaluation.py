import json

import pytest

from tallyframe import cli
from tallyframe.operators import evaluation as E

CASE = "case_index long, case_id string, smoke_only boolean, category string, difficulty string, task string, constraints array<string>, must_include array<string>"
RESPONSE = "case_index long, trial_index long, config_id string, event_id long, answer string, failure_status string, degraded boolean, cost_micro long, latency_ms long"


@pytest.fixture(scope="module")
def configs(spark):
    return spark.createDataFrame([("direct", 0), ("fusion", 1)], "config_id string, config_order int")


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(0, "a", False, "x", "easy", "t", None, ["yes"]), (1, "b", True, None, None, "t", ["c"], None), (2, "d", False, "x", None, "u", None, None)], CASE)


def responses(spark, rows):
    return spark.createDataFrame([(c, t, k, i, a, f, False, 10, 5) for i, (c, t, k, a, f) in enumerate(rows)], RESPONSE)


def test_attempts_follow_the_rules(spark, cases, configs):
    given = responses(spark, [(0, 0, "direct", "Yes", None), (0, 0, "fusion", None, None), (0, 1, "fusion", "yes", "timeout"), (1, 0, "direct", "?", None), (1, 0, "fusion", "?", "provider_error"), (2, 0, "direct", "yes", None)])
    got = {(r["case_index"], r["trial_index"], r["config_id"]): r for r in E.evaluate(cases, given, configs, 2).collect()}
    shown = {k: (r["passed"], r["status"], [c["name"] for c in r["checks"]]) for k, r in got.items()}
    assert shown == {
        (0, 0, "direct"): (True, "completed", ["must_include"]),
        (0, 0, "fusion"): (False, "completed", ["must_include"]),
        (0, 1, "fusion"): (False, "failed", ["run_completed"]),
        (1, 0, "direct"): (True, "completed", ["smoke_only"]),
        (1, 0, "fusion"): (False, "failed", ["run_completed"]),
        (2, 0, "direct"): (False, "completed", ["grader_configured"]),
    }
    # rotated left by case * trials + trial
    assert [got[k]["position"] for k in [(0, 0, "direct"), (0, 0, "fusion"), (0, 1, "fusion"), (1, 0, "direct")]] == [0, 1, 0, 0]
    assert [got[k]["ordinal"] for k in [(0, 0, "direct"), (0, 0, "fusion"), (0, 1, "fusion")]] == [0, 1, 3]
    results = {r["case_index"]: r for r in E.case_results(E.evaluate(cases, given, configs, 2)).collect()}
    assert [results[i]["harm"] for i in range(3)] == [True, False, False] and results[1]["attempts"] == 2


def test_gaps_and_strangers(spark, cases, configs):
    given = responses(spark, [(0, 0, "direct", "yes", None), (0, 1, "direct", "yes", None), (9, 0, "direct", "yes", None), (0, 0, "odd", "yes", None), (1, 0, "fusion", "x", None)])
    assert E.evaluate(cases, given, configs, 1).count() == 2
    assert {r["event_id"] for r in E.unexpected(cases, given, configs, 1).collect()} == {1, 2, 3}
    assert {tuple(r) for r in E.unanswered(cases, given, configs, 1).collect()} == {(0, 0, "fusion"), (1, 0, "direct"), (2, 0, "direct"), (2, 0, "fusion")}


def test_report_of_repeated_and_of_no_answers(spark, cases, configs):
    twice = E.evaluate(cases, responses(spark, [(0, 0, "direct", "no", None), (0, 0, "direct", "yes", None), (0, 0, "fusion", "yes", None)]), configs, 1)
    r = E.report(twice, configs, samples=20)
    assert not {x["config_id"]: x["complete"] for x in r.coverage.collect()}["direct"]
    assert r.paired.first()["wins"] == 1  # the first of both outcomes
    none = E.report(E.evaluate(cases, responses(spark, [(0, 0, "direct", "yes", None)]).limit(0), configs, 1), configs, samples=20)
    assert {x["scored_attempt_n"] for x in none.scorecard.collect()} == {0}
    for name, table in vars(none).items():
        assert name in ("scorecard", "pass_rates") or table.count() == 0


def test_seed_material_is_the_digest_of_canonical_json(spark, cases, configs):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sha('{"constraintsCount":1,"constraintsHash":"%s","id":"b","seedVersion":"model-visible-eval-case-v1","taskHash":"%s"}' % (sha('["c"]'), sha("t")))
    got = {(r["config_id"], r["trial_index"]): r for r in E.requests(cases, configs, 2).where("case_index = 1").collect()}
    assert got["fusion", 1]["seed_material"] == f"{want}:trial-1:fusion"


def test_evaluate_from_the_command_line(spark, tmp_path, capsys):
    case, answer = tmp_path / "cases.jsonl", tmp_path / "answers.jsonl"
    case.write_text(json.dumps({"id": "a", "task": "Say x", "category": "c", "grader": {"mustInclude": ["x"]}}) + "\n")
    rows = [{"id": "a", "configId": "direct", "answer": "X", "costUsd": 0.25, "latencyMs": 7}, {"id": "a", "configId": "fusion", "failureStatus": "timeout"}]
    answer.write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = tmp_path / "report.json"
    assert cli.main(["evaluate", str(case), str(answer), "--configs", "direct,fusion", "--bootstrap-samples", "20", "--out", str(out)]) == 0
    report = json.loads(out.read_text())
    card = {r["config_id"]: r for r in report["scorecard"]}
    assert card["direct"]["task_pass_rate"] == 1 and card["direct"]["cost_per_pass_micro"] == 250000 and card["fusion"]["timeout_rate"] == 1
    assert report["cases"] == [{"case_index": 0, "smoke_only": False, "attempts": 2, "passes": 1, "harm": True}]
    answer.write_text(json.dumps(rows[0]) + "\n")
    assert cli.main(["evaluate", str(case), str(answer), "--configs", "direct,fusion", "--bootstrap-samples", "20"]) == 2
