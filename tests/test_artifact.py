import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import artifact as A
from tallyframe.operators import shapes as S
from tests.artifacts import embedded, report


def _set(doc, path, value):
    """A copy with ``value`` at the path; ``...`` removes the key."""
    out = copy.deepcopy(doc)
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


OUTCOME = ("cases", 3, "trials", 0, "outcomes", 1)
#: name: (path, value, expected findings or None, expected blockers)
MUTATIONS = {
    "extra root key": (("extra",), 1, [("extra", "unknown_key")], ["public_report_root_shape_malformed"]),
    "no cases": (("cases",), ..., [("cases", "missing_key")], ["public_report_root_shape_malformed", "public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "note changed": (("disclosure", "notes", 1), "x", [("disclosure.notes", "wrong_value")], ["public_report_claim_gate_input_unavailable", "public_report_public_fields_malformed"]),
    "time": (("generatedAt",), "2024-13-06T07:08:09.123Z", [("generatedAt", "wrong_value")], ["public_report_public_fields_malformed"]),
    "digest shown": (("disclosure", "caseSetManifestBinding", "digest"), "abc", [("disclosure.caseSetManifestBinding.digest", "unknown_key")], ["public_report_claim_gate_input_unavailable", "public_report_public_fields_malformed"]),
    "binding absent": (("disclosure", "caseSetManifestBinding"), {"status": "not_provided"}, [], ["public_report_claim_gate_mismatch"]),
    "binding absent, more": (("disclosure", "caseSetManifestBinding"), {"status": "not_provided", "x": 1}, [("disclosure.caseSetManifestBinding.x", "unknown_key")], ["public_report_claim_gate_input_unavailable", "public_report_public_fields_malformed"]),
    "config unknown": (("configs", 0), "other", [("configs[0]", "wrong_value")], None),
    "count as text": (("metrics", "n"), "120", [("metrics.n", "wrong_type")], ["public_report_claim_gate_input_unavailable", "public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "count with fraction": (("metrics", "scored_attempt_n", "fusion"), 1.5, [("metrics.scored_attempt_n.fusion", "wrong_value")], ["public_report_claim_gate_input_unavailable", "public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "config missing": (("metrics", "task_pass_rate", "repeated"), ..., [("metrics.task_pass_rate.repeated", "missing_key")], ["public_report_claim_gate_input_unavailable", "public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "pass rate": (("metrics", "task_pass_rate", "repeated"), 0.5, [], ["public_report_case_metrics_mismatch"]),
    "pair": (("metrics", "paired_vs_direct", "fusion", "wins"), 1, [], ["public_report_case_metrics_mismatch"]),
    "harm flag": (("cases", 0, "trials", 0, "fusionHarm"), True, [], ["public_report_case_metrics_mismatch"]),
    "outcome broken": ((*OUTCOME, "failureStatus"), "timeout", [("cases[3].trials[0].outcomes[1]", "broken_rule")], ["public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "check counts": ((*OUTCOME, "grader", "checkCounts", "total"), 3, [("cases[3].trials[0].outcomes[1].grader", "broken_rule")], ["public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "check kind": ((*OUTCOME, "grader", "checks", 1, "kind"), "secret", [("cases[3].trials[0].outcomes[1].grader.checks[1].kind", "wrong_value")], ["public_report_public_fields_malformed", "public_report_case_metrics_mismatch"]),
    "category id": (("metrics", "by_category", "categories", 2, "publicCategoryId"), "secret", [("metrics.by_category.categories[2].publicCategoryId", "wrong_value")], None),
    "interval null": (("metrics", "confidence_intervals", "task_pass_rate", "fusion"), None, [], ["public_report_claim_gate_mismatch"]),
    "no gate": (("claimGate",), None, [], ["public_report_claim_gate_missing"]),
    "gate floor": (("claimGate", "minimums", "scoredCases"), 10, [], ["public_report_claim_gate_mismatch"]),
    "gate message": (("claimGate", "warnings", 0, "message"), "other words", [], []),
}


@pytest.fixture(scope="module")
def verified(spark):
    sound = report()
    docs = {name: _set(sound, path, value) for name, (path, value, _, _) in MUTATIONS.items()}
    docs["sound"] = sound
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("unread", None), ("unparsed", '{"a": '), ("list", "[]"), ("twice", '{"configs": [], "configs": []}')]
    table = spark.createDataFrame(rows, "report_id string, body string").repartition(4)
    found = {}
    for r in A.shape_findings(table).collect():
        found.setdefault(r["report_id"], []).append((r["path"], r["code"]))
    return found, {r["report_id"]: r for r in A.verify(table).collect()}


def test_sound_report_is_verified(verified):
    found, rows = verified
    assert "sound" not in found
    r = rows["sound"]
    assert r["status"] == "public_report_verified" and r["blockers"] == [] and r["gate_blockers"] == [] and r["gate_direction"] == "fusion_directionally_better"
    assert all(r[f] for f in ("root_strict", "fields_strict", "gate_input_strict", "embedded_matches", "case_metrics_consistent"))


@pytest.mark.parametrize("name", MUTATIONS)
def test_mutation(verified, name):
    found, rows = verified
    _, _, findings, blockers = MUTATIONS[name]
    assert sorted(found.get(name, [])) == sorted(findings)
    if blockers is not None:
        assert rows[name]["blockers"] == blockers
        assert (rows[name]["status"] == "public_report_verified") == (blockers == [])


def test_unreadable_documents(verified):
    _, rows = verified
    assert rows["unread"]["blockers"] == ["public_report_json_read_failed"] and rows["unparsed"]["blockers"] == ["public_report_json_parse_failed"] and rows["twice"]["blockers"] == ["public_report_json_parse_failed"]
    assert rows["list"]["blockers"][0] == "public_report_root_shape_malformed" and not rows["list"]["root_object"]
    assert rows["unread"]["warnings"] == ["public_report_verifier_public_evidence_only"]


def test_gate_codes_and_their_order(spark):
    doc = report(20, 4, 5, gate=False)
    doc["configs"] = ["direct", "fusion"]
    keep = lambda d: {k: v for k, v in d.items() if k in doc["configs"]}
    m = doc["metrics"]
    for k in ("scored_attempt_n", "scored_attempt_coverage", "task_pass_rate", "paired_vs_direct", "position_counts"):
        m[k] = keep(m[k])
    for k in ("task_pass_rate", "pass_rate_delta_vs_direct"):
        m["confidence_intervals"][k] = keep(m["confidence_intervals"][k])
    m["failure_rates"] = {k: keep(v) for k, v in m["failure_rates"].items()}
    m["failure_rates"]["timeout_rate"]["fusion"] = 0.25
    m["by_category"] = {"available": False, "suppressedReason": "no_scored_categories", "minimumScoredCasesPerCategory": 5, "recommendedScoredCasesPerCategoryForClaims": 30, "categoryIdentity": "generated-order-labels-not-anonymous"}
    m["cost_latency"] = {"available": False, "suppressedReason": "small_scored_case_count", "minimumScoredCases": 30}
    m["confidence_intervals"]["resamples"] = 60
    m["confidence_intervals"]["pass_rate_delta_vs_direct"]["fusion"] = None
    m["confidence_intervals"]["warnings"] = [A.INTERVAL_WARNINGS[1]]
    doc["disclosure"]["runProvenance"] = {"status": "not_provided"}
    doc["disclosure"]["caseSetClaimGate"] = {"status": "not_provided"}
    doc["disclosure"]["caseSetManifestBinding"]["intendedUse"] = "dev"
    for case in doc["cases"]:
        case["trials"][0]["outcomes"] = [o for o in case["trials"][0]["outcomes"] if o["configId"] in doc["configs"]]
    blockers = [
        "public_config_contract_malformed", "case_manifest_not_holdout", "case_set_claim_gate_missing", "run_provenance_missing", "confidence_interval_contract_malformed", "missing_self_review_config", "missing_repeated_config",
        "too_few_scored_cases", "category_evidence_unavailable", "fusion_pass_rate_delta_interval_unavailable", "cost_latency_suppressed",
    ]
    warnings = ["public_projection_with_private_attestations", "mechanical_grader_evidence_present", "fusion_harm_observed", "runtime_failures_present", "bootstrap_warnings_present", "private_audit_only", "fusion_advantage_not_established"]
    doc["claimGate"] = embedded(blockers, warnings, "indeterminate", None)
    r = A.verify(spark.createDataFrame([("x", json.dumps(doc))], "report_id string, body string")).first()
    assert r["gate_blockers"] == blockers and r["gate_warnings"] == warnings
    # the document is sound and says of itself that it is blocked
    assert r["blockers"] == [] and r["embedded_matches"] and r["status"] == "public_report_blocked"


def test_shape_walk_of_small_shapes(spark):
    shape = S.obj(a=S.array(S.nullable(S.COUNT), least=1), b=S.choice("kind", S.obj(kind=S.text("x")), y=S.obj(kind=S.text("y"), more=S.BOOL)), c=S.record(S.NUMBER, ("p", "q")))
    docs = ['{"a":[1,null,2.0],"b":{"kind":"y","more":true},"c":{"p":1e3}}', '{"a":[],"b":{"kind":"y"},"c":{"r":1}}', '{"a":[-1,true],"b":{"kind":"z"},"c":{"p":"1"}}', '{"a":null,"b":7,"c":[]}', "null"]
    table = spark.createDataFrame(list(enumerate(docs)), "id int, body string").withColumn("v", F.parse_json("body")).withColumn("keys", F.array().cast("array<string>"))
    got = sorted(map(tuple, S.findings(table, shape, "id", "v", "keys").collect()))
    assert got == [
        (1, "a", "wrong_value"), (1, "b.more", "missing_key"), (1, "c.r", "unknown_key"), (2, "a[0]", "wrong_value"), (2, "a[1]", "wrong_type"), (2, "b.kind", "wrong_value"), (2, "c.p", "wrong_type"),
        (3, "a", "wrong_type"), (3, "b", "wrong_type"), (3, "c", "wrong_type"), (4, "", "wrong_type"),
    ]
    assert S.findings(table.limit(0), shape, "id", "v", "keys").collect() == []


def test_shape_walk_makes_no_row_of_a_node(spark):
    """A document is one row until its findings are known, however deep its shape, so the plan has one Generate."""
    rule = S.obj("even", n=S.COUNT)
    shape = S.array(S.obj(x=S.record(S.text("it's", "a\\b")), y=S.array(rule), optional=("y",)), least=1)
    docs = ['[{"x":{"p":"it\'s","q":"a\\\\b"},"y":[{"n":2},{"n":3}]}]', '[{"x":{"p":"its","z.z":1}},7]', "[]", '[{"x":null,"y":{}}]']
    table = spark.createDataFrame(list(enumerate(docs)), "id int, body string").withColumn("v", F.parse_json("body")).withColumn("keys", F.when(F.col("id") < 3, F.array(F.lit("p"), F.lit("q"))))
    found = S.findings(table, shape, "id", "v", "keys", {"even": lambda v: F.try_variant_get(v, "$.n", "int") % 2 == 0})
    assert sorted(map(tuple, found.collect())) == [
        (0, "[0].y[1]", "broken_rule"), (1, "[0].x.p", "wrong_value"), (1, "[0].x.q", "missing_key"), (1, "[0].x.z.z", "unknown_key"), (1, "[1]", "wrong_type"),
        (2, "", "wrong_value"), (3, "[0].x", "wrong_type"), (3, "[0].y", "wrong_type"),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_command_verifies_a_file(spark, tmp_path, capsys):
    from tallyframe import cli

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(report(), indent=1))
    bad.write_text("{")
    assert cli.main(["verify-public-report", str(good)]) == 0 and json.loads(capsys.readouterr().out)["status"] == "public_report_verified"
    assert cli.main(["verify-public-report", str(bad)]) == 2 and json.loads(capsys.readouterr().out)["blockers"] == ["public_report_json_parse_failed"]
    assert cli.main(["verify-public-report", str(tmp_path / "none.json")]) == 2 and json.loads(capsys.readouterr().out)["blockers"] == ["public_report_json_read_failed"]
