import hashlib
import json

import pytest

from tallyframe.functions.structured import canonical_json
from tallyframe.operators import grading
from tallyframe.operators import manifest as M
from tallyframe.sources import jsonl

CASES = [
    {"id": "a", "task": "Sum 😀", "category": "c", "difficulty": "easy", "grader": {"number": {"expected": 1.0, "tolerance": 1e-7}, "exact": "x"}},
    {"id": "b", "task": "", "constraints": ["é", "b\n"], "smokeOnly": True, "grader": {"json": {"equals": {"z": 1, "a": [True, None]}}}},
    {"id": "c", "task": "t", "category": "c", "grader": {"mustInclude": [], "minLength": 3}},
    {"id": "d", "task": "t" * 5000, "category": "d"},
]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _canonical(case):
    limits = case.get("constraints") or []
    return canonical_json({
        "id": case["id"], "taskHash": _sha(case["task"]), "taskLength": len(case["task"].encode("utf-16-le")) // 2, "constraintsHash": _sha(canonical_json(limits)), "constraintsCount": len(limits),
        "category": case.get("category"), "difficulty": case.get("difficulty"), "smokeOnly": bool(case.get("smokeOnly")), "grader": case.get("grader"),
    })


@pytest.fixture
def cases(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text("".join(json.dumps(c, ensure_ascii=False) + "\n" for c in CASES))
    rows = jsonl.read_cases(spark, str(path))
    return M.canonical_cases(rows.withColumns({"tier": grading.tier(rows), "checks": grading.configured_checks(rows)}))


def test_canonical_rows_and_set(cases):
    want = [_canonical(c) for c in CASES]
    assert [r["canonical"] for r in cases.orderBy("case_index").collect()] == want
    whole = canonical_json({"fingerprintVersion": M.FINGERPRINT, "intendedUse": "dev", "cases": [json.loads(w) for w in want]})
    assert M.set_digest(cases.repartition(7), "dev") == _sha(whole)
    assert M.set_digest(cases) == _sha(canonical_json({"fingerprintVersion": M.FINGERPRINT, "cases": [json.loads(w) for w in want]}))
    assert M.set_digest(cases.limit(0), "dev") == _sha(f'{{"cases":[],"fingerprintVersion":"{M.FINGERPRINT}","intendedUse":"dev"}}')
    keyed = M.set_digest(cases, "holdout", b"k" * 32)
    assert keyed != M.set_digest(cases, "holdout", b"l" * 32) and keyed != M.set_digest(cases, "holdout")


def test_rows_show_no_labels_with_a_key(cases):
    rows = {r["publicId"]: r for r in M.manifest_rows(cases, True, True).collect()}
    assert rows["case_0001"]["graderKinds"] == ["exact", "number"] and rows["case_0002"]["graderKinds"] == [] and rows["case_0002"]["ignoredSmokeOnlyGraderKinds"] == ["json"]
    assert rows["case_0003"]["graderKinds"] == ["length"] and rows["case_0003"]["category"] == "c" and rows["case_0004"]["graderEvidenceTier"] == "ungraded"
    with pytest.raises(ValueError):
        M.manifest_rows(cases, labels=True, key=b"k" * 32)
    assert "rawLineHmacSha256" in M.manifest_rows(cases, key=b"k" * 32).columns


def test_header(spark, cases):
    head = M.header(cases, "dev", "acme-case-set-manifest-v4")
    s = head["summary"]
    assert (s["caseCount"], s["scoredCaseCount"], s["smokeOnlyCaseCount"]) == (4, 3, 1) and s["scoredCategoryBalance"]["minScoredCasesPerCategory"] == 1
    assert s["difficultyCoverage"]["scoredCasesMissingDifficultyCount"] == 2 and s["casesWithGraderKind"]["length"] == 1 and s["graderEvidence"]["ignoredSmokeOnlyConfiguredGraderKindCounts"]["json"] == 1
    assert head["claimReadiness"]["warnings"] == ["identity_only", "tuning_not_excluded", "not_a_holdout", "fewer_than_100_scored", "difficulty_missing", "difficulty_below_floor", "surface_text_evidence", "mechanical_evidence"]
    with pytest.raises(ValueError):
        M.header(cases, "holdout", "acme-case-set-manifest-v4")
    rows = [{k: v for k, v in r.asDict().items() if v is not None and k != "case_index"} for r in M.manifest_rows(cases).collect()]
    documents = [json.dumps(head | {"rows": rows}), json.dumps(head | {"rows": [rows[0] | {"graderKinds": ["odd"]}]}), json.dumps(head)]
    table = spark.createDataFrame(list(enumerate(documents)), "manifest_id int, body string")
    assert sorted(map(tuple, M.shape_findings(table).collect())) == [(1, "rows[0].graderKinds[0]", "wrong_value"), (2, "rows", "missing_key")]
    assert head["privacy"]["rowHashesAreUnsalted"]
