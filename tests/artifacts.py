"""A public report document for tests, sound in all its parts."""

from __future__ import annotations

from tallyframe.operators import artifact as A

C = list(A.CONFIGS)


def _rate(n: int, d: int) -> float | None:
    return None if d == 0 else int(n / d * 10000 + 0.5) / 10000


def _all(value) -> dict:
    return {c: value for c in C}


def report(n_cases: int = 120, categories: int = 4, direct_fails: int = 20, gate: bool = True) -> dict:
    """Every case passes everywhere, but for the first ``direct_fails`` cases of direct and the last two of fusion."""
    passed = lambda c, i: not (c == "direct" and i < direct_fails) and not (c == "fusion" and i >= n_cases - 2)
    cases = []
    for i in range(n_cases):
        outcomes = []
        for c in C:
            ok = passed(c, i)
            grader = {"passed": ok, "smokeOnly": False, "checkCounts": {"total": 2, "passed": 1 + ok, "failed": 1 - ok}, "checks": [{"checkIndex": 0, "kind": "exact", "passed": True}, {"checkIndex": 1, "kind": "choice_valid", "passed": ok}]}
            outcomes.append({"configId": c, "status": "completed", "passed": ok, "grader": grader})
        cases.append({"publicId": f"case_{i + 1:04}", "smokeOnly": False, "trials": [{"trialIndex": 0, "fusionHarm": passed("direct", i) and not passed("fusion", i), "outcomes": outcomes}]})
    count = {c: sum(passed(c, i) for i in range(n_cases)) for c in C}
    pair = lambda c: {"paired_n": n_cases, "unpaired_n": 0, "wins": sum(passed(c, i) > passed("direct", i) for i in range(n_cases)), "losses": sum(passed(c, i) < passed("direct", i) for i in range(n_cases))}
    pairs = {c: pair(c) for c in C}
    for p in pairs.values():
        p |= {"ties": n_cases - p["wins"] - p["losses"], "pass_rate_delta": _rate(p["wins"] - p["losses"], n_cases), "harm_rate": _rate(p["losses"], n_cases)}
    tiers = lambda n: {"structured_or_exact": n, "surface_text": 0, "mixed": 0, "smoke_only": 0, "ungraded": 0}
    profile = lambda n: {"version": A.TIER_VERSION, "tier_counts": tiers(n), "dominant_tier": "structured_or_exact", "dominant_tier_case_share": 1, "profile_mix": "single_tier", "small_profile_cell_warning": False, "minimum_profile_cell_size": 5}
    interval = {"low": 0.5, "high": 0.9}
    each = n_cases // categories
    category = lambda i: {
        "publicCategoryId": f"category_{i + 1:04}", "scored_case_n": each, "scored_trial_n": each, "scored_attempt_n_by_config": _all(each), "passed_attempt_n_by_config": _all(each), "passRateDenominator": "scored_attempts",
        "task_pass_rate": _all(1), "task_pass_rate_interval": _all(interval), "pass_rate_delta_interval_vs_direct": _all(None), "fusion_harm_rate": None, "pairedDenominator": "case_trials", "paired_vs_direct": pairs,
        "belowRecommendedScoredCases": each < 30, "claimReadiness": "descriptive_only", "grader_evidence": profile(each), "observed_runtime_check_kind_case_counts": {"exact": each},
    }
    floors = {"minimumScoredCasesPerCategory": 5, "recommendedScoredCasesPerCategoryForClaims": 30, "categoryIdentity": "generated-order-labels-not-anonymous"}
    seen = {"status": "private_report_fields_present", "digestDisclosure": "omitted"}
    out = {
        "schemaVersion": "acme-public-eval-v11",
        "generatedAt": "2024-05-06T07:08:09.123Z",
        "disclosure": {
            "modelDisclosure": "redacted", "priceDisclosure": "redacted", "promptDisclosure": "redacted", "caseIdentity": "generated-row-labels", "traceDisclosure": "omitted", "reproducibilityLevel": "private-audit-only",
            "caseSetManifestBinding": {"status": "private_report_bound", "schemaVersion": "acme-case-set-manifest-v4", "fingerprintVersion": A.FINGERPRINT, "canonicalization": A.CANONICAL, "content": A.MANIFEST_CONTENT, "intendedUse": "holdout",
                "hashAlgorithm": "hmac-sha256", "privacyClass": "private_audit_hmac_sha256", "digestDisclosure": "omitted"},
            "caseSetClaimGate": {"status": "private_report_constraints_met", "target": "public_cost_performance", "scope": "case_set_only", "overallClaimStatus": "external_evidence_required", "detailDisclosure": "omitted"},
            "runProvenance": {"status": "private_report_fields_present", "schemaVersion": "acme-run-provenance-v2", "fingerprintVersion": A.PROVENANCE_FINGERPRINT, "canonicalization": A.CANONICAL, "evaluatedConfigCount": 4,
                "config": {**seen, "content": "resolved-acme-config-v2", "pathDisclosure": "omitted"}, "modelPriceSnapshot": {**seen, "content": A.PRICE_CONTENT, "pathDisclosure": "omitted"},
                "openRouterRequestPolicy": {**seen, "content": A.POLICY_CONTENT}, "providerRouting": {"status": "private_report_fields_present", "content": A.ROUTING_CONTENT, "providerEndpointPinning": A.PINNINGS[0], "detailDisclosure": "omitted"}},
            "notes": list(A.DISCLOSURE_NOTES),
        },
        "evaluationDesign": {"trialsPerCase": 1, "schedule": "case-trial-rotation-v1", "bootstrapSamples": 500, "confidenceLevel": 0.95},
        "configs": C,
        "claimReadiness": {"status": "not_benchmark", "warnings": list(A.READINESS_WARNINGS)},
        "claimGate": None,
        "metrics": {
            "n": n_cases, "scored_n": n_cases, "trials_per_case": 1, "scored_trial_n": n_cases, "scored_attempt_n": _all(n_cases),
            "scored_attempt_coverage": _all({"expected_scored_case_trial_n": n_cases, "observed_scored_attempt_n": n_cases, "incomplete_scored_case_trial_n": 0, "complete": n_cases > 0}),
            "task_pass_rate": {c: _rate(count[c], n_cases) for c in C}, "fusion_harm_rate": pairs["fusion"]["harm_rate"], "paired_vs_direct": pairs, "position_counts": _all({"all": [1, 2], "scored": []}),
            "confidence_intervals": {"method": A.METHOD, "level": 0.95, "resamples": 500, "warnings": [], "task_pass_rate": _all(interval), "pass_rate_delta_vs_direct": _all({"low": 0.02, "high": 0.3})},
            "grader_evidence": {**profile(n_cases), "scored_tier_counts": tiers(n_cases), "smoke_only_case_n": 0, "notes": list(A.EVIDENCE_NOTES)},
            "by_category": {"available": True, **floors, "confidence_intervals": {"method": A.METHOD, "level": 0.95, "resamples": 500, "metrics": ["task_pass_rate", "pass_rate_delta_vs_direct"], "scope": "within_category"}, "notes": list(A.CATEGORY_NOTES),
                "categories": [category(i) for i in range(categories)]},
            "failure_rates": {f: _all(0) for f in A._FAILURES},
            "cost_latency": {"available": True, "precision": {"costUsdDecimals": 4, "latencyMsBucket": 100}, "cost_per_pass_usd": _all(0.1), "cost_per_pass_interval_usd": _all({"low": 0.1, "high": 0.2, "available": True, "undefinedRate": 0}),
                "mean_cost_per_scored_attempt_usd": _all(0.1), "total_cost_usd": _all(3.5), "p50_latency_ms": _all(100), "p95_latency_ms": _all(900)},
        },
        "cases": cases,
    }
    if gate:
        out["claimGate"] = embedded([], ["public_projection_with_private_attestations", "mechanical_grader_evidence_present", "fusion_harm_observed", "private_audit_only", "run_provenance_private_audit_only"], "fusion_directionally_better", {"low": 0.02, "high": 0.3})
    return out


def embedded(blockers: list[str], warnings: list[str], direction: str, delta: dict | None) -> dict:
    return {
        "target": "public_cost_performance", "scope": "public_projection_with_private_attestations", "status": "public_report_blocked" if blockers else "public_report_constraints_met", "overallClaimStatus": "external_evidence_required",
        "minimums": {"scoredCases": 100, "scoredCasesPerCategory": 30, "nonSurfaceGraderEvidenceCases": 5, "nonSurfaceGraderEvidenceCasesPerCategory": 5},
        "directionalComparison": {"status": direction, "passRateDeltaVsDirect": delta}, "blockers": [{"code": b, "message": "m"} for b in blockers], "warnings": [{"code": w} for w in warnings],
    }
