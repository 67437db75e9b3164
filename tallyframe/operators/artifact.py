"""The public report as one JSON document: its declared shape, its rows against its figures, and its gate, recomputed.

``verify`` takes a table of documents (one row each) and returns one row each; nothing in a document is trusted. All is
declared over a Variant column: shapes by ``shapes.findings``, figures by typed extraction, gate rules by expressions.

Messages and evidence texts of an embedded gate are not compared; its codes in their order, its status, target, scope,
floors and directional comparison are. Of a key that a document holds twice the parser refuses the whole document, as one
that is no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import round_half_up
from tallyframe.operators.shapes import ANY, BOOL, COUNT, NUMBER, POSITIVE, Shape, array, choice, exactly, findings, flag, nullable, number, obj, record, text

# Fixed values that a public report must hold. The versions of schemas begin with the producer's name, which is free here.
CONFIGS = ("direct", "self_review", "repeated", "fusion")
REPORT_VERSION = "^[a-z0-9]+(-[a-z0-9]+)*-public-eval-v11$"
MANIFEST_VERSION = "^[a-z0-9]+(-[a-z0-9]+)*-case-set-manifest-v4$"
PROVENANCE_VERSION = "^[a-z0-9]+(-[a-z0-9]+)*-run-provenance-v2$"
CONFIG_CONTENT = "^resolved-[a-z0-9]+(-[a-z0-9]+)*-config-v2$"
FINGERPRINT, PROVENANCE_FINGERPRINT, CANONICAL = "case-set-canonical-v3", "run-provenance-v2", "json-sorted-v1"
MANIFEST_CONTENT = "validated-eval-case-set-with-hashed-prompts-and-difficulty-v1"
PRICE_CONTENT, POLICY_CONTENT, ROUTING_CONTENT = "effective-model-price-snapshot-v1", "openrouter-fixed-baseline-request-policy-v1", "openrouter-provider-routing-policy-v1"
PINNINGS = ("single_provider_endpoint_pinned", "not_configured", "fallbacks_allowed", "multiple_provider_endpoints_allowed", "base_provider_slug_only")
TIERS = ("structured_or_exact", "surface_text", "mixed", "smoke_only", "ungraded")
TIER_VERSION = "grader-evidence-tier-v2"
METHOD, LEVEL, RESAMPLES = "case_cluster_bootstrap", 0.95, 500
SCORED_CASES, CATEGORY_CASES, EVIDENCE_CASES = 100, 30, 5
CHECK_KINDS = (
    "exact", "exact_normalized", "must_include", "contains_any", "must_not_include", "regex", "min_length", "max_length", "choice_valid", "choice_expected",
    "json_valid", "json_required_path", "json_equals", "json_includes", "json_array_min_length", "json_schema_subset", "json_check", "number_found",
    "number_expected", "number_min", "number_max", "citation_allowed_sources", "citation_required_source", "citation_min_sources", "citation_required_claim",
    "answer_size", "grader_configured", "smoke_only", "run_completed", "other_check",
)
DISCLOSURE_NOTES = (
    "This public report is an allowlisted projection of a private evaluation report.",
    "Model identities, provider identities, price snapshots, prompts, answers, traces, usage rows, and raw case identifiers are omitted.",
    "Per-case generated row labels preserve report order; when the evaluated case file is public, row-level outcomes can be linked back to that public file.",
    "The private report is required to reproduce model/provider provenance, run-provenance fingerprints, case-manifest binding, and exact cost accounting; no private report hash, case-set digest, config digest, model digest, path, or command is included in this public artifact.",
)
READINESS_WARNINGS = (
    "This public report is not evidence that the evaluated case set is a locked holdout or public benchmark.",
    "Interpret pass-rate, harm, and cost metrics together with a separate case-set manifest and private audit evidence.",
    "Category breakdowns are descriptive stratification only; generated category labels are pseudonymous and may be linkable through public case manifests.",
)
CATEGORY_NOTES = (
    "Generated category IDs preserve first appearance order and are not anonymous.",
    "Trials are repeated attempts over the same cases; do not interpret trial counts as independent case counts.",
    "Category differences can be confounded by grader mix, difficulty, and prompt tuning.",
    "Grader evidence tiers are heuristic case-definition metadata, not task difficulty or semantic-grading strength.",
    "Rows below the recommended scored-case count are published only as exploratory stratification.",
    "Category-level task pass-rate and pass-rate-delta intervals resample cases within each category; category-level cost intervals are not included in the public projection.",
)
EVIDENCE_NOTES = (
    "Tiers are derived from configured deterministic grader families before model calls.",
    "They describe mechanical evidence shape, not task difficulty, holdout status, or semantic grading strength.",
)
INTERVAL_WARNINGS = ("No scored cases; confidence intervals are degenerate.", "Fewer than 30 scored cases; bootstrap intervals are exploratory.")
# End of the fixed values.

_PRESENT, _OMITTED = text("private_report_fields_present"), text("omitted")
_ABSENT = obj(status=text("not_provided"), optional=("status",))
_LEVEL, _METHOD = nullable(number(LEVEL)), nullable(text(METHOD))
_INTERVAL = nullable(obj(low=NUMBER, high=NUMBER))
_PAIR = obj(paired_n=COUNT, unpaired_n=COUNT, wins=COUNT, losses=COUNT, ties=COUNT, pass_rate_delta=nullable(NUMBER), harm_rate=nullable(NUMBER))
_TIER_COUNTS = obj(**{t: COUNT for t in TIERS})
_PROFILE = {
    "version": text(TIER_VERSION), "tier_counts": _TIER_COUNTS, "dominant_tier": nullable(text(*TIERS)), "dominant_tier_case_share": nullable(NUMBER),
    "profile_mix": text("single_tier", "mixed_tiers", "no_scored_cases"), "small_profile_cell_warning": BOOL, "minimum_profile_cell_size": COUNT,
}
_FLOORS = {"minimumScoredCasesPerCategory": COUNT, "recommendedScoredCasesPerCategoryForClaims": COUNT, "categoryIdentity": text("generated-order-labels-not-anonymous")}

MANIFEST_BINDING = choice(
    "status",
    obj(
        status=text("private_report_bound"), schemaVersion=text(pattern=MANIFEST_VERSION), fingerprintVersion=text(FINGERPRINT), canonicalization=text(CANONICAL), content=text(MANIFEST_CONTENT),
        intendedUse=text("dev", "public_sample", "holdout"), hashAlgorithm=text("sha256", "hmac-sha256"), privacyClass=text("public_or_frozen_sha256", "private_audit_hmac_sha256"), digestDisclosure=_OMITTED,
    ),
    not_provided=_ABSENT,
)
CASE_GATE = choice(
    "status",
    obj(
        status=text("private_report_constraints_met", "private_report_blocked"), target=text("public_cost_performance"), scope=text("case_set_only"),
        overallClaimStatus=text("external_evidence_required"), detailDisclosure=_OMITTED,
    ),
    not_provided=_ABSENT,
)
PROVENANCE = choice(
    "status",
    obj(
        status=_PRESENT, schemaVersion=text(pattern=PROVENANCE_VERSION), fingerprintVersion=text(PROVENANCE_FINGERPRINT), canonicalization=text(CANONICAL), evaluatedConfigCount=COUNT,
        config=obj(status=_PRESENT, content=text(pattern=CONFIG_CONTENT), digestDisclosure=_OMITTED, pathDisclosure=_OMITTED),
        modelPriceSnapshot=obj(status=_PRESENT, content=text(PRICE_CONTENT), digestDisclosure=_OMITTED, pathDisclosure=_OMITTED),
        openRouterRequestPolicy=choice("status", obj(status=_PRESENT, content=text(POLICY_CONTENT), digestDisclosure=_OMITTED), not_provided=_ABSENT),
        providerRouting=choice("status", obj(status=_PRESENT, content=text(ROUTING_CONTENT), providerEndpointPinning=text(*PINNINGS), detailDisclosure=_OMITTED), not_provided=_ABSENT),
    ),
    not_provided=_ABSENT,
)
DISCLOSURE = obj(
    modelDisclosure=text("redacted"), priceDisclosure=text("redacted"), promptDisclosure=text("redacted"), caseIdentity=text("generated-row-labels"), traceDisclosure=_OMITTED,
    reproducibilityLevel=text("private-audit-only"), caseSetManifestBinding=MANIFEST_BINDING, caseSetClaimGate=CASE_GATE, runProvenance=PROVENANCE, notes=exactly(*DISCLOSURE_NOTES),
)
DESIGN = obj(trialsPerCase=POSITIVE, schedule=text("case-trial-rotation-v1"), bootstrapSamples=COUNT, confidenceLevel=number(LEVEL))
READINESS = obj(status=text("not_benchmark"), warnings=exactly(*READINESS_WARNINGS))
_CATEGORY = obj(
    publicCategoryId=text(pattern="^category_[0-9]{4}$"), scored_case_n=COUNT, scored_trial_n=COUNT, scored_attempt_n_by_config=record(COUNT), passed_attempt_n_by_config=record(COUNT),
    passRateDenominator=text("scored_attempts"), task_pass_rate=record(nullable(NUMBER)), task_pass_rate_interval=record(_INTERVAL), pass_rate_delta_interval_vs_direct=record(_INTERVAL),
    fusion_harm_rate=nullable(NUMBER), pairedDenominator=text("case_trials"), paired_vs_direct=record(_PAIR), belowRecommendedScoredCases=BOOL,
    claimReadiness=text("descriptive_only", "exploratory_underpowered"), grader_evidence=obj(**_PROFILE), observed_runtime_check_kind_case_counts=record(COUNT, CHECK_KINDS),
)
BY_CATEGORY = choice(
    "available",
    obj(
        available=flag(True), confidence_intervals=obj(method=_METHOD, level=_LEVEL, resamples=nullable(COUNT), metrics=exactly("task_pass_rate", "pass_rate_delta_vs_direct"), scope=text("within_category")),
        notes=exactly(*CATEGORY_NOTES), categories=array(_CATEGORY), **_FLOORS,
    ),
    false=obj(available=flag(False), suppressedReason=text("no_scored_categories", "uncategorized_scored_cases", "small_scored_case_count_per_category"), **_FLOORS),
)
_FAILURES = ("invalid_output_rate", "timeout_rate", "provider_error_rate", "budget_exhaustion_rate", "partial_failure_rate", "verification_failure_rate", "smoke_completion_rate")
COSTS = choice(
    "available",
    obj(
        available=flag(True), precision=obj(costUsdDecimals=COUNT, latencyMsBucket=POSITIVE), cost_per_pass_usd=record(nullable(NUMBER)),
        cost_per_pass_interval_usd=record(obj(low=nullable(NUMBER), high=nullable(NUMBER), available=BOOL, undefinedRate=NUMBER)),
        mean_cost_per_scored_attempt_usd=record(nullable(NUMBER)), total_cost_usd=record(NUMBER), p50_latency_ms=record(NUMBER), p95_latency_ms=record(NUMBER),
    ),
    false=obj(available=flag(False), suppressedReason=text("small_scored_case_count"), minimumScoredCases=COUNT),
)
METRICS = obj(
    n=COUNT, scored_n=COUNT, trials_per_case=POSITIVE, scored_trial_n=COUNT, scored_attempt_n=record(COUNT),
    scored_attempt_coverage=record(obj(expected_scored_case_trial_n=COUNT, observed_scored_attempt_n=COUNT, incomplete_scored_case_trial_n=COUNT, complete=BOOL)),
    task_pass_rate=record(nullable(NUMBER)), fusion_harm_rate=nullable(NUMBER), paired_vs_direct=record(_PAIR), position_counts=record(obj(all=array(COUNT), scored=array(COUNT))),
    confidence_intervals=obj(
        method=_METHOD, level=_LEVEL, resamples=nullable(COUNT), warnings=array(text(*INTERVAL_WARNINGS)), task_pass_rate=record(_INTERVAL), pass_rate_delta_vs_direct=record(_INTERVAL)
    ),
    grader_evidence=obj(scored_tier_counts=_TIER_COUNTS, smoke_only_case_n=COUNT, notes=exactly(*EVIDENCE_NOTES), **_PROFILE),
    by_category=BY_CATEGORY, failure_rates=obj(**{f: record(NUMBER) for f in _FAILURES}), cost_latency=COSTS,
)
GRADER = obj(
    "grader", passed=BOOL, smokeOnly=BOOL, checkCounts=obj(total=COUNT, passed=COUNT, failed=COUNT), checks=array(obj(checkIndex=COUNT, kind=text(*CHECK_KINDS), passed=BOOL), least=1)
)
OUTCOME = obj(
    "outcome", ("degraded", "failureStatus"), configId=text(*CONFIGS), status=text("completed", "failed"), passed=BOOL, degraded=BOOL,
    failureStatus=text("ok", "timeout", "provider_error", "invalid_output", "budget_exhausted"), grader=GRADER,
)
CASE = obj(publicId=text(pattern="^case_[0-9]{4}$"), smokeOnly=BOOL, trials=array(obj(trialIndex=COUNT, fusionHarm=BOOL, outcomes=array(OUTCOME))))
_TIME = "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9][.][0-9]{3}Z$"
REPORT = obj(
    schemaVersion=text(), generatedAt=text(pattern=_TIME), disclosure=DISCLOSURE, evaluationDesign=DESIGN, configs=array(text(*CONFIGS), least=1), claimReadiness=READINESS,
    claimGate=nullable(ANY), metrics=METRICS, cases=array(CASE),
)


def _get(v: str, path: str, kind: str) -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def grader_sound(v: Column) -> Column:
    """Counts are those of the checks, and the grader passed if and only if all checks did."""
    checks = F.try_variant_get(v, "$.checks", "array<struct<passed:boolean>>")
    count = lambda k: F.try_variant_get(v, f"$.checkCounts.{k}", "double")
    n, good = F.size(checks), F.size(F.filter(checks, lambda c: F.coalesce(c["passed"], F.lit(False))))
    return (count("total") == n) & (count("passed") == good) & (count("failed") == n - good) & (F.try_variant_get(v, "$.passed", "boolean") == (n == good))


def outcome_sound(v: Column) -> Column:
    """Passed means completed, without failure status, by the grader too; failed means not passed, with one; a failure status means failed."""
    get = lambda p, t="string": F.try_variant_get(v, f"$.{p}", t)
    passed, status, failure, graded = get("passed", "boolean"), get("status"), get("failureStatus"), get("grader.passed", "boolean")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    as_passed = ~passed | ((status == "completed") & failure.isNull() & ~no(graded))
    as_failed = (status != "failed") | (~passed & failure.isNotNull() & no(graded))
    return as_passed & as_failed & (failure.isNull() | ((status == "failed") & ~passed))


RULES = {"grader": grader_sound, "outcome": outcome_sound}

_BOUNDS = "STRUCT<low:DOUBLE,high:DOUBLE>"
_FIGURES = (
    "STRUCT<n:DOUBLE,scored_n:DOUBLE,scored_trial_n:DOUBLE,scored_attempt_n:MAP<STRING,DOUBLE>,"
    "scored_attempt_coverage:MAP<STRING,STRUCT<expected_scored_case_trial_n:DOUBLE,observed_scored_attempt_n:DOUBLE,incomplete_scored_case_trial_n:DOUBLE,complete:BOOLEAN>>,"
    "task_pass_rate:MAP<STRING,DOUBLE>,fusion_harm_rate:DOUBLE,paired_vs_direct:MAP<STRING,STRUCT<paired_n:DOUBLE,unpaired_n:DOUBLE,wins:DOUBLE,losses:DOUBLE,ties:DOUBLE,pass_rate_delta:DOUBLE,harm_rate:DOUBLE>>,"
    f"confidence_intervals:STRUCT<method:STRING,level:DOUBLE,resamples:DOUBLE,warnings:ARRAY<STRING>,task_pass_rate:MAP<STRING,{_BOUNDS}>,pass_rate_delta_vs_direct:MAP<STRING,{_BOUNDS}>>,"
    "grader_evidence:STRUCT<scored_tier_counts:MAP<STRING,DOUBLE>>,by_category:STRUCT<available:BOOLEAN,categories:ARRAY<STRUCT<scored_case_n:DOUBLE,belowRecommendedScoredCases:BOOLEAN,grader_evidence:STRUCT<tier_counts:MAP<STRING,DOUBLE>>>>>,"
    "failure_rates:STRUCT<" + ",".join(f"{f}:MAP<STRING,DOUBLE>" for f in _FAILURES) + ">,"
    "cost_latency:STRUCT<available:BOOLEAN,cost_per_pass_interval_usd:MAP<STRING,STRUCT<low:DOUBLE,high:DOUBLE,available:BOOLEAN>>>>"
)
_ROWS = "ARRAY<STRUCT<smokeOnly:BOOLEAN,trials:ARRAY<STRUCT<fusionHarm:BOOLEAN,outcomes:ARRAY<STRUCT<configId:STRING,passed:BOOLEAN,grader:STRUCT<smokeOnly:BOOLEAN>>>>>>>"


def parsed(documents: DataFrame, id_col: str = "report_id", body_col: str = "body") -> DataFrame:
    """id, v (null if the body is no JSON object) and configs (null unless a list of known configurations)."""
    v = F.expr(f"try_parse_json(`{body_col}`)")
    is_object = F.expr("v IS NOT NULL AND try_variant_get(v, '$', 'map<string,variant>') IS NOT NULL")
    named = F.expr(f"transform({_get('v', 'configs', 'array<variant>')}, c -> IF(schema_of_variant(c) = 'STRING', try_variant_get(c, '$', 'string'), NULL))")
    known = F.size(named) > 0
    known = known & F.forall(named, lambda c: F.coalesce(c.isin(*CONFIGS), F.lit(False)))
    rows = documents.select(F.col(f"`{id_col}`").alias("report_id"), v.alias("v"))
    return rows.withColumn("parses", F.col("v").isNotNull()).withColumn("root_object", is_object).withColumn("configs", F.when(F.col("root_object") & F.coalesce(known, F.lit(False)), named))


def shape_findings(documents: DataFrame, id_col: str = "report_id", body_col: str = "body", shape: Shape = REPORT) -> DataFrame:
    """report_id, path, code of every departure from ``shape``."""
    return findings(parsed(documents, id_col, body_col), shape, "report_id", "v", "configs", RULES)


def recount(sound: DataFrame) -> DataFrame:
    """report_id and the figures that the public rows give: counts by configuration, and the pair of fusion and direct.

    ``sound`` has report_id and v whose cases have their shape.
    """
    cases = sound.select("report_id", F.explode_outer(F.expr(_get("v", "cases", _ROWS))).alias("c"))
    trials = cases.select("report_id", (F.col("c").isNotNull()).alias("is_case"), (F.col("c").isNotNull() & ~F.col("c.smokeOnly")).alias("scored"), F.posexplode_outer("c.trials").alias("at", "t"))
    of = lambda config: F.filter("t.outcomes", lambda o: (o["configId"] == config) & ~o["grader"]["smokeOnly"])
    live = F.col("scored") & F.col("t").isNotNull()
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    aggs = [count(F.col("is_case") & F.coalesce(F.col("at") == 0, F.lit(True))).alias("cases"), count(F.col("scored") & F.coalesce(F.col("at") == 0, F.lit(True))).alias("scored_cases"), count(live).alias("trials")]
    for c in CONFIGS:
        aggs += [
            F.coalesce(F.sum(F.when(live, F.size(of(c)))), F.lit(0)).alias(f"n_{c}"),
            F.coalesce(F.sum(F.when(live, F.size(F.filter(of(c), lambda o: o["passed"])))), F.lit(0)).alias(f"p_{c}"),
            count(live & (F.size(of(c)) != 1)).alias(f"x_{c}"),
        ]
    direct, fusion = F.get(of("direct"), 0), F.get(of("fusion"), 0)
    both = live & direct.isNotNull() & fusion.isNotNull()
    by_direct, by_fusion = F.coalesce(direct["passed"], F.lit(False)), F.coalesce(fusion["passed"], F.lit(False))
    harm = by_direct & ~by_fusion
    aggs += [
        count(both).alias("paired"), count(live & ~(direct.isNotNull() & fusion.isNotNull())).alias("unpaired"), count(both & by_fusion & ~by_direct).alias("wins"),
        count(both & harm).alias("losses"), count(live & (F.col("t.fusionHarm") != harm)).alias("wrong_harms"),
    ]
    return trials.groupBy("report_id").agg(*aggs)


CONSISTENT = ("case_count", "scored_case_count", "scored_trial_count", "scored_attempt_counts", "scored_attempt_coverage", "task_pass_rates", "fusion_pairing", "fusion_harm")


def consistency(sound: DataFrame) -> DataFrame:
    """report_id and a flag for each of CONSISTENT, of documents whose metrics and cases have their shape."""
    c = F.col
    figures = sound.select("report_id", "configs", F.expr(_get("v", "metrics", _FIGURES)).alias("m"))
    both = figures.join(recount(sound), "report_id")
    ran = lambda k: F.array_contains("configs", k)
    every = lambda test: F.forall(F.array(*[~ran(k) | F.coalesce(test(k), F.lit(False)) for k in CONFIGS]), lambda x: x)
    cover = lambda k: c("m.scored_attempt_coverage")[k]
    rate = lambda k: F.when(c(f"n_{k}") > 0, round_half_up(c(f"p_{k}") / c(f"n_{k}"), 4))
    share = lambda x: F.when(c("paired") > 0, round_half_up(x / c("paired"), 4))
    pair, either = c("m.paired_vs_direct")["fusion"], ~(ran("direct") & ran("fusion"))
    whole = F.coalesce(
        (pair["paired_n"] == c("paired")) & (pair["unpaired_n"] == c("unpaired")) & (pair["wins"] == c("wins")) & (pair["losses"] == c("losses")) & (pair["ties"] == c("paired") - c("wins") - c("losses")), F.lit(False)
    )
    flags = [
        c("cases") == c("m.n"),
        c("scored_cases") == c("m.scored_n"),
        c("trials") == c("m.scored_trial_n"),
        every(lambda k: c("m.scored_attempt_n")[k] == c(f"n_{k}")),
        every(
            lambda k: (cover(k)["expected_scored_case_trial_n"] == c("trials")) & (cover(k)["observed_scored_attempt_n"] == c(f"n_{k}")) & (cover(k)["incomplete_scored_case_trial_n"] == c(f"x_{k}"))
            & (cover(k)["complete"] == ((c("trials") > 0) & (c(f"x_{k}") == 0)))
        ),
        every(lambda k: c("m.task_pass_rate")[k].eqNullSafe(rate(k))),
        either | (whole & pair["pass_rate_delta"].eqNullSafe(share(c("wins") - c("losses"))) & pair["harm_rate"].eqNullSafe(share(c("losses")))),
        either | (c("m.fusion_harm_rate").eqNullSafe(share(c("losses"))) & (c("wrong_harms") == 0)),
    ]
    return both.select("report_id", *[f.alias(name) for f, name in zip(flags, CONSISTENT, strict=True)])


def gate(sound: DataFrame) -> DataFrame:
    """report_id, blockers, warnings (codes in their order) and direction, of documents whose disclosure and metrics have their shape.

    Rules on a disclosure's shape can't fire on one that has it, so those left are the rules on what it says.
    """
    c, lit = F.col, F.lit
    said = lambda p: F.expr(_get("v", f"disclosure.{p}", "string"))
    rows = sound.select("report_id", "configs", F.expr(_get("v", "schemaVersion", "string")).alias("version"), F.expr(_get("v", "metrics", _FIGURES)).alias("m"), F.expr(_get("v", "disclosure.runProvenance.evaluatedConfigCount", "double")).alias("run_configs"),
        *[said(p).alias(a) for a, p in {"bound": "caseSetManifestBinding.status", "use": "caseSetManifestBinding.intendedUse", "hash": "caseSetManifestBinding.hashAlgorithm", "privacy": "caseSetManifestBinding.privacyClass", "cases": "caseSetClaimGate.status",
          "run": "runProvenance.status", "policy": "runProvenance.openRouterRequestPolicy.status", "pinned": "runProvenance.providerRouting.providerEndpointPinning"}.items()])
    ran = {k: F.array_contains("configs", k) for k in CONFIGS}
    present, bound = c("run") == "private_report_fields_present", c("bound") == "private_report_bound"
    iv, categories, shown = c("m.confidence_intervals"), c("m.by_category.categories"), c("m.by_category.available")
    tiers = c("m.grader_evidence.scored_tier_counts")
    beyond = lambda t: t["structured_or_exact"] + t["mixed"]
    small = lambda g: g["scored_case_n"] < CATEGORY_CASES
    some = shown & (F.size(categories) > 0)
    rules: list[tuple[str, Column]] = [
        ("public_config_contract_malformed", (F.size("configs") != len(CONFIGS)) | (F.size(F.array_distinct("configs")) != len(CONFIGS))),
        ("public_report_schema_version_unsupported", ~c("version").rlike(REPORT_VERSION)),
        ("case_manifest_binding_missing", c("bound") == "not_provided"),
        ("case_manifest_not_holdout", bound & (c("use") != "holdout")),
        ("case_manifest_not_private_audit_hmac", bound & ((c("hash") != "hmac-sha256") | (c("privacy") != "private_audit_hmac_sha256"))),
        ("case_set_claim_gate_missing", c("cases") == "not_provided"),
        ("case_set_claim_gate_blocked", c("cases") == "private_report_blocked"),
        ("run_provenance_missing", c("run") == "not_provided"),
        ("openrouter_request_policy_missing", present & (c("policy") != "private_report_fields_present")),
        ("provider_endpoint_pinning_missing", present & (F.coalesce("pinned", lit("")) != PINNINGS[0])),
        ("run_provenance_config_count_mismatch", present & ((c("run_configs") != F.size("configs")) | (c("run_configs") != len(CONFIGS)))),
        ("confidence_interval_contract_malformed", ~(iv["method"].eqNullSafe(lit(METHOD)) & iv["level"].eqNullSafe(lit(LEVEL)) & (F.coalesce(iv["resamples"], lit(0)) >= RESAMPLES))),
        *[(f"missing_{k}_config", ~ran[k]) for k in CONFIGS],
        ("too_few_scored_cases", c("m.scored_n") < SCORED_CASES),
        ("category_evidence_unavailable", ~shown),
        ("category_evidence_empty", shown & ~some),
        ("category_underpowered", some & F.exists(categories, small)),
        ("category_non_surface_grader_evidence_underpowered", some & F.exists(categories, lambda g: ~small(g) & (beyond(g["grader_evidence"]["tier_counts"]) < EVIDENCE_CASES))),
        ("category_claim_floor_inconsistent", some & F.exists(categories, lambda g: g["belowRecommendedScoredCases"] != small(g))),
        ("insufficient_non_surface_grader_evidence", (c("m.scored_n") > 0) & (beyond(tiers) < EVIDENCE_CASES)),
    ]
    for k in CONFIGS:
        cover, n = c("m.scored_attempt_coverage")[k], c("m.scored_attempt_n")[k]
        rules += [
            (f"{k}_scored_attempts_unavailable", ran[k] & (F.coalesce(n, lit(0)) <= 0)),
            (
                f"{k}_scored_attempt_coverage_incomplete",
                ran[k] & ~F.coalesce((cover["expected_scored_case_trial_n"] == c("m.scored_trial_n")) & (cover["observed_scored_attempt_n"] == n) & (cover["incomplete_scored_case_trial_n"] == 0) & (cover["complete"] == (cover["expected_scored_case_trial_n"] > 0)), lit(False)),
            ),
            (f"{k}_task_pass_rate_unavailable", ran[k] & c("m.task_pass_rate")[k].isNull()),
            (f"{k}_task_pass_rate_interval_unavailable", ran[k] & iv["task_pass_rate"][k].isNull()),
        ]
    both, pair, delta = ran["direct"] & ran["fusion"], c("m.paired_vs_direct")["fusion"], iv["pass_rate_delta_vs_direct"]["fusion"]
    costs = c("m.cost_latency.available")
    bounds = c("m.cost_latency.cost_per_pass_interval_usd")
    rules += [
        ("fusion_pairing_unavailable", both & (pair["paired_n"] == 0)),
        ("fusion_pairing_incomplete", both & (pair["paired_n"] > 0) & ((pair["unpaired_n"] > 0) | (pair["paired_n"] != c("m.scored_trial_n")))),
        ("fusion_pass_rate_delta_interval_unavailable", both & delta.isNull()),
        ("cost_latency_suppressed", ~costs),
        *[(f"{k}_cost_per_pass_interval_unavailable", ran[k] & costs & ~F.coalesce(bounds[k]["available"] & bounds[k]["low"].isNotNull() & bounds[k]["high"].isNotNull(), lit(False))) for k in CONFIGS],
    ]
    worst = lambda k: F.greatest(*[F.coalesce(c(f"m.failure_rates.{f}")[k], lit(0.0)) for f in _FAILURES if f not in ("partial_failure_rate", "smoke_completion_rate")])
    partial = lambda k: F.coalesce(c("m.failure_rates.partial_failure_rate")[k], lit(0.0))
    direction = F.when(delta.isNull(), "indeterminate").when(delta["low"] > 0, "fusion_directionally_better").when(delta["high"] < 0, "direct_directionally_better").otherwise("no_clear_difference")
    warnings: list[tuple[str, Column]] = [
        ("public_projection_with_private_attestations", lit(True)),
        ("surface_text_grader_evidence_present", (tiers["surface_text"] > 0) | (tiers["mixed"] > 0)),
        ("mechanical_grader_evidence_present", beyond(tiers) > 0),
        ("fusion_harm_observed", c("m.fusion_harm_rate") > 0),
        ("runtime_failures_present", (worst("direct") > 0) | (worst("fusion") > 0)),
        ("partial_failures_present", (partial("direct") > 0) | (partial("fusion") > 0)),
        ("bootstrap_warnings_present", F.size(iv["warnings"]) > 0),
        ("private_audit_only", lit(True)),
        ("run_provenance_private_audit_only", present),
        ("fusion_advantage_not_established", ran["fusion"] & (direction != "fusion_directionally_better")),
    ]
    fired = lambda rs: F.array_compact(F.array(*[F.when(cond, lit(code)) for code, cond in rs]))
    return rows.select("report_id", fired(rules).alias("blockers"), fired(warnings).alias("warnings"), direction.alias("direction"), delta.alias("delta"))


def _embedded() -> Column:
    """Whether the embedded gate says what the recomputed one says, but for messages and evidence."""
    g = "claimGate."
    same = [
        f"{_get('v', g + 'target', 'string')} <=> 'public_cost_performance'",
        f"{_get('v', g + 'scope', 'string')} <=> 'public_projection_with_private_attestations'",
        f"{_get('v', g + 'overallClaimStatus', 'string')} <=> 'external_evidence_required'",
        f"{_get('v', g + 'status', 'string')} <=> IF(size(blockers) = 0, 'public_report_constraints_met', 'public_report_blocked')",
        f"transform({_get('v', g + 'blockers', 'array<struct<code:string>>')}, b -> b.code) <=> blockers",
        f"transform({_get('v', g + 'warnings', 'array<struct<code:string>>')}, b -> b.code) <=> warnings",
        f"{_get('v', g + 'directionalComparison.status', 'string')} <=> direction",
        f"{_get('v', g + 'directionalComparison.passRateDeltaVsDirect', _BOUNDS)} <=> delta",
        f"{_get('v', g + 'minimums.scoredCases', 'double')} <=> {SCORED_CASES}D",
        f"{_get('v', g + 'minimums.scoredCasesPerCategory', 'double')} <=> {CATEGORY_CASES}D",
        f"{_get('v', g + 'minimums.nonSurfaceGraderEvidenceCases', 'double')} <=> {EVIDENCE_CASES}D",
        f"{_get('v', g + 'minimums.nonSurfaceGraderEvidenceCasesPerCategory', 'double')} <=> {EVIDENCE_CASES}D",
    ]
    return F.expr(" AND ".join(f"({s})" for s in same))


def verify(documents: DataFrame, id_col: str = "report_id", body_col: str = "body") -> DataFrame:
    """One row for each document: status, blockers and warnings of the verification in their order, and the flags behind them.

    An id names one document. A null body is one that could not be read, text that doesn't parse is no JSON.
    """
    c, lit = F.col, F.lit
    rows = parsed(documents, id_col, body_col).join(documents.select(c(f"`{id_col}`").alias("report_id"), c(f"`{body_col}`").isNull().alias("unread")), "report_id")
    found = shape_findings(documents, id_col, body_col)
    under = lambda p: F.bool_or((c("path") == p) | c("path").startswith(f"{p}.") | c("path").startswith(f"{p}["))
    names = {"schemaVersion": "bad_version", "generatedAt": "bad_time", "disclosure": "bad_disclosure", "metrics": "bad_metrics", "evaluationDesign": "bad_design", "claimReadiness": "bad_readiness", "cases": "bad_cases"}
    top = F.bool_or(~c("path").contains(".") & ~c("path").contains("[") & c("code").isin("missing_key", "unknown_key"))
    bad = found.groupBy("report_id").agg(top.alias("bad_root"), *[under(p).alias(a) for p, a in names.items()])
    flagged = rows.join(bad, "report_id", "left").fillna(False, ["bad_root", *names.values()])
    listed = F.coalesce(F.size(F.array_distinct("configs")) == F.size("configs"), lit(False))
    obj_ = c("root_object")
    flagged = flagged.select(
        "report_id", "v", "configs", "parses", "unread", obj_.alias("root_object"), (obj_ & ~c("bad_root")).alias("root_strict"), (obj_ & ~c("bad_disclosure")).alias("disclosure_strict"),
        (obj_ & listed & ~c("bad_metrics")).alias("metrics_strict"), (obj_ & ~c("bad_design")).alias("design_strict"), (obj_ & ~c("bad_readiness")).alias("readiness_strict"),
        (obj_ & c("configs").isNotNull() & ~c("bad_cases")).alias("cases_strict"), (obj_ & ~c("bad_version")).alias("has_version"), (obj_ & ~c("bad_time")).alias("has_time"),
        F.expr(f"{_get('v', 'claimGate', 'map<string,variant>')} IS NOT NULL").alias("embedded"),
    )
    gate_input = c("has_version") & c("disclosure_strict") & c("metrics_strict")
    flagged = flagged.withColumn("gate_input_strict", gate_input).withColumn("fields_strict", gate_input & c("has_time") & c("design_strict") & c("readiness_strict") & c("cases_strict"))
    whole = consistency(flagged.where("metrics_strict AND cases_strict"))
    gates = gate(flagged.where("gate_input_strict"))
    out = flagged.join(whole, "report_id", "left").join(gates, "report_id", "left").fillna(False, list(CONSISTENT))
    consistent = F.forall(F.array(*CONSISTENT), lambda x: x)
    recomputed = c("blockers").isNotNull()
    out = out.withColumn("case_metrics_consistent", consistent).withColumn("embedded_matches", recomputed & c("embedded") & F.coalesce(_embedded(), lit(False)))
    unreadable = F.when(c("unread"), F.array(lit("public_report_json_read_failed"))).when(~c("parses"), F.array(lit("public_report_json_parse_failed")))
    codes = [
        ("public_report_root_shape_malformed", ~c("root_strict")),
        ("public_report_claim_gate_input_unavailable", ~c("gate_input_strict")),
        ("public_report_public_fields_malformed", ~c("fields_strict")),
        ("public_report_case_metrics_mismatch", ~c("case_metrics_consistent")),
        ("public_report_claim_gate_missing", ~c("embedded")),
        ("public_report_claim_gate_mismatch", recomputed & c("embedded") & ~c("embedded_matches")),
    ]
    blockers = F.coalesce(unreadable, F.array_compact(F.array(*[F.when(cond, lit(code)) for code, cond in codes])))
    always = ["public_report_verifier_public_evidence_only", "public_report_external_evidence_still_required"]
    warnings = F.when(unreadable.isNotNull(), F.array(lit(always[0]))).otherwise(F.concat(F.array(*map(lit, always)), F.coalesce("warnings", F.array().cast("array<string>"))))
    verified = (F.size(blockers) == 0) & recomputed & (F.size("blockers") == 0) & c("embedded_matches")
    return out.select(
        "report_id", F.when(verified, "public_report_verified").otherwise("public_report_blocked").alias("status"), blockers.alias("blockers"), warnings.alias("warnings"),
        c("blockers").alias("gate_blockers"), c("warnings").alias("gate_warnings"), c("direction").alias("gate_direction"), "root_object", "root_strict", "fields_strict", "gate_input_strict", c("embedded").alias("gate_embedded"), "embedded_matches",
        "disclosure_strict", "design_strict", "readiness_strict", "metrics_strict", "cases_strict", "case_metrics_consistent", *CONSISTENT,
    )
