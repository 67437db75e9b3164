import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import casesets as C
from tallyframe.operators import disclosure as D
from tallyframe.operators import fingerprints as FP
from tallyframe.operators import grading as G
from tallyframe.operators import metrics as M
from tallyframe.operators import pairwise as W
from tallyframe.operators import planning as L
from tallyframe.operators import resample as R
from tallyframe.plans import caseset_queries
from tallyframe.plans import grading_queries as GQ
from tallyframe.plans import proxy as P
from tallyframe.plans import resample_queries as RQ

ATTEMPT = "case_index long, trial_index long, config_id string, event_id long, status string, failure_status string, passed boolean, degraded boolean, smoke_only boolean, cost_micro long, latency_ms long, category string"
CONFIGS = ["direct", "self_review", "repeated", "fusion"]


def attempts(spark, rows):
    return spark.createDataFrame([(c, t, k, i, s, f, p, False, sm, cost, ms, "x") for i, (c, t, k, s, f, p, sm, cost, ms) in enumerate(rows)], ATTEMPT)


@pytest.fixture(scope="module")
def configs(spark):
    return spark.createDataFrame([(c, i) for i, c in enumerate(CONFIGS)], "config_id string, config_order int")


@pytest.fixture(scope="module")
def golden(spark):
    return attempts(spark, [(0, 0, "direct", "completed", None, True, False, 10, 5), (0, 1, "direct", "completed", None, False, False, 10, 7), (0, 0, "fusion", "completed", None, False, False, 40, 9), (0, 1, "fusion", "completed", None, True, False, 40, 11)])


def test_paired_golden(spark, golden, configs):
    card = {r["config_id"]: r for r in M.scorecard(golden, configs).collect()}
    assert card["direct"]["task_pass_rate"] == card["fusion"]["task_pass_rate"] == 0.5
    assert card["repeated"]["task_pass_rate"] is None and card["repeated"]["p50_latency_ms"] == 0 and card["repeated"]["timeout_rate"] == 0
    pairs = M.paired_outcomes(golden, "direct", ["fusion", "repeated"])
    got = {r["config_id"]: r for r in M.paired_comparison(pairs).collect()}
    f = got["fusion"]
    assert (f["wins"], f["losses"], f["ties"], f["pass_rate_delta"], f["harm_rate"], f["incremental_cost_micro"]) == (1, 1, 0, 0, 0.5, None)
    assert got["repeated"]["unpaired_n"] == 2 and got["repeated"]["pass_rate_delta"] is None
    cover = M.coverage(golden, configs)
    rates = {r["config_id"]: (r["low"], r["high"]) for r in R.bootstrap_pass_rate(golden, cover, 20).collect()}
    assert rates["direct"] == rates["fusion"] == (0.5, 0.5) and rates["repeated"] == (None, None)
    delta = R.bootstrap_pass_delta(pairs.where("config_id = 'fusion'"), golden, 20).first()
    assert (delta["low"], delta["high"]) == (0, 0)


def test_duplicates_take_the_first_outcome(spark):
    rows = attempts(spark, [(0, 0, "direct", "completed", None, True, False, 1, 1), (0, 0, "direct", "completed", None, False, False, 1, 1), (0, 0, "fusion", "completed", None, False, False, 1, 1)])
    assert M.paired_comparison(M.paired_outcomes(rows, "direct", ["fusion"])).first()["losses"] == 1


def test_smoke_counts_for_costs_only(spark, configs):
    rows = attempts(spark, [(0, 0, "direct", "completed", None, True, True, 100, 3), (1, 0, "direct", "failed", "timeout", False, False, 10, 4)])
    r = M.scorecard(rows, configs).where("config_id = 'direct'").first()
    assert (r["total_cost_micro"], r["scored_attempt_n"], r["task_pass_rate"], r["cost_per_pass_micro"], r["timeout_rate"], r["smoke_completion_rate"], r["p95_latency_ms"]) == (110, 1, 0, None, 0.5, 1, 3)


def test_empty_attempts(spark, configs):
    rows = attempts(spark, [])
    assert M.scorecard(rows, configs).count() == 4
    assert M.paired_comparison(M.paired_outcomes(rows, "direct", ["fusion"])).count() == 0


def test_schedule_is_balanced(spark, configs):
    cases = spark.createDataFrame([(i, False) for i in range(4)], "case_index long, smoke_only boolean")
    counts = M.position_counts(M.schedule(cases, configs, 1)).collect()
    assert len(counts) == 16 and {r["all_n"] for r in counts} == {1}
    rotated = M.schedule(cases, configs, 3).where("case_index = 1 AND trial_index = 0").orderBy("position").collect()
    assert [r["config_id"] for r in rotated] == CONFIGS[3:] + CONFIGS[:3]


def test_grading_order_and_bounds(spark):
    rows = spark.createDataFrame(
        [(0, "total=42.005", None), (1, "x" * 20001, None), (2, "nothing here", None), (3, "anything", True)], "case_index long, answer string, smoke_only boolean"
    ).withColumns({"number_expected": F.lit(42.0), "number_tolerance": F.lit(0.01), "number_min": F.lit(40.0), "number_max": F.lit(45.0), "number_regex": F.lit("^total=([0-9.]+)$"), "must_include": F.array(F.lit("TOTAL"))})
    got = {r["case_index"]: r for r in G.grade(rows).collect()}
    assert [c["name"] for c in got[0]["checks"]] == ["must_include", "number_expected", "number_min", "number_max"] and got[0]["passed"]
    assert [c["name"] for c in got[1]["checks"]] == ["answer_size"] and not got[1]["passed"]
    assert [(c["name"], c["passed"], c["details"]) for c in got[2]["checks"]] == [("must_include", False, None), ("number_found", False, "number_not_found")]
    assert [c["name"] for c in got[3]["checks"]] == ["smoke_only"] and got[3]["passed"]


def test_no_grader_fails_and_empty_any_fails(spark):
    rows = spark.createDataFrame([(0, "a")], "case_index long, answer string")
    assert G.grade(rows).first()["checks"][0]["name"] == "grader_configured"
    assert G.grade(rows.withColumn("contains_any", F.array().cast("array<string>"))).first()["passed"] is False


def test_json_grader_on_invalid_json(spark):
    spec = json.dumps({"requireValid": True, "requiredPaths": ["a"], "equals": {"a": 1}, "schemaSubset": {"type": "object"}})
    got = G.grade(spark.createDataFrame([(0, "{")], "case_index long, answer string").withColumn("json_spec", F.lit(spec))).first()
    assert [c["name"] for c in got["checks"]] == ["json_valid", "json_check", "json_check", "json_schema_subset"] and not got["passed"]


def test_near_duplicates_equal_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    sets = [(0, base), (1, base[:-1] + ["x"]), (2, base[:-3] + ["x", "y", "z"]), (3, base[1:]), (4, base[:5])]
    rows = spark.createDataFrame(sets, "id long, tokens array<string>")
    want = {(i, j) for i, a in sets for j, b in sets if i < j and len(a) >= 12 and len(b) >= 12 and len(set(a) & set(b)) * 10 >= 9 * len(set(a) | set(b))}
    pairs = C.near_duplicate_pairs(rows)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    counts = C.near_duplicate_counts(pairs).first()
    assert counts["pairs"] == len(want) and counts["cases"] == len({x for p in want for x in p})


def test_near_duplicates_shuffle_no_row_for_each_token(spark, monkeypatch):
    monkeypatch.setattr(C, "RARITY_SLOTS", 64)
    sets = [(i, [f"w{(i * 37 + j) % 900}" for j in range(200)]) for i in range(0, 120, 2)]
    sets += [(i + 1, ts[:-3] + ["x", "y", f"z{i}"]) for i, ts in sets[::3]]
    pairs = C.near_duplicate_pairs(spark.createDataFrame(sets, "id long, tokens array<string>"))
    want = {(min(i, j), max(i, j)) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) * 10 >= 9 * len(set(a) | set(b))}
    assert want and {(r["a"], r["b"]) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "collect_list" not in plan


def test_near_duplicates_shuffle_the_sets_of_likely_pairs_only(spark):
    shared = [f"s{j}" for j in range(30)]
    sets = [(i, shared + [f"w{i}x{j}" for j in range(120)]) for i in range(60)]
    sets += [(100 + i, ts[:-2] + [f"y{i}"]) for i, ts in sets[:3]] + [(0, sets[0][1])]
    pairs = C.near_duplicate_pairs(spark.createDataFrame(sets, "id long, tokens array<string>"))
    assert sorted((r["a"], r["b"], r["shared"], r["total"]) for r in pairs.collect()) == [(i, 100 + i, 148, 151) for i in range(3)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit(" in plan, "sets are taken by a table of wanted ids before they are shuffled"


def test_near_duplicate_pairs_shuffle_no_text(spark, tmp_path):
    text = " ".join(f"w{j}" for j in range(40))
    rows = [(5, text), (3, text), (9, text + " x"), (1, text + " x y"), (2, None), (7, "short text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = caseset_queries._pairs(spark, str(tmp_path))
    assert {tuple(r) for r in pairs.collect()} == {(3, 9, 40, 41), (1, 3, 40, 42), (1, 9, 41, 42)}
    assert "min(text" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_gate_passes_a_good_set(spark):
    rows = [(i, False, f"c{i % 4}", C.DIFFICULTIES[i // 4 % 3], "structured_or_exact") for i in range(144)]
    cases = spark.createDataFrame(rows, "case_index long, smoke_only boolean, category string, difficulty string, tier string")
    found = C.gate_findings(C.gate_statistics(cases), "holdout", "hmac-sha256", True).where("severity = 'blocker'").collect()
    assert found == []
    codes = {r["code"] for r in C.gate_findings(C.gate_statistics(cases.limit(0)), "holdout", "sha256", True).collect()}
    assert {"holdout_manifest_requires_hmac", "too_few_scored_cases", "no_scored_categories", "difficulty_underpowered"} <= codes


def test_tournament_of_six(spark):
    pool = spark.createDataFrame([("g", i, i) for i in range(6)], "grp string, place long, entry long")
    winner, played = W.tournament(pool, "grp", 6, lambda a, b: F.greatest(a, b))
    assert winner.first()["winner"] == 5 and played.count() == 5 and played.agg(F.max("round")).first()[0] == 2
    assert [(r["a"], r["b"]) for r in W.round_pairs(pool.where("entry < 4"), "grp", 0).orderBy("match").collect()] == [(0, 1), (3, 2)]
    assert [(r["a"], r["b"]) for r in W.round_pairs(pool.where("entry < 4"), "grp", 1).orderBy("match").collect()] == [(1, 0), (2, 3)]


def test_panel_needs_both_orders_and_a_majority(spark):
    votes = spark.createDataFrame([(1, 0, 1, "A"), (1, 0, 2, "B"), (1, 1, 1, "A"), (1, 1, 2, "A"), (1, 2, 1, "A"), (1, 2, 2, "B")], "doc_id long, judge long, order int, verdict string")
    outcomes = W.counterbalanced(votes, ["doc_id"])
    assert sorted(r["outcome"] for r in outcomes.collect()) == ["challenger", "challenger", "tie"]
    assert W.panel(outcomes, ["doc_id"]).first()["outcome"] == "challenger"


def test_auto_mode(spark):
    budgets = spark.createDataFrame([(0, 4000, 2, 1, 100, 10**12), (1, 4000, 2, 1, 100, 1), (2, 4000, 1, 1, 100, 10**12), (3, 4000, 1, 0, 100, 10**12)], "request long, max_tokens long, max_candidates int, max_repairs int, prompt_tokens long, max_cost long")
    prices = spark.createDataFrame([(r, 1, 1) for r in ("direct", "self_review", "repeated", "aggregator", "candidate_a", "candidate_b")], "role string, prompt_price long, completion_price long")
    calls = L.planned_calls(budgets, L.call_shapes(spark))
    got = {r["request"]: (r["mode"], r["reason"]) for r in L.auto_mode(L.mode_estimates(calls, prices, budgets), budgets).collect()}
    best = "selected_richest_within_budget"
    assert got == {0: ("fusion", best), 1: ("direct", "fell_back_to_direct_over_budget"), 2: ("self_review", best), 3: ("direct", best)}
    gone = L.auto_mode(L.mode_estimates(calls, prices.limit(0), budgets), budgets).where("request = 0").first()
    assert gone["reason"] == "estimate_unavailable_defaulted_to_direct"
    caps = [r["max_output_tokens"] for r in calls.where("request = 0 AND mode = 'fusion'").orderBy("call_no").collect()]
    assert caps == [1520, 1520, 960]


def test_public_labels_and_verifier(spark):
    cases = spark.createDataFrame([(i, False, "b" if i < 6 else "a") for i in range(12)], "case_index long, smoke_only boolean, category string")
    assert {r["category"]: r["label"] for r in D.category_labels(cases).collect()} == {"b": "category_0001", "a": "category_0002"}
    assert D.suppression(cases).first()["reason"] is None
    assert D.suppression(cases.where("case_index < 8")).first()["reason"] == "small_scored_case_count_per_category"
    rows = spark.createDataFrame([("case_0001", 0, "direct", "failed", True, "timeout"), ("x", 0, "direct", "completed", True, None)], "public_id string, trial_index int, config_id string, status string, passed boolean, failure_status string")
    assert {r["rule"] for r in D.outcome_violations(rows).collect()} == {"passed_not_completed", "malformed_public_id"}


def test_manifest_binding(spark):
    rows = spark.createDataFrame([(0, '{"b":1,"a":2}', False, "mixed", "c")], "case_index long, case_json string, smoke_only boolean, tier string, category string")
    with pytest.raises(ValueError):
        FP.manifest_rows(rows, key=b"k" * 32, labels=True)
    digest, same = (FP.case_digests(r).first()["canonical_sha256"] for r in (rows, rows.withColumn("case_json", F.lit('{"a":2,"b":1}'))))
    assert digest == same
    assert FP.binding({"algorithm": "sha256", "digest": digest}, digest, False) is None
    assert FP.binding({"algorithm": "sha256", "digest": digest, "intendedUse": "holdout"}, digest, False) == "sha256_holdout_rejected"
    assert FP.binding({"algorithm": "hmac-sha256", "digest": digest}, digest, False) == "hmac_key_required"
    assert FP.binding({"algorithm": "sha256", "digest": "0"}, digest, False) == "digest_mismatch"


def test_metrics_do_not_depend_on_row_order(spark, configs):
    """Permuting stored rows changes nothing while (case, trial, config) is unique."""
    import random

    rand = random.Random(4)
    rows = [(c, t, k, "completed" if rand.random() < 0.8 else "failed", None, rand.random() < 0.5, c % 5 == 0, rand.randrange(99), rand.randrange(999)) for c in range(12) for t in range(2) for k in CONFIGS if rand.random() < 0.9]
    one, two = attempts(spark, rows), attempts(spark, rand.sample(rows, len(rows)))
    assert sorted(map(tuple, M.scorecard(one, configs).collect())) == sorted(map(tuple, M.scorecard(two, configs).collect()))
    pairs = lambda a: sorted(map(tuple, M.paired_comparison(M.paired_outcomes(a, "direct", CONFIGS[1:])).collect()))
    assert pairs(one) == pairs(two)


def test_grader_rules():
    from tallyframe.functions import structured as S

    assert S.schema_problems({"type": "object", "additionalProperties": False, "properties": {"__proto__": {}}}) == ["bad_properties"]
    assert S.schema_problems({"enum": []}) == ["bad_enum"] and S.schema_problems({"minimum": 2, "maximum": 1}) == ["bad_bounds"]


def test_report_verifier_finds_changes(spark, golden, configs):
    from tallyframe.operators import verifier as R

    cases = golden.select("case_index", "smoke_only", "category").distinct().withColumns({"tier": F.lit("mixed"), "difficulty": F.lit("easy")})
    report = R.build(golden, cases, configs)
    assert R.verify(report, report.findings, CONFIGS).count() == 0
    report.metrics = report.metrics.withColumn("wins", F.col("wins") + 1)
    assert {r["code"] for r in R.verify(report, report.findings, CONFIGS).collect()} == {"case_metrics_mismatch"}
    report.outcomes = report.outcomes.withColumn("secret", F.lit("x"))
    assert [tuple(r) for r in R.verify(report, report.findings, CONFIGS).collect()] == [("outcomes_columns", "secret")]


def test_verdict_queries_read_whole_texts(spark, tmp_path):
    texts = {7: "x" * 60 + " then B, and so B", 15: "first A " + "y" * 60 + " then B", 23: "z" * 60 + " tie", 31: None}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r["doc_id"]: r["verdict"] for r in GQ.QUERIES[name][0](spark, str(tmp_path)).collect()} for name in ("verdict_parse_ab", "verdict_parse_tie")}
    assert got["verdict_parse_ab"] == {7: "B", 15: None, 23: None, 31: None}
    assert got["verdict_parse_tie"] == {7: "B", 15: "A", 23: "TIE", 31: "TIE"}


def test_bootstrap_queries_take_500_resamples(spark):
    """Against a walk of the whole stream on the smallest tables; a gate that is met lets the interval through."""
    d = "/root/testdata/sf0.001"
    rows = [r for r in P.attempts(spark, d).collect() if not r["smoke_only"]]
    cases, state, samples = sorted({r["case_index"] for r in rows}), RQ.rng.BOOTSTRAP_SEED, []
    for _ in range(500):
        drawn = []
        for _ in cases:
            state = (state * RQ.rng.MULTIPLIER + RQ.rng.INCREMENT) % 2**32
            drawn.append(int(state / 2**32 * len(cases)))
        samples.append(drawn)
    index = {(r["sample"], r["ordinal"]): r["times"] for r in RQ.QUERIES["resample_index"][0](spark, d).collect()}
    assert index == {(i, k): drawn.count(k) for i, drawn in enumerate(samples) for k in set(drawn)}
    want, free = {}, {}
    for config in CONFIGS:
        own = {c: [r for r in rows if r["case_index"] == c and r["config_id"] == config] for c in cases}
        n, p, cost = ([f(own[c]) for c in cases] for f in (len, lambda v: sum(r["passed"] for r in v), lambda v: sum(r["cost_micro"] or 0 for r in v)))
        sums = [[sum(v[k] for k in drawn) for v in (n, p, cost)] for drawn in samples]
        rates, costs = sorted(b / a for a, b, _ in sums if a), sorted(c / b for _, b, c in sums if b)
        want[config] = tuple(rates[int((len(rates) - 1) * q)] for q in (0.025, 0.975))
        free[config] = 500 - len(costs)
    got = {r["config_id"]: (r["low"], r["high"]) for r in RQ.QUERIES["boot_pass_rate"][0](spark, d).collect()}
    assert got == {c: pytest.approx(v) for c, v in want.items()}
    assert {r["config_id"]: r["zero_pass_samples"] for r in RQ.QUERIES["boot_cost_per_pass"][0](spark, d).collect()} == free
    gate = P.configs(spark).select("config_id", (F.col("config_id") == "direct").alias("complete"))
    gated = {r["config_id"]: (r["low"], r["high"]) for r in R.bootstrap_pass_rate(P.attempts(spark, d), gate, RQ.RESAMPLES).collect()}
    assert gated["direct"] == pytest.approx(want["direct"]) and gated["fusion"] == (None, None)


def test_check_counts_of_json_and_citation_graders(spark):
    spec = '{"requireValid": true, "requiredPaths": ["a", "b"], "equals": {"c": 1}, "includes": {"d": "x"}, "arrayMinLength": {"e": 2}, "schemaSubset": {"type": "object"}}'
    cited = '{"allowedSourceIds": ["S1"], "requiredSourceIds": ["S1"], "minCitedSources": 1, "requiredClaims": [{"text": "t", "sourceId": "S1"}]}'
    rows = spark.createDataFrame([(0, spec, cited), (1, '{"requireValid": false}', '{"allowedSourceIds": []}'), (2, None, None)], "case_index long, json_spec string, citation_spec string")
    assert [r[0] for r in rows.orderBy("case_index").select(G.configured_checks(rows)).collect()] == [11, 1, 0]


def test_tier_with_few_columns(spark):
    rows = spark.createDataFrame([(False, "x"), (False, None), (True, "x")], "smoke_only boolean, exact string")
    assert [r[0] for r in rows.select(G.tier(rows)).collect()] == ["structured_or_exact", "ungraded", "smoke_only"]
    rows = spark.createDataFrame([(False, ["x"]), (False, [])], "smoke_only boolean, must_include array<string>")
    assert [r[0] for r in rows.select(G.tier(rows)).collect()] == ["surface_text", "ungraded"]


def test_grading_without_json_stays_in_the_jvm(spark):
    rows = spark.createDataFrame([(0, "a b")], "case_index long, answer string").withColumn("must_include", F.array(F.lit("a")))
    plan = G.grade(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and G.grade(rows).first()["passed"]


def test_a_tournament_larger_than_expected_is_played_out(spark):
    pool = spark.createDataFrame([(0, i, i) for i in range(13)], "grp int, place int, entry int")
    winner, played = W.tournament(pool, "grp", 4, lambda a, b: F.greatest(a, b))
    assert [r["winner"] for r in winner.collect()] == [12] and played.count() == 12


def test_public_ids_of_five_digits_are_whole_and_malformed(spark):
    from tallyframe.operators import disclosure as D

    rows = spark.createDataFrame([(9998, 0, "direct", "completed", True, False, None), (9999, 0, "direct", "completed", True, False, None)], "case_index long, trial_index long, config_id string, status string, passed boolean, degraded boolean, failure_status string")
    outcomes = D.public_outcomes(rows)
    assert sorted(r["public_id"] for r in outcomes.collect()) == ["case_10000", "case_9999"]
    assert [(r["public_id"], r["rule"]) for r in D.outcome_violations(outcomes).collect()] == [("case_10000", "malformed_public_id")]


def test_rounds_of_a_tournament_are_stages_of_their_own(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(60)], "grp int, id int")
    played = W.tournament(W.pool_of(rows, "grp", ["id"], ["id"]), "grp", 4, lambda a, b: F.greatest(a, b))[1]
    assert played.count() == 57
    plan = played._jdf.queryExecution().executedPlan().toString()
    # five rounds, each after an exchange of its own; those of earlier rounds are read, not made, by later ones
    assert all("+- Exchange hashpartitioning(grp#" in part for part in plan.split("SortAggregate")[2::2]), "rounds share a stage"


def test_latency_ranks(spark):
    rows = spark.createDataFrame([("a", "completed", x) for x in (5, 1, 1, 9, 7)] + [("a", "failed", 99), ("a", "completed", None)], "config_id string, status string, latency_ms long")
    assert [tuple(r) for r in M.latency_ranks(rows).collect()] == [("a", 5, 9)]


def test_graded_json_bounds():
    from tallyframe.functions.structured import parse_json

    assert parse_json('{"k":1e999}')[:2] == (False, "json_too_large") and parse_json("[" + "9" * 5000 + "]")[:2] == (False, "json_too_large")
    assert parse_json(" {}﻿")[0] and not parse_json("{} x")[0] and parse_json("12345678901234567890") == (True, None, 12345678901234567890)


def test_fingerprints_tell_graders_apart(spark):
    rows = spark.createDataFrame([("t", ["c"], False, "x"), ("t", ["c"], False, "y"), ("t", ["c"], True, "x"), ("t", ["c"], False, "x")], "task string, constraints array<string>, smoke_only boolean, exact string")
    got = [r[0] for r in rows.select(FP.content_fingerprint(F.col("task"), F.col("constraints"), F.col("smoke_only"), F.struct("exact"))).collect()]
    assert len(set(got)) == 3 and got[0] == got[3]


def test_all_intervals_at_once_equal_the_single_ones(spark, configs):
    import random

    rand = random.Random(9)
    rows = attempts(spark, [(c, t, k, "completed", None, rand.random() < 0.4, c % 6 == 0, rand.randrange(99), 1) for c in range(14) for t in range(2) for k in CONFIGS if (c, t, k) != (3, 1, "repeated")])
    pairs, cover = M.paired_outcomes(rows, "direct", CONFIGS[1:]), M.coverage(rows, configs)
    got = {r["config_id"]: r for r in R.bootstrap_all(rows, pairs, cover, "direct", 60).collect()}
    rate = {r["config_id"]: r for r in R.bootstrap_pass_rate(rows, cover, 60).collect()}
    delta = {r["config_id"]: r for r in R.bootstrap_pass_delta(pairs, rows, 60).collect()}
    cost = {r["config_id"]: r for r in R.bootstrap_cost_per_pass(rows, 60).collect()}
    for k in CONFIGS:
        assert (got[k]["pass_low"], got[k]["pass_high"]) == (rate[k]["low"], rate[k]["high"])
        assert (got[k]["cost_low"], got[k]["cost_high"], got[k]["zero_pass_samples"]) == (cost[k]["low"], cost[k]["high"], cost[k]["zero_pass_samples"])
        if k in ("self_review", "fusion"):
            assert (got[k]["delta_low"], got[k]["delta_high"]) == (delta[k]["low"], delta[k]["high"])
        else:
            assert got[k]["delta_low"] is None
    assert got["repeated"]["pass_low"] is None and got["repeated"]["cost_low"] is not None


GOOD = {"scored_attempts": 120, "pass_rate": 0.5, "complete": True, "pass_low": 0.4, "delta_low": 0.1, "cost_low": 1.0, "unpaired": 0, "paired": 120, "scored_trials": 120, "scored_cases": 120, "categories": 4, "small_categories": 0, "surface_categories": 0, "suppressed_categories": False, "non_surface_cases": 60, "costs_suppressed": False}
STATS = "config_id string, scored_attempts long, pass_rate double, complete boolean, pass_low double, delta_low double, cost_low double, unpaired long, paired long, scored_trials long, scored_cases long, categories long, small_categories long, surface_categories long, suppressed_categories boolean, non_surface_cases long, costs_suppressed boolean"


@pytest.mark.parametrize(
    ("change", "only", "want"),
    [
        ({}, None, []),
        ({"scored_cases": 99}, None, ["too_few_scored_cases"]),
        ({"suppressed_categories": True, "small_categories": 2}, None, ["category_evidence_unavailable"]),
        ({"categories": 0}, None, ["category_evidence_empty"]),
        ({"small_categories": 1, "surface_categories": 1}, None, ["category_underpowered", "category_non_surface_grader_evidence_underpowered"]),
        ({"non_surface_cases": 4}, None, ["insufficient_non_surface_grader_evidence"]),
        ({"scored_attempts": 0, "pass_rate": None, "pass_low": None}, "repeated", ["repeated_scored_attempts_unavailable", "repeated_task_pass_rate_unavailable", "repeated_task_pass_rate_interval_unavailable"]),
        ({"complete": False}, "direct", ["direct_scored_attempt_coverage_incomplete"]),
        ({"paired": 0, "unpaired": 120}, "fusion", ["fusion_pairing_unavailable"]),
        ({"paired": 110, "unpaired": 10}, "fusion", ["fusion_pairing_incomplete"]),
        ({"delta_low": None}, "fusion", ["fusion_pass_rate_delta_interval_unavailable", "fusion_advantage_not_established"]),
        ({"costs_suppressed": True, "cost_low": None}, None, ["cost_latency_suppressed"]),
        ({"cost_low": None}, "self_review", ["self_review_cost_per_pass_interval_unavailable"]),
    ],
)
def test_each_rule_of_the_report_gate(spark, change, only, want):
    rows = [tuple(({"config_id": k} | GOOD | (change if only in (None, k) else {})).values()) for k in CONFIGS]
    found = D.report_gate(spark.createDataFrame(rows, STATS), CONFIGS).orderBy("severity", "ordinal").collect()
    assert [r["code"] for r in found if r["code"] != "public_projection_with_private_attestations"] == want


def test_gate_of_missing_configurations_and_disclosures(spark):
    rows = [tuple(({"config_id": k} | GOOD).values()) for k in ("direct", "repeated")]
    found = D.report_gate(spark.createDataFrame(rows, STATS), CONFIGS, D.disclosure_blockers({}, {"status": "not_provided"})).orderBy("severity", "ordinal").collect()
    assert [r["code"] for r in found if r["severity"] == "blocker"] == ["case_manifest_binding_malformed", "case_set_claim_gate_missing", "missing_self_review_config", "missing_fusion_config"]
    fine = {"status": "private_report_bound", "intendedUse": "holdout", "hashAlgorithm": "hmac-sha256", "privacyClass": "private_audit_hmac_sha256"}
    gate = {"status": "private_report_constraints_met", "target": "public_cost_performance", "scope": "case_set_only", "overallClaimStatus": "external_evidence_required", "detailDisclosure": "omitted"}
    assert D.disclosure_blockers(fine, gate) == []
    assert D.disclosure_blockers(fine | {"intendedUse": "dev"}, gate | {"scope": "x"}) == ["case_manifest_not_holdout", "case_set_claim_gate_malformed"]
