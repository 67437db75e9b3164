import random

from pyspark.sql import functions as F

from tallyframe.operators import admission, blinding

CALLS = "request long, call long, estimate long, cost long, max_tokens long, tokens long"


def test_refused_calls_spend_nothing(spark):
    calls = [(1, 1, 60, 50, 10, 5), (1, 2, 60, 60, 10, 5), (1, 3, 40, 70, 10, 5), (1, 4, 0, 1, 0, 1), (2, 1, 1, 1, 99, 1), (2, 2, 1, 1, 5, 7), (2, 3, 1, 1, 1, 1), (3, 1, 1, 1, 1, 1), (4, 1, None, None, None, None), (None, 1, 1, 1, 1, 1)]
    budgets = spark.createDataFrame([(1, 100, 100), (2, 100, 6), (4, 0, 0)], "request long, max_cost long, max_tokens long")
    got = {(r["request"], r["call"]): (r["verdict"], r["spent_cost"], r["spent_tokens"]) for r in admission.admit(spark.createDataFrame(calls, CALLS), budgets).collect()}
    assert got == {
        (1, 1): ("admitted", 50, 5), (1, 2): ("refused_cost", 50, 5), (1, 3): ("admitted", 120, 10), (1, 4): ("refused_cost", 120, 10), (2, 1): ("refused_tokens", 0, 0), (2, 2): ("admitted", 1, 7), (2, 3): ("refused_tokens", 1, 7),
        (3, 1): ("no_budget", 0, 0), (4, 1): ("admitted", 0, 0), (None, 1): ("no_budget", 0, 0),
    }


def test_a_hot_request_streams_by(spark):
    dice = random.Random(1)
    calls = [(i % 50 if i % 3 else 7, i, dice.randrange(90), dice.randrange(100), dice.randrange(20), dice.randrange(20)) for i in range(30_000)]
    budgets = spark.createDataFrame([(r, 20_000, 5_000) for r in range(50)], "request long, max_cost long, max_tokens long")
    got = {(r["request"], r["call"]): (r["verdict"], r["spent_cost"], r["spent_tokens"]) for r in admission.admit(spark.createDataFrame(calls, CALLS), budgets).collect()}
    spent: dict = {}
    for request, call, estimate, cost, ceiling, tokens in calls:
        c, t = spent.get(request, (0, 0))
        verdict = "refused_cost" if c > 20_000 or estimate > 20_000 - c else "refused_tokens" if t > 5_000 or ceiling > 5_000 - t else "admitted"
        if verdict == "admitted":
            c, t = c + cost, t + tokens
        spent[request] = (c, t)
        assert got[request, call] == (verdict, c, t)


def test_blinding_and_back(spark):
    claims = lambda *ids: [(i, f"text of {i}") for i in ids]
    rows = [(1, "a", [("x", "m1", claims("p", "q")), ("y", "m2", claims("r"))], ["p", "r", "z"]), (2, "b", [("x", "m1", claims("p", "q")), ("y", "m2", claims("r"))], ["r", "q"]), (3, "c", None, []), (4, "d", [("x", "m", None)], None)]
    schema = "request int, task string, candidates array<struct<candidate_id:string,model_id:string,claims:array<struct<claim_id:string,text:string>>>>, adopted array<string>"
    out = blinding.blind(spark.createDataFrame(rows, schema)).persist()
    got = {r["request"]: r for r in out.collect()}
    for i, r in got.items():
        h = 2166136261
        for c in rows[i - 1][1]:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        assert r["seed"] == h
    first = got[1] if got[1]["seed"] % 2 == 0 else got[2]
    assert [a["model_id"] for a in first["aliases"]] == ["m1", "m2"] and [c["claim_id"] for c in first["blinded"][0]["claims"]] == ["candidate_1_claim_1", "candidate_1_claim_2"]
    assert all("m1" not in str(r["blinded"]) and "model" not in str(r["blinded"]) for r in got.values())
    assert "z" in got[1]["adopted"] and "p" not in got[1]["adopted"]
    back = {r["request"]: r["adopted"] for r in blinding.unblind(out).collect()}
    assert back == {i: adopted for i, _, _, adopted in rows}
    assert got[3]["aliases"] == [] and got[4]["claim_map"] == [] and out.where(F.size("aliases") > 2).count() == 0
