import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import rng
from tallyframe.functions import structured as S
from tallyframe.functions import text as T
from tallyframe.operators.grading import extract_number
from tallyframe.functions.rng import lcg31_cycle, lcg31_list
from tallyframe.operators.resample import lower_quantile, net_win_intervals
from tallyframe.sources.generator import number_list


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bootstrap_stream_constants(spark):
    states = [one(spark, rng.lcg_state(F.lit(i))) for i in range(1, 6)]
    assert states == [1344901445, 237621728, 487447487, 2975348242, 2872499785]
    total = spark.range(1, 50001).select(F.sum(rng.lcg_state(F.col("id")))).first()[0]
    assert total == 107209342125912


def test_double_stream_constants(spark):
    assert rng.lcg31_list(20260630, 1) == [110004376]
    assert one(spark, rng.lcg31_step(F.lit(20260630))) == 110004376
    assert len(number_list(20260630, 0, 1, 999, 32)) == 32


def test_fnv(spark):
    h = 2166136261
    for c in b"brand#12":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, rng.fnv1a(F.lit("brand#12"))) == h


@pytest.mark.parametrize(
    "text,want",
    [("A", "A"), (" b ", "B"), ("A. yes", "A"), ("The better response is B", "B"), ("Response A is better than B", None), ("a good answer", None), ("A) x B", "A"), ("", None)],
)
def test_verdicts(spark, text, want):
    assert one(spark, T.verdict_ab(F.lit(text))) == want


def test_first_verdict_takes_the_article(spark):
    assert one(spark, T.verdict_tie(F.lit("a tie"))) == "A"
    assert one(spark, T.verdict_tie(F.lit("none"))) == "TIE"


def test_numbers(spark):
    for text, value, reason in [("total=42.005", 42.005, None), ("none", None, "number_not_found"), ("1e999", None, "number_not_finite"), ("-.5 and 3", -0.5, None)]:
        v, r = extract_number(F.lit(text))
        got = spark.range(1).select(v.alias("v"), r.alias("r")).first()
        assert (got["v"], got["r"]) == (value, reason)


def test_normalized_text_knows_all_spaces(spark):
    assert one(spark, T.normalize_text(F.lit("　 A  b\n\tC ﻿"))) == "a b c"


def test_half_up_goes_to_positive_infinity(spark):
    assert one(spark, T.round_half_up(F.lit(-0.00005), 4)) == 0
    assert one(spark, T.round_half_up(F.lit(0.00005), 4)) == 0.0001


def test_redaction(spark):
    got = one(spark, T.redact(F.lit("sk-or-v1-abc_D Bearer  x.y/z openrouter_api_key = q1\u00a0end OTHER_API_KEY = q2")))
    assert got == "[REDACTED] Bearer [REDACTED] openrouter_api_key = [REDACTED]\u00a0end OTHER_API_KEY = q2"


def test_redaction_of_nested_values(spark):
    rows = spark.createDataFrame([(1, {"sk-or-v1-k": ["sk-or-v1-v", None]}, ("Bearer t", 2)), (2, None, None)], "n int, m map<string,array<string>>, s struct<x:string,y:int>")
    got = T.redact_table(rows.toDF("a.b", "m", "s")).collect()
    assert got[0]["m"] == {"sk-or-v1-k": ["[REDACTED]", None]} and tuple(got[0]["s"]) == ("Bearer [REDACTED]", 2)
    assert got[1]["m"] is None and got[1]["s"] is None and got[1]["a.b"] == 2


def test_citation_matrix():
    spans, bad = S.citations("Revenue rose 12% [S1]. Margin improved [S2].")
    assert [s[0] for s in spans] == ["S1", "S2"] and not bad
    for text in ("x ]", "x [", "x [a[b]]", "x []", "x [a b]", "x [a\n]"):
        assert S.citations(text)[1], text
    assert S.claim_cited("Revenue rose [S1]", "revenue ROSE", "S1", True)
    assert not S.claim_cited("Revenue rose then [S1]", "revenue rose", "S1", True)
    assert S.claim_cited("Revenue rose then [S1]", "revenue rose", "S1", False)
    assert not S.claim_cited("Revenue rose" + "." * 160 + "[S1]", "revenue rose", "S1", False)
    assert S.claim_cited("Revenue rose" + "." * 159 + "[S1]", "revenue rose", "S1", False)


def test_json_rules():
    assert S.parse_json("1 2")[0] is False and S.parse_json("NaN")[0] is False
    assert S.parse_json('{"a":1,"a":2}')[2] == {"a": 2}
    assert S.parse_json("[" * 30 + "]" * 30)[1] == "json_too_large"
    assert S.resolve({"k-1": [{"x": None}]}, "k-1[0].x") is None
    assert S.resolve({"k": 1}, "j") is S.Missing
    assert S.same_primitive(1, 1.0) and not S.same_primitive(1, "1") and not S.same_primitive(True, 1)
    assert S.path_valid("a.b[3].c-d") and not S.path_valid("a..b") and not S.path_valid("__proto__.x") and not S.path_valid("a[1001]")
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"], "additionalProperties": False}
    assert S.matches_schema({"n": 3.0}, schema) and not S.matches_schema({"n": 3, "m": 1}, schema) and not S.matches_schema({"n": -1}, schema)
    assert S.schema_problems(schema) == [] and S.schema_problems({"type": "object"}) == ["additional_properties_not_explicit"]


def test_canonical_numbers():
    assert S.canonical_json({"b": 1.0, "a": [1e21, 1e-7, 0.1, True, None]}) == '{"a":[1e+21,1e-7,0.1,true,null],"b":1}'
    with pytest.raises(ValueError):
        S.canonical_json(float("inf"))


def test_keyed_digest(spark):
    key = b"k" * 32
    want = hmac.new(key, b"d\0p\0text", hashlib.sha256).hexdigest()
    assert one(spark, S.hmac_of(key, "d", "p")(F.lit("text"))) == want
    with pytest.raises(ValueError):
        S.keyed_digest(b"short", "d", "p", "x")


def test_lower_quantile_is_the_floor_rule(spark):
    values = list(range(10))
    random.Random(1).shuffle(values)
    assert one(spark, lower_quantile(F.array(*map(F.lit, values)), 0.975)) == 8


def test_net_win_interval_by_table_equals_the_stream(spark):
    dice = random.Random(2)
    groups = {"a": [1] * 42 + [0] + [-1] * 5, "b": [dice.choice((-1, 0, 1)) for _ in range(131)], "c": [1]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", 100, None)]
    got = {r["g"]: (r["tasks"], r["low"], r["high"]) for r in net_win_intervals(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], "i", "v", 400).collect()}
    for g, vs in groups.items():
        state, nets = 987654321, []
        for _ in range(400):
            total = 0
            for _ in vs:
                state = int(float(state) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
                total += vs[min(len(vs) - 1, int(state / 0x7FFFFFFF * len(vs)))]
            nets.append(total / len(vs))
        nets.sort()
        assert got[g] == (len(vs), nets[10], nets[390])


def test_net_win_draws_are_no_rows(spark):
    groups = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), (F.col("id") % 3 - 1).alias("v"))
    bounds = net_win_intervals(groups, ["g"], "i", "v", 2000)
    assert bounds.count() == 2

    def rows_made(node):
        made = node.metrics().get("numOutputRows")
        children = [node.children().apply(i) for i in range(node.children().size())]
        children += [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        return max([made.get().value() if made.isDefined() else 0, *map(rows_made, children)])

    bounds.collect()
    plan = bounds._jdf.queryExecution().executedPlan()
    assert 0 < rows_made(plan) <= 2 * 15_821, "3 million draws for each group"


def test_stream_runs_into_its_cycle():
    states, back = lcg31_cycle(987654321)
    walked = lcg31_list(987654321, 40_000)
    slot = lambda k: k if k < len(states) else back + (k - back) % (len(states) - back)
    assert [states[slot(k + 1)] for k in range(40_000)] == walked
    with pytest.raises(ValueError):
        lcg31_cycle(987654321, most=100)
