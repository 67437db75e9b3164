import json

import pytest
from pyspark.sql import functions as F

from tallyframe import cli
from tallyframe.sources import jsonl, settings
from tallyframe.sources.generator import case_row
from tallyframe.streaming import attempts as stream

CASES = [
    {"id": "a", "task": "Say x", "category": "c", "difficulty": "easy", "grader": {"mustInclude": ["x"], "json": {"requireValid": True}}},
    {"id": "b", "task": "Say y", "smokeOnly": True},
]


@pytest.fixture
def case_file(tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(CASES[0]) + "\n\n  \n" + json.dumps(CASES[1]) + "\r\n")
    return str(path)


def test_lines_keep_their_numbers(spark, case_file):
    assert [(r["case_index"], r["line"], r["id"], r["smoke_only"]) for r in jsonl.read_cases(spark, case_file).orderBy("case_index").collect()] == [(0, 1, "a", False), (1, 4, "b", True)]
    assert json.loads(jsonl.read_cases(spark, case_file).where("id = 'a'").first()["json_spec"]) == {"requireValid": True}


def test_problems(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"id": "a", "task": "t", "odd": 1}\nnot json\n')
    assert sorted((r["line"], r["problem"]) for r in jsonl.case_problems(jsonl.read_cases(spark, str(path))).collect()) == [(1, "unknown_key"), (2, "not_a_json_object")]


def test_prices(spark, tmp_path):
    entry = {"modelId": "m", "promptPriceUsdPerToken": 1e-6, "completionPriceUsdPerToken": 2e-6, "fetchedAt": "2026-01-01T00:00:00Z", "source": "s"}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([entry]))
    bad.write_text(json.dumps([entry, entry]))
    assert jsonl.read_prices(spark, str(good)).count() == 1
    with pytest.raises(ValueError):
        jsonl.read_prices(spark, str(bad))


def test_json_sink_spares_inputs(tmp_path):
    out = tmp_path / "deep" / "x.json"
    jsonl.write_json(str(out), {"a": 1})
    assert json.loads(out.read_text()) == {"a": 1}
    with pytest.raises(ValueError):
        jsonl.write_json(str(out), {}, (str(tmp_path / "deep" / ".." / "deep" / "x.json"),))


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"budget": {"maxCostUsd": 1}, "models": {"directModelId": "m", "selfReviewModelId": "n"}}))
    s = settings.load_settings(str(path))
    assert s["budget"]["maxCostUsd"] == 1 and s["budget"]["maxCandidates"] == 2
    assert settings.settings_problems(s) == ["models.selfReviewModelId_not_baseline"]
    path.write_text(json.dumps({"provider": []}))
    with pytest.raises(ValueError):
        settings.load_settings(str(path))
    assert settings.parse_env("# c\nexport A='b c'\nD=e # f\nbad line\n") == {"A": "b c", "D": "e"}
    assert settings.parse_pairs("a:b, c:d") == [("a", "b"), ("c", "d")]
    assert settings.configs_problem(["x", "x"], ("x",)) == "repeated"


def test_generator():
    assert case_row("sum", [1, 2])["grader"]["number"]["expected"] == 3


def test_cli_round_trip(spark, case_file, tmp_path, capsys, monkeypatch):
    manifest, keyed, problems = str(tmp_path / "m.json"), str(tmp_path / "k.json"), str(tmp_path / "problems")
    assert cli.main(["validate-cases", case_file, "--manifest", manifest, "--labels", "--problems", problems]) == 0
    assert spark.read.schema("line int, problem string").json(problems).count() == 0
    assert cli.main(["verify-manifest", case_file, manifest]) == 0
    document = json.loads(open(manifest).read())
    assert [r["id"] for r in document["rows"]] == ["a", "b"] and document["summary"]["caseCount"] == 2
    monkeypatch.setenv("TEST_KEY", "k" * 32)
    assert cli.main(["validate-cases", case_file, "--manifest", keyed, "--hmac-key-env", "TEST_KEY", "--intended-use", "holdout"]) == 0
    assert cli.main(["verify-manifest", case_file, keyed, "--hmac-key-env", "TEST_KEY"]) == 0
    assert "k" * 32 not in open(keyed).read() and "category" not in open(keyed).read().replace("categoryCount", "").replace("categoryBalance", "")
    capsys.readouterr()
    document["rows"][1]["canonicalRowSha256"] = "0" * 64
    document["fingerprint"]["canonicalSha256"] = "0" * 64
    open(manifest, "w").write(json.dumps(document))
    assert cli.main(["verify-manifest", case_file, manifest]) == 2 and json.loads(capsys.readouterr().out) == {"shape": {}, "digest_matches": False, "rows": {"changed": 1}}
    document["privacy"]["secret"] = 1
    open(manifest, "w").write(json.dumps(document))
    assert cli.main(["verify-manifest", case_file, manifest]) == 2 and json.loads(capsys.readouterr().out) == {"shape": {"unknown_key": 1}}
    assert cli.main(["validate-cases", case_file, "--gate"]) == 2
    assert "too_few_scored_cases" in capsys.readouterr().out


def test_lines_of_many_splits(spark, tmp_path):
    """Numbers don't depend on how files are split, nor on blank lines, carriage returns or a missing last line feed."""
    import random

    dice = random.Random(5)
    want = []
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        lines = [dice.choice(["", "  ", "\t\r", '{"id": "x", "task": "é%d"}' % i, '{"id": "y%d"}\r' % i, '{"id": "' + "z" * dice.randrange(300) + '"}']) for i in range(dice.randrange(40, 200))]
        (tmp_path / name).write_bytes("\n".join(lines).encode())
        want += [(name, i, line.removesuffix("\r")) for i, line in enumerate(lines, 1) if line.strip()]
    for size in ("300", "1000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r["index"], r["file"].rsplit("/", 1)[1], r["line"], r["raw"]) for r in jsonl.read_lines(spark, str(tmp_path)).collect())
        assert [g[0] for g in got] == list(range(len(want))) and [g[1:] for g in got] == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_answers_of_unknown_cases_stay(spark, case_file, tmp_path):
    from tallyframe.operators import evaluation

    path = tmp_path / "answers.jsonl"
    path.write_text("".join(json.dumps({"id": i, "configId": "direct", "answer": "x"}) + "\n" for i in ("a", "nobody", "b")))
    cases = jsonl.read_cases(spark, case_file)
    got = jsonl.read_responses(spark, str(path), cases)
    assert sorted((r["event_id"], r["case_index"]) for r in got.collect()) == [(0, 0), (1, None), (2, 1)]
    configs = spark.createDataFrame([("direct", 0)], "config_id string, config_order int")
    assert [r["event_id"] for r in evaluation.unexpected(cases, got, configs, 1).collect()] == [1]
    twice = cases.unionByName(cases.withColumn("case_index", F.col("case_index") + 10))
    assert jsonl.read_responses(spark, str(path), twice).count() == 3


def test_streamed_rates_equal_batch(spark, tmp_path):
    rows = spark.range(20).select(F.lit("direct").alias("config_id"), (F.col("id") % 5 == 0).alias("smoke_only"), (F.col("id") % 2 == 0).alias("passed"), F.col("id").alias("cost_micro"))
    rows.write.parquet(str(tmp_path / "in"))
    query = stream.running_rates(stream.stream_attempts(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("rates").collect() == stream.running_rates(rows).collect()
