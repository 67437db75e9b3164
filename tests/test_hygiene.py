from pyspark.sql import functions as F

from tallyframe.operators import hygiene as H


def test_paths(spark):
    cases = {
        "examples/cases.jsonl": [], "x/Cases.JSONL": ["unapproved_case_file"], "a/set.manifest.json": ["unapproved_manifest"], "ok.manifest.json": [], "docs/private_holdout.md": ["private_artifact"], "docs/holdouts.md": [],
        "results/eval-results.json": [], "results/Eval.Result.json": ["private_artifact"], "x/models.json": ["private_artifact"], "x/models-json": [], "holdout.jsonl": ["unapproved_case_file", "private_artifact"], "": [], None: [],
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r["path"]: r["problems"] for r in rows.select("path", H.path_problems(F.col("path"), ("examples/cases.jsonl",), ("ok.manifest.json",)).alias("problems")).collect()}
    assert {p: v for p, v in got.items()} == cases
    assert [r[0] for r in spark.createDataFrame([("a/b/c.x",), ("a/b",)], "p string").select(H.shown_path(F.col("p"))).collect()] == ["a/.../c.x", "a/b"]


def test_first_refuted(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "confirmed").when(F.col("id") % 7 == 0, None).otherwise("refuted").alias("verdict"))
    got = H.first_refuted(rows, ["g"], ["n"])
    want = {g: [n for n in range(g, 5000, 2) if n % 3 and n % 7][:8] for g in (0, 1)}
    for g, ns in want.items():
        assert [r["n"] for r in got.where(F.col("g") == g).orderBy("place").collect()] == ns
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
