"""Source divergence, quality classifier and filter interactions against SQL, slow formulas and held-out labels."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import filter_audit, quality_fm, source_divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SCREAM = "LOUD " * 300
ODD = [
    (1, "alpha beta gamma alpha", "en", "a", 22),
    (2, "alpha beta delta", "en", "b", 16),
    (3, "Alpha BETA", "en", "c", 10),
    (4, None, "en", "d", None),
    (5, "", None, None, 0),
    (6, "", "en", "a", 0),
    (7, "12 34 ... !", "de", "a", 11),
    (8, "eins zwei eins", "de", "a", 14),
    (9, "eins drei", "de", "b", 9),
    (10, "Eins zwei Été été", "de", "c", 17),
    (None, "alpha beta", "en", "a", 10),
    (None, "alpha beta", "en", "a", 10),
    (11, SCREAM, "en", "e", 1500),
    (12, SCREAM, "en", "a", 1500),
    (12, SCREAM, "en", "a", 1500),
    (13, "w " * 20000 + "#", "fr", "only", 40001),
    (14, "x" * 200000, "en", "a", 200000),
    *[(100 + i, "copy of a copy " * 60, "en", f"s{i % 3}", 900) for i in range(60)],
    *[(200 + i, " ".join(f"t{(i * j) % 97}q" for j in range(250)), "en", f"s{i % 4}", 1000) for i in range(12)],
]
LABELS = [(1, 1, 0), (2, 0, 1), (12, 1, 1), (12, 0, 0), (13, None, 1), (100, 1, 0), (101, 1, 0), (999, 1, 1), (None, 1, 1), (203, 1, None)]


def _same(spark, query, sql, docs, labels=None):
    got = query()
    with duckdb.connect() as con:
        con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        if labels is not None:
            con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
        rel = con.sql(sql)
        want = sorted(map(tuple, rel.select(*[f'"{c}"' for c in got.columns]).fetchall()), key=repr)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == want
    return rows


def test_divergence_equals_sql_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = _same(spark, lambda: source_divergence.divergence(docs), source_divergence.OP11_SQL, docs)
    assert [r for r in rows if r[0] == "de" and r[2] == "pair" and r[1] == "c"]
    assert not [r for r in rows if r[0] == "fr"] or all(r[2] == "term" for r in rows if r[0] == "fr")
    # names of other columns don't matter
    other = docs.select("*", F.lit(1).alias("term"), F.lit("x").alias("item"), F.lit(2).alias("n"), F.lit(3).alias("p"))
    assert sorted(map(tuple, source_divergence.divergence(other).collect()), key=repr) == rows
    assert source_divergence.divergence(docs.limit(0)).collect() == []


def test_divergence_without_kept_terms(spark):
    docs = spark.createDataFrame([(1, "one", "en", "a", 3), (2, "two", "en", "b", 3)], DOCS)
    got = sorted(map(tuple, source_divergence.divergence(docs).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_sketch_never_underestimates(spark, monkeypatch):
    """With few cells terms collide, so fewer are ruled out; the result stays the same."""
    docs = spark.createDataFrame(ODD, DOCS)
    want = sorted(map(tuple, source_divergence.divergence(docs).collect()), key=repr)
    sketch = np.zeros(64, np.uint8)
    source_divergence.add_capped(sketch, np.array([5, 5, 9, 5]), np.array([1, 1, 200, 1]), 3)
    assert sketch[5] == 3 and sketch[9] == 3 and sketch.sum() == 6
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    everything = np.full(source_divergence.SKETCH_BYTES, 255, np.uint8)
    exact = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in source_divergence.count_survivors(texts, everything).collect()}
    some = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in source_divergence.count_survivors(texts, source_divergence.build_sketch(texts, 3)).collect()}
    frequent = {}
    for (lang, _, term), (_, n) in exact.items():
        frequent[lang, term] = frequent.get((lang, term), 0) + n
    assert set(some) < set(exact)
    assert all(some[k] == v for k, v in exact.items() if frequent[k[0], k[2]] >= 3)
    assert want


def test_filters_equal_sql_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = _same(spark, lambda: filter_audit.audit(docs, labels), filter_audit.OP13_SQL, docs, labels)
    assert len(rows) == 4 * 600
    other = docs.select("*", *[F.lit(7).alias(c) for c in ("part", "n", "mask", "digest", "good", "first")])
    assert sorted(map(tuple, filter_audit.audit(other, labels).collect()), key=repr) == rows
    assert filter_audit.audit(docs.limit(0), labels).collect() == []


def test_filters_shapley_adds_up(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    by_part = {r["part"]: r for r in got.groupBy("part").agg(F.sum("removed").alias("removed"), F.sum("shapley").alias("shapley"), F.sum("good_lost").alias("lost")).collect()}
    failing = {r["part"]: r["n"] for r in got.where("step = 5").groupBy("part").agg((F.max("kept")).alias("n")).collect()}
    total = {r["part"]: r["n"] for r in docs.groupBy(F.coalesce("lang", F.lit("")).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for part, r in by_part.items():
        assert r["removed"] == 120 * (total[part] - failing[part]) and r["shapley"] == 120 * r["removed"] and r["lost"] == 0


def test_machine_by_the_identity_equals_all_pairs():
    dice = np.random.default_rng(1)
    m = quality_fm.FactorisationMachine(0.3, dice.normal(size=30), dice.normal(size=(30, 4)))
    at, value = np.array([2, 5, 11, 29]), dice.normal(size=4)
    pairs = sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(at, value)) for j, y in list(zip(at, value))[a + 1 :])
    assert m.margin(at, value) == pytest.approx(0.3 + m.w[at] @ value + pairs)


def test_machine_learns_a_pair_that_no_weight_alone_can():
    rows, y = [], []
    for a in (0, 1):
        for b in (2, 3):
            rows += [(np.array([a, b]), np.ones(2))] * 40
            y += [float((a, b) in ((0, 2), (1, 3)))] * 40
    m = quality_fm.fit(rows, np.array(y), 4, rank=4, epochs=60)
    assert all((m.score(*r) >= 0.5) == bool(t) for r, t in zip(rows, y))


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_fm.op12_quality_fm(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    junk = [p for y, p in held if y == 0]
    clean = [p for y, p in held if y == 1]
    assert sum(p == 0 for p in junk) >= 0.9 * len(junk) and sum(clean) >= 0.97 * len(clean)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    model = quality_fm.train(docs, labels, metadata_cols=("n_chars",))
    extra = docs.withColumn("score", F.lit("x")).withColumn("at", F.lit(0))
    got = quality_fm.score_documents(extra, model, metadata_cols=("n_chars",)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] is None}) == 1
    none = quality_fm.train(docs, labels.where("quality = 1"))
    assert none.machine is None and {r["score"] for r in quality_fm.score_documents(docs, none).collect()} == {none.share}
    assert quality_fm.score_documents(docs.limit(0), model, metadata_cols=("n_chars",)).collect() == []
