import random

import corpus_pipeline
from tallyframe.llm import catalogue, storage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tmp_path):
    rand = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(300):
        text = [rand.choice(words) for _ in range(rand.randint(30, 80))]
        bad = i % 6 == 1
        if bad:
            text.insert(3, rand.choice(["vilest", "cursed"]))
        rows.append((i, "Subscribe NOW\n" + " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, r[1], "en", "s", 0) for i, r in enumerate(rows[2:5])] + [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_copies", "packing"]
    clean = steps["toxicity"](spark, docs, str(tmp_path))
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == COLUMNS
    assert sum(i in kept for i, _, y in labels if y) <= 2 and sum(i not in kept for i, _, y in labels if not y) <= 3
    lines = steps["line_dedup"](spark, clean, str(tmp_path))
    assert lines.columns == COLUMNS and lines.count() == clean.count()
    assert lines.where("text LIKE '%Subscribe%'").count() == 0 and lines.where("text IS NULL").count() == 1
    one = steps["near_copies"](spark, lines, str(tmp_path))
    assert one.columns == COLUMNS and one.where("doc_id BETWEEN 1000 AND 1999").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in one.collect()}


def test_a_stage_finds_no_table_but_its_input(spark, tmp_path, monkeypatch):
    shared, found = tmp_path / "shared", []
    shared.mkdir()
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{shared}")
    spark.range(5).write.parquet(str(tmp_path / "documents.parquet"))

    def stage(spark, docs, sf_dir):
        found.append((len(list(shared.iterdir())), docs.count()))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", stage) for i in range(4)])
    corpus_pipeline.run(spark, str(tmp_path))
    assert found == [(0, 5), (1, 5), (1, 5), (1, 5)]


def test_catalogue_is_complete():
    names = list(catalogue.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(catalogue.oracle_sql()) <= set(names)
