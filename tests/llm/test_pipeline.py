"""The pipeline against the plain versions of its stages, on the smallest tables and on none."""

import importlib

import pytest

import corpus_pipeline
from sigmill.llm import decontaminate, mixing, simhash, toxicity
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_pii import brute as entities
from tests.llm.test_similar import brute as kept_of


def test_stages_are_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "personal_data", "mix"]
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run


def test_each_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mix":
            assert docs.columns == columns
    out = {name: {r.doc_id: r for r in spark.read.parquet(str(tmp_path / name)).collect()} for name, _ in corpus_pipeline.STAGES}
    into = {name: {r.doc_id: r for r in df.collect()} for name, df in seen.items()}

    scores = toxicity.score(seen["toxicity"], toxicity.fit(seen["toxicity"], spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    assert out["toxicity"].keys() == {r.doc_id for r in scores if r.score < toxicity.THRESHOLD}
    assert sorted(out["near_duplicates"]) == kept_of(sorted((i, r.text) for i, r in into["near_duplicates"].items()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert out["decontaminate"].keys() == {i for i, r in into["decontaminate"].items() if not windows(r.text, items)[1]}
    assert out["personal_data"].keys() == into["personal_data"].keys()
    for i, r in out["personal_data"].items():
        before = into["personal_data"][i]
        assert not entities(r.text) and r.n_chars == len(r.text) and r.source == before.source
        assert (r.text == before.text) == (not entities(before.text)) or "[" in r.text
    assert sum(r.taken for r in out["mix"].values()) == pytest.approx(sum(r.size for r in out["mix"].values()), abs=30)


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    assert decontaminate.WINDOW == 10 and simhash.RADIUS == 3 and mixing.CYCLE == (5, 2, 1)
