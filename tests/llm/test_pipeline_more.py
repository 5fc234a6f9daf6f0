"""The pipeline's stages on empty tables and with columns whose names the operators use; a long text; the order's loss."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import neardup, packing, toxicity

from .conftest import words
from .test_models import labelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {"row": "1", "line_n": "2", "_gone": "array(1)", "toxic_score": "0.25D", "mix_row": "'m'", "copies": "7", "component_id": "8L", "value": "'v'", "rate": "2.0D", "doc": "5L"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = labelled(200)
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    texts = [t for t, _ in rows] + [None, "", " ".join(words(7, 20_000)), rows[1][0], rows[1][0] + " tail", "a line that is in two documents\nx", "y\nA line that is in two documents"]
    docs = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_empty_tables(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == empty.columns


def test_clashing_columns_pass_through_and_change_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.selectExpr("*", *(f"{v} AS `{k}`" for k, v in CLASHING.items()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, folder), stage(spark, wide, folder)
        assert out.columns == wide.columns and dict(out.dtypes) == dict(wide.dtypes), name
        assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, plain.collect())), name
        assert out.select(*CLASHING).distinct().count() <= 1, name
    length = lambda d: corpus_pipeline.pack_sequences(spark, d, folder).agg(F.sum("length")).first()[0]
    assert length(wide) == length(docs)


def test_rows_without_ids(spark, folder):
    rows = [(None, "some words of a text without an id", None, None, 1), (None, "some words of a text without an id", None, None, 1), (1, None, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, folder).count() == 3, name


def test_bytes_of_training_texts_are_bounded(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, share: seen.append(rows))
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_BYTES", 5000)
    toxicity.train(docs, labels)
    assert len(seen[0]) > 100 and sum(len(t.encode()) for t, _ in seen[1]) <= 5000 and 0 < len(seen[1]) < len(seen[0]) and set(seen[1]) <= set(seen[0])


def test_two_texts_of_one_id_give_equal_results_in_any_order(spark):
    r, base = random.Random(2), words(3, 80)
    rows = [(1, " ".join(base)), (1, " ".join(words(4, 60))), (2, " ".join(base[:-2])), (3, " ".join(words(4, 60)[:-1])), (4, " ".join(words(5, 40)))]
    found = set()
    for _ in range(3):
        r.shuffle(rows)
        out = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(r.randint(1, 4)))
        found.add(str(sorted(map(tuple, out.collect()))))
    assert len(found) == 1


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= packing.LENGTH and out.count() > 0
