import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import index as I
from gleanery.operators import learn
from gleanery.streaming import streams


@pytest.fixture
def source(spark, tmp_path):
    def add(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    return add


def test_index_grows_by_batches(spark, source, tmp_path):
    schema, at = "doc_id long, text string", str(tmp_path / "index")
    streams.index_stream(source("docs", [(1, "red sea"), (2, "blue sea")], schema), at, str(tmp_path / "c")).awaitTermination()
    streams.index_stream(source("docs", [(3, "deep sea")], schema), at, str(tmp_path / "c")).awaitTermination()
    index = streams.stream_index(spark, at)
    assert {r["term"]: r["df"] for r in index.dictionary.collect()}["sea"] == 3 and index.corpus.first()["n_docs"] == 3
    streams.compact(spark, at, str(tmp_path / "whole"), 2)
    assert I.load(spark, str(tmp_path / "whole")).postings.count() == index.postings.count()


def test_training_counts_no_batch_twice(spark, source, tmp_path):
    pair = ([1.0] + [0.0] * 7, [0.0] * 8)
    rows = source("pairs", [pair] * 30, "preferred array<double>, other array<double>")
    for _ in range(2):
        streams.train_stream(rows, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    state = json.load(open(tmp_path / "s" / "model.json"))
    assert state["trained"] == 1 and len(state["waiting"]) == 5
    assert state["weights"] == pytest.approx(learn.train_pairwise([pair] * 25))


def test_windows_and_duplicates(spark, source):
    rows = [(1, "a", 1.0, "2024-01-01 00:10:00"), (2, "a", 2.0, "2024-01-01 00:50:00"), (2, "b", 3.0, "2024-01-01 01:10:00")]
    schema = "id long, event_type string, value double, t string"
    s = source("events", rows, schema).withColumn("ts", F.to_timestamp("t"))
    assert {(r["event_type"], r["n"]) for r in streams.to_table(streams.windowed_counts(s), spark, "w1", "complete").collect()} == {("a", 2), ("b", 1)}
    assert {(r["event_type"], r["total"]) for r in streams.to_table(streams.running_counts(s), spark, "w2", "complete").collect()} == {("a", 3.0), ("b", 3.0)}
    assert streams.to_table(streams.deduplicated(s, "id"), spark, "w3", "append").count() == 2
