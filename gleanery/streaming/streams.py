"""Streams of documents, queries and clicks."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators import index as I
from gleanery.operators import learn


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch of documents to an index as a segment of its own, named by the batch, so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        I.postings(batch).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        I.doc_stats(batch).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(spark: SparkSession, path: str) -> I.Index:
    """The index over all segments; document frequencies and corpus statistics follow from what has come so far."""
    posts, stats = spark.read.parquet(f"{path}/postings").drop("batch"), spark.read.parquet(f"{path}/stats").drop("batch")
    return I.Index(posts, stats, I.dictionary(posts), I.corpus_stats(stats))


def compact(spark: SparkSession, path: str, out: str, buckets: int = 64) -> None:
    """Rewrite all segments as one index."""
    stream_index(spark, path).save(out, buckets)


def running_counts(events: DataFrame) -> DataFrame:
    """event_type, n, total: running analytics for update or complete mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts that close with the watermark. An extension: the query language has no windows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def deduplicated(rows: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """First arrival of each key, remembered as long as the watermark allows."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def train_stream(pairs: DataFrame, state_path: str, checkpoint: str, weights: tuple[float, ...] = learn.WEIGHTS, every: int = learn.RETRAIN_EVERY, publish: Callable[[list[float]], None] | None = None) -> StreamingQuery:
    """Retrain the linear ranker from a stream of (preferred, other) feature arrays each time ``every`` more have come.

    One global model of eight weights, so the driver holds it; counts and weights are kept in a file with the number of
    the last batch, and a batch that is repeated after a failure is not counted twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        file = os.path.join(state_path, "model.json")
        state = json.load(open(file)) if os.path.exists(file) else {"weights": list(weights), "waiting": [], "batch": -1, "trained": 0}
        if number <= state["batch"]:
            return
        rows = [(r["preferred"], r["other"]) for r in batch.select("preferred", "other").toLocalIterator()]
        waiting = state["waiting"] + rows
        while len(waiting) >= every:
            state["weights"] = learn.train_pairwise(waiting[:every], tuple(state["weights"]))
            waiting, state["trained"] = waiting[every:], state["trained"] + 1
            if publish:
                publish(state["weights"])
        state |= {"waiting": waiting, "batch": number}
        os.makedirs(state_path, exist_ok=True)
        with open(file + ".new", "w") as f:
            json.dump(state, f)
        os.replace(file + ".new", file)

    return pairs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(df: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """Run a streaming plan over what is there into an in-memory table. For tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
