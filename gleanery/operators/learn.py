"""Click logs and learning to rank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

FEATURES = ("bm25", "pagerank", "title_match", "url_match", "term_overlap", "semantic", "doc_length", "position")
WEIGHTS = (0.35, 0.20, 0.20, 0.05, 0.05, 0.10, -0.05, 0.10)
RETRAIN_EVERY = 25


def _count_of(text: Column, term: Column) -> Column:
    return F.when(term == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def raw_features(rows: DataFrame) -> DataFrame:
    """Rows (query, title, url, text, pagerank, cos, doc_len) with the eight raw features. For candidates, not the corpus."""
    terms, body = T.feature_tokens(F.col("query")), F.lower(F.coalesce("text", F.lit("")))
    lexical = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.log1p(_count_of(body, t)))
    share = lambda c: F.when((F.size(terms) == 0) | (F.coalesce(c, F.lit("")) == ""), 0.0).otherwise(F.size(F.filter(terms, lambda t: F.lower(c).contains(t))) / F.size(terms))
    words = T.feature_tokens(body)
    overlap = F.when((F.size(terms) == 0) | (body == ""), 0.0).otherwise(F.size(F.filter(terms, lambda t: F.array_contains(words, t))) / F.size(terms))
    return rows.select("*", (1 - F.exp(-lexical)).alias("f_bm25"), F.coalesce("pagerank", F.lit(0.0)).alias("f_pagerank"), share(F.col("title")).alias("f_title_match"), share(F.col("url")).alias("f_url_match"), overlap.alias("f_term_overlap"), F.col("cos").alias("f_semantic"), F.coalesce("doc_len", F.lit(1)).alias("f_doc_length"))


def normalized_features(rows: DataFrame, max_pagerank: Column, max_length: Column, rank0: Column) -> DataFrame:
    """The features of ``raw_features`` scaled to 0..1 by corpus maxima, under the names of FEATURES."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return rows.select(
        "*", clamp(F.col("f_bm25")).alias("bm25"), F.when(max_pagerank > 0, clamp(F.col("f_pagerank") / max_pagerank)).otherwise(0.0).alias("pagerank_n"), clamp(F.col("f_title_match")).alias("title_match"), clamp(F.col("f_url_match")).alias("url_match"),
        clamp(F.col("f_term_overlap")).alias("term_overlap"), clamp(F.col("f_semantic")).alias("semantic"), F.when(max_length > 0, clamp(F.log1p("f_doc_length") / F.log1p(max_length))).otherwise(0.0).alias("doc_length"), (1.0 / (rank0 + 1)).alias("position"),
    )


def linear_score(features: tuple[Column, ...], weights: tuple[float, ...] = WEIGHTS, bias: float = 0.0) -> Column:
    total = F.lit(float(bias))
    for f, w in zip(features, weights, strict=True):
        total = total + f * F.lit(float(w))
    return total


def preference_pairs(clicks: DataFrame, impressions: DataFrame) -> DataFrame:
    """query, preferred, other: a clicked document is preferred to all above it in the query's last impression.

    clicks (query, doc_id), impressions (query, ts, docs); the last impression is one row a query by aggregation.
    """
    key = lambda c: F.trim(F.lower(c))
    last = impressions.groupBy(key(F.col("query")).alias("query")).agg(F.max_by("docs", "ts").alias("docs"))
    rows = clicks.select(key(F.col("query")).alias("query"), "doc_id").join(last, "query").withColumn("at", F.array_position("docs", F.col("doc_id")))
    return rows.where("at > 1").select("query", F.col("doc_id").alias("preferred"), F.explode(F.slice("docs", F.lit(1), (F.col("at") - 1).cast("int"))).alias("other")).where("other <> preferred")


def click_through(clicks: DataFrame, impressions: DataFrame, by: str = "query") -> DataFrame:
    """by, impressions, clicks, ctr, mean_position; the rate is 0 where nothing was shown."""
    shown = impressions.groupBy(by).agg(F.count("*").alias("impressions"))
    done = clicks.groupBy(by).agg(F.count("*").alias("clicks"), F.avg("position").alias("mean_position"))
    rows = shown.join(done, by, "full_outer").select(by, F.coalesce("impressions", F.lit(0)).alias("impressions"), F.coalesce("clicks", F.lit(0)).alias("clicks"), "mean_position")
    return rows.withColumn("ctr", F.when(F.col("impressions") == 0, 0.0).otherwise(F.col("clicks") / F.col("impressions")))


def train_pairwise(pairs: list[tuple[list[float], list[float]]], weights: tuple[float, ...] = WEIGHTS, rate: float = 0.05, epochs: int = 3, decay: float = 1e-4, seed: int = 42) -> list[float]:
    """Stochastic gradient descent on the logistic loss of (preferred, other) feature vectors, in one seeded order for all epochs.

    Decay pulls by the weights from before training. Eight weights and a click log's pairs: a driver-side loop.
    """
    w, first = np.array(weights, dtype=float), np.array(weights, dtype=float)
    d = np.array([np.subtract(a, b) for a, b in pairs], dtype=float).reshape(-1, len(w))
    order = np.random.default_rng(seed).permutation(len(d))
    for _ in range(epochs):
        for i in order:
            g = 1.0 / (1.0 + np.exp(np.clip(w @ d[i], -500, 500)))
            w = w + rate * (g * d[i] - decay * first)
    return w.tolist()


def shard_top(rows: DataFrame, k: int, oversample: int = 3) -> DataFrame:
    """Rows (query_id, shard, doc_id, url, score): the best of each shard, oversampled, without repeated URLs, ranked over all."""
    w = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "doc_id")
    local = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k * oversample)
    first = Window.partitionBy("query_id", "url").orderBy("shard", "_r")
    once = local.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return once.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).drop("_r", "_f")


def total_hits(rows: DataFrame) -> DataFrame:
    """query_id, total: matches over all shards, from rows (query_id, shard, ..): a count per shard, then their sum."""
    return rows.groupBy("query_id", "shard").agg(F.count("*").alias("hits")).groupBy("query_id").agg(F.sum("hits").alias("total"))


def served_features(log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (query, doc_id) with the features that the query's last impression served the document with, as for the first place.

    log: query, ts and the documents' raw features (f_..) with max_pagerank and max_length; documents that weren't served have none.
    """
    key = lambda c: F.trim(F.lower(c))
    rows = log.withColumn("_q", key(F.col("query")))
    last = rows.groupBy("_q").agg(F.max("ts").alias("_t"))
    served = rows.join(last, "_q").where(F.col("ts") == F.col("_t")).drop("query", "ts", "_t")
    hit = asked.withColumn("_q", key(F.col("query"))).join(served, ["_q", "doc_id"]).drop("_q")
    return normalized_features(hit, F.col("max_pagerank"), F.col("max_length"), F.lit(0))
