"""Ranking quality and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked results (query_id, doc_id, rank) with their grade; 0 if not judged."""
    return results.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def _gain(grade: Column, rank: Column) -> Column:
    return grade / (F.log(rank + 1.0) / F.log(F.lit(2.0)))


def metrics(results: DataFrame, qrels: DataFrame, k: int = 10, depth: int = 100) -> DataFrame:
    """query_id, ndcg, average_precision, reciprocal_rank, recall, precision5 for every judged query.

    Gains are linear in the grade and the ideal takes all judgements, cut at k; average precision and recall look to ``depth``.
    """
    rows = judged(results, qrels).where(F.col("rank") <= depth)
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum((F.col("grade") > 0).cast("int")).over(seen))
    hit = F.col("grade") > 0
    got = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), F.col("rank")))).alias("dcg"), F.sum(F.when(hit, F.col("hits") / F.col("rank"))).alias("ap"), F.min(F.when(hit & (F.col("rank") <= k), F.col("rank"))).alias("first"),
        F.count_if(hit).alias("found"), F.count_if(hit & (F.col("rank") <= 5)).alias("found5"), F.count_if(F.col("rank") <= 5).alias("shown5"),
    )
    ideal = qrels.where("grade > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    want = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, _gain(F.col("grade"), F.col("r")))).alias("idcg"), F.count("*").alias("relevant"))
    rows = want.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("ap") / F.col("relevant")).alias("average_precision"), zero(1.0 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("found") / F.col("relevant")).alias("recall"), zero(F.when(F.col("shown5") > 0, F.col("found5") / F.col("shown5"))).alias("precision5"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """The means over queries."""
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != "query_id"])


def percentiles(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, minimum, p50, p95, p99, maximum (nearest rank), mean and population deviation of a column in each group."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return rows.groupBy(*by).agg(F.count(column).alias("n"), F.min(column).alias("minimum"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(column).alias("maximum"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))
