"""Query logs, histograms and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 10.0)


def query_log(log: DataFrame) -> DataFrame:
    """One row over a log (query, latency, results): total, mean latency, share without results, distinct queries."""
    key = F.trim(F.lower("query"))
    return log.agg(F.count("*").alias("total"), F.avg("latency").alias("mean_latency"), F.avg((F.col("results") == 0).cast("double")).alias("zero_rate"), F.count_distinct(key).alias("distinct_queries"))


def top_queries(log: DataFrame, k: int = 10) -> DataFrame:
    counts = log.groupBy(F.trim(F.lower("query")).alias("query")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "query").limit(k)


def histogram(rows: DataFrame, column: str, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """by, le, n: how many values are at most each bound, and at last all. One pass, one row per group and bound."""
    sums = rows.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count("*").alias("_all"))
    entries = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return sums.select(*by, F.explode(entries).alias("x")).select(*by, "x.le", "x.n")


def series(rows: DataFrame, name: str, ts: str, value: str, keep: int = 1000) -> DataFrame:
    """name, latest, mean, n over the last ``keep`` values of each metric; equal times by value."""
    w = Window.partitionBy(name).orderBy(F.desc(ts), F.desc(value))
    last = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return last.groupBy(name).agg(F.min_by(value, "_r").alias("latest"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def alerts(rows: DataFrame, limits: DataFrame, name: str = "name", value: str = "latest") -> DataFrame:
    """Metrics above their limit (name, threshold)."""
    return rows.join(limits, name).where(F.col(value) > F.col("threshold"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
