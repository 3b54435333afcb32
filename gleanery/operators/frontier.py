"""Crawl planning over tables: due dates, priorities, robots rules, membership, dispatch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

CRITICAL, HIGH, MEDIUM, LOW = 100, 75, 50, 25
RETRIES, BACKOFF_S, HEARTBEAT_S = 3, 5, 15


def recrawl_minutes(url: Column) -> Column:
    """Minutes until a page is due again, by host and path."""
    name = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return (
        F.when(name.contains("wikipedia.org") | name.contains("wikimedia.org"), 30)
        .when(name.rlike(r"\.(edu|ac\.uk|edu\.au)$"), 7 * 24 * 60)
        .when(path.rlike(r"\.(pdf|doc|docx|ps|epub)$"), 365 * 24 * 60)
        .when(path.endswith("/wiki") | name.contains("wiki"), 60)
        .otherwise(24 * 60)
    )


def priority(age_hours: Column, hours_to_due: Column, links: Column, depth: Column, authority: Column | None = None) -> Column:
    """Freshness, authority, link popularity, depth and urgency (null: no date), clamped to 0..100."""
    fresh = F.when(age_hours < 1, CRITICAL).when(age_hours < 24, HIGH).when(age_hours < 168, MEDIUM).otherwise(LOW)
    popular = F.when(links > 1000, CRITICAL).when(links > 100, HIGH).when(links > 10, MEDIUM).otherwise(LOW)
    deep = F.when(depth == 0, HIGH).when(depth <= 2, MEDIUM).otherwise(LOW)
    urgent = F.when(hours_to_due.isNull(), MEDIUM).when(hours_to_due <= 1, CRITICAL).when(hours_to_due <= 24, HIGH).when(hours_to_due <= 168, MEDIUM).otherwise(LOW)
    total = fresh + F.coalesce(authority, F.lit(50)) + popular + deep + urgent if authority is not None else fresh + F.lit(50) + popular + deep + urgent
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def retry_at(now: Column, tries: Column) -> Column:
    """When to try again after so many tries, doubling from 5 s; null once they are used up."""
    return F.when(tries < RETRIES, now + F.make_dt_interval(secs=(F.lit(float(BACKOFF_S)) * F.pow(F.lit(2.0), tries)).cast("decimal(18,6)")))


def due(frontier: DataFrame, now: Column) -> DataFrame:
    """Fetched or indexed pages whose date has come."""
    return frontier.where(F.col("state").isin("INDEXED", "FETCHED") & (F.col("next_crawl") <= now))


def dispatch(tasks: DataFrame, delay_s: int = 1) -> DataFrame:
    """Tasks (domain, url, priority, seq) with bucket, slot and turn: a domain's queue by priority bucket then arrival, one task per delay; domains take turns."""
    bucket = F.when(F.col("priority") >= 90, 0).when(F.col("priority") >= 60, 1).when(F.col("priority") >= 30, 2).otherwise(3)
    w = Window.partitionBy("domain").orderBy("bucket", "seq", "url")
    return tasks.withColumn("bucket", bucket).withColumn("turn", F.row_number().over(w) - 1).withColumn("slot_s", (F.col("turn") * delay_s).cast("bigint"))


def discover(pages: DataFrame, known: DataFrame, max_depth: int = 4) -> DataFrame:
    """url, depth: canonical links of pages (url, depth, links) that aren't known (url), each once at its least depth, no deeper than allowed."""
    found = pages.where(F.col("depth") + 1 <= max_depth).select((F.col("depth") + 1).alias("depth"), F.explode("links").alias("link"), F.col("url").alias("base"))
    found = found.select(T.normalize_url(T.resolve_url(F.col("base"), F.col("link"))).alias("url"), "depth").where("url IS NOT NULL").groupBy("url").agg(F.min("depth").alias("depth"))
    return found.join(known.select("url").distinct(), "url", "left_anti")


def evict(registry: DataFrame, most: int) -> DataFrame:
    """The registry (url, state, finished) without its oldest finished entries beyond ``most`` entries in all."""
    over = max(0, registry.count() - most)
    if not over:
        return registry
    oldest = registry.where("finished IS NOT NULL").orderBy("finished", "url").limit(over).select("url")
    return registry.join(oldest, "url", "left_anti")


def lost_workers(heartbeats: DataFrame, now: Column, timeout_s: int = HEARTBEAT_S) -> DataFrame:
    """worker, last of those that haven't been heard of for longer than the timeout."""
    return heartbeats.groupBy("worker").agg(F.max("ts").alias("last")).where(F.unix_timestamp(now) - F.unix_timestamp("last") > timeout_s)


def requeue(tasks: DataFrame, lost: DataFrame) -> DataFrame:
    """Tasks (.., worker, state) of lost workers go back to QUEUED."""
    gone = lost.select(F.col("worker").alias("_w"))
    rows = tasks.join(gone, tasks.worker == F.col("_w"), "left")
    state = F.when(F.col("_w").isNotNull() & (F.col("state") == "FETCHING"), "QUEUED").otherwise(F.col("state"))
    return rows.withColumn("state", state).withColumn("worker", F.when(F.col("_w").isNull(), F.col("worker"))).drop("_w")


def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """host, path, allowed and crawl_delay from robots files (host, status, content), of the blocks for ``*`` or the agent.

    401 and 403 deny all; other statuses than 200 set no rule. The block a line belongs to is that of the last user-agent line before it.
    """
    lines = files.where("status = 200").select("host", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")).select("host", "i", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#') AND contains(line, ':')")
    parts = lines.select("host", "i", F.lower(F.trim(F.split("line", ":", 2)[0])).alias("key"), F.trim(F.split("line", ":", 2)[1]).alias("value"))
    w = Window.partitionBy("host").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("key") == "user-agent", F.lower("value").isin("*", agent.lower()))
    parts = parts.withColumn("mine", F.coalesce(F.last(mine, ignorenulls=True).over(w), F.lit(False))).where("mine")
    rules = parts.where("key IN ('allow', 'disallow') AND value <> ''").groupBy("host", F.col("value").alias("path")).agg(F.max_by(F.col("key") == "allow", "i").alias("allowed"))
    delays = parts.where("key = 'crawl-delay'").groupBy("host").agg(F.max_by(F.expr("try_cast(value AS double)"), "i").cast("bigint").alias("crawl_delay"))
    denied = files.where("status IN (401, 403)").select("host", F.lit("").alias("path"), F.lit(False).alias("allowed"))
    return rules.union(denied).join(delays, "host", "left").withColumn("crawl_delay", F.coalesce("crawl_delay", F.lit(0)))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host, path) with ``allowed``: the host's rule with the longest prefix of the path decides; without one all is allowed."""
    hits = urls.select("url", "host", "path").distinct().join(rules.select("host", F.col("path").alias("rule"), "allowed"), "host").where(F.col("path").startswith(F.col("rule")))
    best = hits.groupBy("url").agg(F.max_by("allowed", F.length("rule")).alias("allowed"))
    return urls.join(best, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n entries at a false positive rate p."""
    m = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(1, n) * math.log(2)))


def _bits(value: Column, m: int, k: int) -> Column:
    h1, h2 = F.pmod(F.xxhash64(value, F.lit(1)), F.lit(m)), F.pmod(F.xxhash64(value, F.lit(2)), F.lit(m))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(m)).cast("bigint"))


def bloom_build(values: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """bucket, bits: a Bloom filter as bitmaps of fixed size, combined on the map side; filters of equal m and k merge by OR."""
    at = values.select(F.explode(_bits(F.col(column), m, k)).alias("bit"))
    return at.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bloom_maybe(values: DataFrame, column: str, bloom: DataFrame, m: int, k: int) -> DataFrame:
    """The distinct values with ``maybe``: whether all of their bits are set."""
    one = values.select(column).distinct().withColumn("bit", F.explode(_bits(F.col(column), m, k)))
    one = one.withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.lit(1) + F.floor(F.col("at") / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = one.join(bloom, "bucket", "left").withColumn("set", F.coalesce(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False)))
    return rows.groupBy(column).agg(F.bool_and("set").alias("maybe"))


def snapshot(tasks: DataFrame, known: DataFrame, path: str) -> None:
    """Keep a frontier: its tasks (url, domain, priority, state, ..) and the URLs that it knows."""
    tasks.write.mode("overwrite").parquet(f"{path}/tasks")
    known.write.mode("overwrite").parquet(f"{path}/known")


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and known URLs of a snapshot; what was under way then is queued again."""
    tasks = spark.read.parquet(f"{path}/tasks")
    return tasks.withColumn("state", F.when(F.col("state") == "IN_FLIGHT", "QUEUED").otherwise(F.col("state"))), spark.read.parquet(f"{path}/known")
