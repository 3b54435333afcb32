"""Crawl logs as JSON lines, judged corpora, vectors, and a synthetic judged corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import schemas


def append_crawled(docs: DataFrame, path: str) -> None:
    """Append documents as JSON lines."""
    docs.write.mode("append").json(path)


def read_crawled(spark: SparkSession, path: str, key: str = "url") -> DataFrame:
    """Crawled documents: the last record of each URL, or of another key, in the order in which keys came first; broken lines and rows without a key are skipped."""
    rows = spark.read.schema(schemas.CRAWLED + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())
    rows = rows.where(F.col("_corrupt").isNull() & F.col(key).isNotNull())
    by = Window.partitionBy(key)
    rows = rows.withColumn("_first", F.min("_line").over(by)).withColumn("_last", F.max("_line").over(by)).where("_line = _last")
    return rows.withColumnRenamed("_first", "seq").drop("_corrupt", "_file", "_line", "_last")


def read_judged_documents(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """doc_id, ext_id, url, title, text from JSON lines (_id, title, text): the first of each id, numbered in order of arrival.

    Numbers come from one count per partition, not from a global sort of texts.
    """
    rows = spark.read.schema(schemas.JUDGED_DOCUMENT).json(path).where("_id IS NOT NULL AND _id <> ''")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    first = rows.groupBy("_id").agg(F.min("_at").alias("_at"))
    rows = rows.join(first, ["_id", "_at"]).withColumn("_part", F.shiftright("_at", 33))
    before = rows.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    rows = rows.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("doc_id", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    rows = rows.select("doc_id", F.col("_id").alias("ext_id"), F.concat(F.lit("doc://corpus/"), F.col("_id")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return rows if max_docs is None else rows.where(F.col("doc_id") <= max_docs)


def read_judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text from JSON lines; rows without an id or a text are skipped."""
    rows = spark.read.schema(schemas.JUDGED_QUERY).json(path)
    return rows.where("_id IS NOT NULL AND trim(coalesce(text, '')) <> ''").select(F.col("_id").alias("query_id"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade from lines of white-space or tab separated fields: the first is the query, the last two are document and grade; grades of 0 or less and headers go."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(f.alias("f")).where(F.size("f") >= 3)
    rows = rows.select(F.col("f")[0].alias("query_id"), F.element_at("f", -2).alias("doc_id"), F.round(F.expr("try_cast(element_at(f, -1) AS double)")).cast("int").alias("grade"))
    return rows.where("grade > 0")


def write_manifest(docs: DataFrame, path: str) -> DataFrame:
    """Counts and an order-free checksum of an ingested corpus, and the map of ids beside it; returns the manifest."""
    docs.select("doc_id", "ext_id").write.mode("overwrite").option("sep", "\t").csv(f"{path}/ids")
    manifest = docs.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.md5(F.sum(F.xxhash64("ext_id", "title", "text").cast("decimal(38,0)")).cast("string").cast("binary")).alias("checksum"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return docs.sparkSession.read.json(f"{path}/manifest")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("doc_id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """doc_id, vec; a vector of another length raises an error when it is read."""
    rows = spark.read.schema(schemas.VECTOR).parquet(path)
    return rows.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector isn't {dim} long")).cast("array<float>")))


def synthetic_judged(spark: SparkSession, topics: int = 8, per_topic: int = 40, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, queries, qrels and links of a made-up judged corpus, the same for a seed on any cluster.

    Each document has a grade for its topic: 4, 3, 2, 1 with chances .25, .30, .25, .20. Better ones say the topic's words more
    often and are linked to more. Two queries ask for each topic.
    """
    rows = spark.range(topics * per_topic).select(F.col("id").alias("doc_id"), (F.col("id") % topics).alias("topic"))
    u = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), *[F.lit(s) if isinstance(s, str) else s for s in salt]), F.lit(10**6)) / 10**6
    grade = F.when(u("grade", F.col("doc_id")) < 0.25, 4).when(u("grade", F.col("doc_id")) < 0.55, 3).when(u("grade", F.col("doc_id")) < 0.80, 2).otherwise(1)
    rows = rows.withColumn("grade", grade)
    word = lambda t, j: F.concat(F.lit("topic"), t.cast("string"), F.lit("word"), j.cast("string"))
    own = F.transform(F.sequence(F.lit(1), F.col("grade") * 4), lambda j: word(F.col("topic"), (u("own", F.col("doc_id"), j) * 6).cast("int")))
    noise = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda j: F.concat(F.lit("common"), (u("noise", F.col("doc_id"), j) * 200).cast("int").cast("string")))
    docs = rows.select("doc_id", F.concat(F.lit("https://site"), (F.col("doc_id") % 10).cast("string"), F.lit(".test/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("about topic"), F.col("topic").cast("string")).alias("title"), F.array_join(F.concat(own, noise), " ").alias("text"))
    queries = spark.range(topics * 2).select(F.col("id").alias("query_id"), F.concat_ws(" ", word(F.col("id") % topics, F.floor(F.col("id") / topics)), word(F.col("id") % topics, F.floor(F.col("id") / topics) + 2)).alias("text"))
    qrels = queries.select("query_id", (F.col("query_id") % topics).alias("topic")).join(rows, "topic").select("query_id", "doc_id", "grade")
    links = rows.select(F.col("doc_id").alias("dst"), "grade").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("grade")))).select(F.floor(u("link", F.col("dst"), F.col("k")) * topics * per_topic).cast("bigint").alias("src"), "dst").where("src <> dst")
    return docs, queries, qrels, links


#: id, title, text and the ids that a page links to.
DEMO = (
    (1, "Rivers", "A river carries rain from the hills to the sea. Mills once stood on every river.", (2, 3)),
    (2, "Mills", "A mill grinds grain. Water turns the wheel of the mill and the wheel turns the stone.", (1, 4)),
    (3, "Rain", "Rain falls on the hills and fills the river. Without rain the mill stands still.", (1,)),
    (4, "Bread", "Bread is baked from flour, and flour comes from the mill.", (2,)),
    (5, "Bakers", "A baker rises before the sun to bake bread for the village.", (4, 6)),
    (6, "Villages", "The village grew beside the river, near the mill and its baker.", (1, 2, 5)),
)


def demo_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A few linked pages to try the engine on: documents (doc_id, url, title, text) and links (src, dst)."""
    docs = spark.createDataFrame([(i, f"https://demo.test/{i}", t, x) for i, t, x, _ in DEMO], "doc_id long, url string, title string, text string")
    return docs, spark.createDataFrame([(i, j) for i, _, _, out in DEMO for j in out], "src long, dst long")
