"""Which documents match: query trees as plans, and batches of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import language as L
from gleanery.functions import text as T
from gleanery.operators.index import Index


def analyse_words(spark: SparkSession, words: list[str]) -> list[str]:
    """Index forms of some words, with the same expressions as the documents'."""
    if not words:
        return []
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", T.analyse(F.col("w")).alias("t")).collect()
    return [r["t"] for r in sorted(rows, key=lambda r: r["i"])]


def term_docs(index: Index, term: str) -> DataFrame:
    return index.postings.where(F.col("term") == term).select("doc_id")


def phrase_docs(index: Index, terms: list[str]) -> DataFrame:
    """Documents where the terms stand at successive positions. One scan and one group per document: no join per word."""
    if not terms:
        return index.postings.where("false").select("doc_id")
    rows = index.postings.where(F.col("term").isin(*terms))
    starts = None
    for i, t in enumerate(terms):
        here = rows.where(F.col("term") == t).select("doc_id", F.explode("positions").alias("p")).select("doc_id", (F.col("p") - i).alias("start"), F.lit(i).alias("i"))
        starts = here if starts is None else starts.union(here)
    return starts.groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc_id").distinct()


def prefix_docs(index: Index, prefix: str) -> DataFrame:
    """Documents with a term that begins so; the filter reaches the scan."""
    return index.postings.where(F.col("term").startswith(prefix)).select("doc_id").distinct()


def fuzzy_terms(dictionary: DataFrame, word: str, radius: int) -> DataFrame:
    """term, distance for dictionary terms within an edit distance."""
    near = dictionary.where(F.abs(F.length("term") - len(word)) <= radius).select("term", F.levenshtein("term", F.lit(word), radius).cast("bigint").alias("distance"))
    return near.where("distance >= 0")


def matches(spark: SparkSession, index: Index, tree) -> DataFrame:
    """doc_id of the documents that a query tree matches."""
    none = index.stats.where("false").select("doc_id")
    if tree is None:
        return none
    if isinstance(tree, L.Word):
        return term_docs(index, analyse_words(spark, [tree.value])[0])
    if isinstance(tree, L.Phrase):
        return phrase_docs(index, analyse_words(spark, tree.value.split()))
    if isinstance(tree, L.Not):
        return index.stats.select("doc_id").join(matches(spark, index, tree.operand), "doc_id", "left_anti")
    left = matches(spark, index, tree.left)
    if isinstance(tree, L.And):
        if isinstance(tree.right, L.Not):
            return left.join(matches(spark, index, tree.right.operand), "doc_id", "left_anti")
        return left.join(matches(spark, index, tree.right), "doc_id", "left_semi")
    return left.union(matches(spark, index, tree.right)).distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf from (query_id, text): the index forms of a bag-of-words query, without stop words."""
    words = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("w")).select("query_id", T.fold(F.col("w")).alias("w"))
    return words.where(~T.is_stop_word(F.col("w"))).select("query_id", T.stem(F.col("w")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def all_terms(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, score: documents in the lists of all of a query's terms (query_id, term), scored by summed frequency."""
    need = terms.groupBy("query_id").agg(F.count_distinct("term").alias("need"))
    hit = index.postings.join(terms.select("query_id", "term").distinct(), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.sum("tf").cast("bigint").alias("score"))
    return hit.join(need, "query_id").where("n = need").select("query_id", "doc_id", "score")


def top(scored: DataFrame, k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank; ties go to the smaller doc_id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
