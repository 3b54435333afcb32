"""Searching end to end: query text in, ranked documents out, for one query or a table of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import language as L
from gleanery.functions import vector as V
from gleanery.operators import index as I
from gleanery.operators import rank as R
from gleanery.operators import retrieve, semantic

FETCH = 60


@dataclass
class Engine:
    """A search engine over an index and, where they are given, PageRank (node, pagerank), documents (doc_id, url, title, text), vectors (doc_id, vec), vocabulary (word, freq) and synonyms."""

    spark: SparkSession
    index: I.Index
    docs: DataFrame | None = None
    pagerank: DataFrame | None = None
    vectors: DataFrame | None = None
    vocabulary: DataFrame | None = None
    synonyms: dict[str, list[str]] | None = None
    implicit: type = L.Or
    truncate_first: bool = False

    def tree(self, query: str, expand: int = 0):
        parsed = L.parse_query(query, self.implicit)
        return L.expand(parsed, self.synonyms, expand) if expand and self.synonyms and parsed else parsed

    def _terms(self, words: list[str]) -> DataFrame:
        counts: dict[str, int] = {}
        for t in retrieve.analyse_words(self.spark, words):
            counts[t] = counts.get(t, 0) + 1
        return self.spark.createDataFrame([(0, t, n) for t, n in counts.items()], "query_id int, term string, qtf int")

    def corrected(self, query: str) -> str:
        """The query with every word that the vocabulary lacks replaced by its nearest entry; operators stay as they are."""
        tokens = L.lex(query)
        words = sorted({t.value.lower() for t in tokens if t.kind == "WORD"})
        if not words or self.vocabulary is None:
            return query
        asked = self.spark.createDataFrame([(w,) for w in words], "word string")
        known = {r["word"] for r in asked.join(self.vocabulary.select("word"), "word", "left_semi").collect()}
        near = {r["word"]: r["suggestion"] for r in semantic.spell(self.vocabulary, asked, k=1).collect()}
        return " ".join(f'"{t.value}"' if t.kind == "PHRASE" else t.value if t.kind != "WORD" or t.value.lower() in known else near.get(t.value.lower(), t.value) for t in tokens)

    def score(self, tree) -> DataFrame:
        """query_id, doc_id, bm25, pagerank, final of the matching documents. Scores are scaled over the union of the words' lists, then the match filters; what no word scores gets 0, and a query of no words 1."""
        match = retrieve.matches(self.spark, self.index, tree)
        words = L.words(tree)
        if not words or isinstance(tree, L.Not):
            return match.select(F.lit(0).alias("query_id"), "doc_id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("pagerank"), F.lit(1.0).alias("final"))
        scored = R.fuse(R.bm25(self.index, self._terms(words)), self.pagerank)
        if self.truncate_first:  # as engines do that rank before they filter
            return R.ranked(scored, 20, "final").drop("rank").join(match, "doc_id", "left_semi").select("query_id", "doc_id", "bm25", "pagerank", "final")
        return match.join(scored, "doc_id", "left").select(F.lit(0).alias("query_id"), "doc_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bm25", "pagerank", "final")])

    def search(self, query: str, k: int = 10, page: int = 1, mode: str = "bm25", expand: int = 0, weight: float = 0.5, diverse: bool = True, correct: bool = True, vector: list[float] | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Ranked documents (rank, doc_id, bm25, pagerank, final and, with documents, url, title, snippet).

        mode: bm25, hybrid (weighted by maxima), semantic (1 / rank of the vector) or rrf. ``vector`` is the query's; ``model`` may re-rank the page.
        Snippets and diversity, the steps in Python, see a page only.
        """
        tree = self.tree(query, expand)
        if tree is None:
            return self.index.stats.where("false").select(F.lit(1).alias("rank"), "doc_id", F.lit(0.0).alias("final"))
        rows = self.score(tree)
        if correct and self.vocabulary is not None and rows.isEmpty():
            tree = self.tree(self.corrected(query), expand)
            rows = self.score(tree)
        if mode != "bm25" and self.vectors is not None and vector is not None:
            asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vec array<double>")
            near = R.vector_top(self.vectors, asked, FETCH if mode == "hybrid" else 1000)
            if mode == "hybrid":
                fused = R.hybrid(rows.select("query_id", "doc_id", F.col("final").alias("score")), near.select("query_id", "doc_id", "score"), weight)
            elif mode == "rrf":
                lexical = R.ranked(rows, 1000, "final").select("query_id", F.lit(0).alias("channel"), "rank", "doc_id")
                fused = R.rrf(lexical.union(near.select("query_id", F.lit(1).alias("channel"), "rank", "doc_id")))
            else:
                fused = near.select("query_id", "doc_id", (1.0 / F.col("rank")).alias("score"))
            rows = fused.select("query_id", "doc_id", F.col("score").alias("fused")).join(rows, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.col("fused").alias("final"))
        rows = R.page(R.ranked(rows, page * max(1, min(k, 100)), "final"), page, k)
        if self.docs is None:
            return rows.drop("query_id").orderBy("rank")
        rows = F.broadcast(rows).join(self.docs.select("doc_id", "url", "title", "text"), "doc_id")  # a page goes to the texts
        if model:
            rows = model(rows)
        if diverse:
            places = R.diversify(rows.select("query_id", "doc_id", "rank", "url")).select("doc_id", "place")
            rows = rows.join(places, "doc_id").withColumn("rank", F.col("place")).drop("place")
        terms = retrieve.analyse_words(self.spark, L.words(tree))
        rows = R.snippets(rows.withColumn("terms", F.array(*[F.lit(t) for t in terms]).cast("array<string>")))
        return rows.select("rank", "doc_id", "url", "title", "bm25", "pagerank", "final", "snippet").orderBy("rank")

    def suggest(self, prefix: str, k: int = 8) -> DataFrame:
        """Completions of a prefix; of its nearest word if there are none."""
        asked = self.spark.createDataFrame([(prefix.lower(),)], "prefix string")
        found = semantic.autocomplete(self.vocabulary, asked, k)
        if found.isEmpty():
            near = semantic.spell(self.vocabulary, asked.select(F.col("prefix").alias("word")), k=1).select(F.col("suggestion").alias("prefix"))
            found = semantic.autocomplete(self.vocabulary, near, k)
        return found.orderBy("rank")


def asked_index(docs: DataFrame, query: str, implicit: type = L.Or) -> I.Index:
    """An index, with positions, of a stated query's words and phrases only, for an ``Engine`` that answers it over a corpus that isn't indexed: without prefixes, corrections or synonyms."""
    terms = retrieve.analyse_words(docs.sparkSession, [w for t in L.lex(query) if t.kind in ("WORD", "PHRASE") for w in t.value.split()])
    return I.restricted(docs, docs.sparkSession.createDataFrame([(t,) for t in terms], "term string"), positions=True)


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: BM25 for a table of bag-of-words queries (query_id, text) over documents, without an index on disk."""
    terms = retrieve.query_terms(queries)
    return R.bm25_top(I.restricted(docs, terms), terms, k).select("query_id", "rank", "doc_id", F.round("bm25", 6).alias("score"))


def embed_queries(queries: DataFrame, dim: int = 128) -> DataFrame:
    """query_id, vec by the documents' hash embedding."""
    return V.dense(V.hash_embedding(queries, dim, "query_id"), dim, "query_id")
