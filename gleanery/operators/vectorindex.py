"""An inverted file of vectors: lists around learnt centres, of which a query visits the nearest few.

Centres are learnt from a bounded sample (SAMPLE rows by hash of doc_id) by a few rounds of spherical k-means on the driver; every
vector is indexed. Lists longer than PART rows are split by hash of doc_id and their queries sent to each part, so no task holds
a list that grows with the data, and it scores so many queries at once as CELLS allow; queries of a list are split like its rows. Candidates are ranked by exact cosine; zero vectors take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import vector as V
from gleanery.operators.rank import CELLS, best_cells, ranked
from gleanery.session import cut, ship

LISTS, VISIT, SAMPLE, PART, ROUNDS, SEED = 16, 12, 20_000, 20_000, 8, 42


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres (lists x dim, length 1) from a sample of (doc_id, vec)."""
    rows = vectors.select(F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(sample).toPandas()
    x = V.unit_rows(rows["vec"])
    x = x[(x != 0).any(axis=1)] if len(x) else x
    if not len(x):
        return np.zeros((0, 0))
    centres = x[: min(lists, len(x))].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(n > 0, sums / np.where(n > 0, n, 1), centres)
    return centres


def build(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """doc_id, list, vec of every vector that isn't zero. One narrow pass."""
    return _near(vectors.select(F.col("doc_id").alias("id"), "vec"), centres, 1).toDF("doc_id", "vec", "list")


def _near(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for d in batches:
            x = V.unit_rows(d["vec"]) if len(d) else np.zeros((0, 0))
            d = d[(x != 0).any(axis=1)] if len(d) else d
            if len(d) and len(shared.value):
                close = np.argsort(-(x[(x != 0).any(axis=1)] @ shared.value.T), axis=1, kind="stable")[:, :most]
                for j in range(close.shape[1]):
                    yield pd.DataFrame({"id": d["id"], "vec": d["vec"], "list": close[:, j].astype(np.int32)})

    return rows.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, f"id {kind}, vec array<double>, list int")


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, visit: int = VISIT) -> DataFrame:
    """query_id, doc_id, score, rank: the k best that each query (query_id, vec) finds in its ``visit`` nearest lists."""
    parts = cut(index.groupBy("list").count().select("list", F.ceil(F.col("count") / PART).cast("bigint").alias("parts")))  # a row per list
    asked = _near(queries.select(F.col("query_id").alias("id"), "vec"), centres, visit).join(F.broadcast(parts), "list")
    shares = -(-queries.count() // PART)  # a list is asked by no more than all queries
    share = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, shares)))
    asked = asked.select("list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), share.alias("share"), F.col("id").alias("query_id"), "vec")
    rows = index.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, shares) - 1).cast("bigint"))).alias("share"), "doc_id", "vec")
    kinds = queries.schema["query_id"].dataType.simpleString(), index.schema["doc_id"].dataType.simpleString()

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        if not len(left) or not len(right):
            return empty
        x, ids = V.unit_rows(left["vec"]), left["doc_id"].to_numpy()
        names, q = right["query_id"].to_numpy(), V.unit_rows(right["vec"])
        found = []
        step = max(1, CELLS // len(x))  # queries whose scores are held at once
        for i in range(0, len(q), step):
            row, at, score = best_cells(q[i : i + step] @ x.T, ids, k)
            found.append((names[i + row], ids[at], score))
        return pd.DataFrame({c: np.concatenate([f[j] for f in found]) for j, c in enumerate(("query_id", "doc_id", "score"))})

    found = rows.groupBy("list", "part", "share").cogroup(asked.groupBy("list", "part", "share")).applyInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return ranked(found, k, "score")
