"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the largest cosine is the smallest Euclidean distance. Each of
``tables`` hash tables cuts ``hashes`` Gaussian (2-stable) projections into cells of ``width``. A query
visits its own bucket and those with neighbouring cells, in falling order of estimated success: the sum
of squared distances to the boundaries crossed. Every row is indexed; the hash functions need no
fitting. Candidates of all tables are ranked by the exact cosine, in double precision, of the vectors as given.

Index rows and probes meet by bucket, grouped into cells of work. A bucket of more than ``part_rows`` rows is
split by hash of vec_id into parts of about that size, and its probes (only its own) are sent to every
part: a bucket with a third of all rows is split, and no cell grows with the data. What is shuffled is a row's vector, as
it is stored, for each table, numbers for each probe, and a query's vector for each cell that it visits. Within a
cell a query meets the rows of its buckets, a stretch of the sorted rows for each, and keeps its k best. A query that found fewer than k meets all
rows, in blocks, so results are short only where there are too few candidates.

Cases: vectors that are null, zero or that hold null or non-finite components take no part; vectors of different lengths
have no cosine, so each length is searched on its own; a null vec_id neither asks nor answers; equal scores go to the smaller vec_id;
of rows with one vec_id the nearest counts once, and none of them answers that id's query; extra columns
are ignored; an empty table gives no rows.

Recall on the test tables is measured against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, ship

TABLES, HASHES, WIDTH, PROBES, K, SEED, PART_ROWS, EVERY = 8, 8, 2.3, 56, 5, 42, 20_000, 50
#: Large buckets whose list is broadcast at most (some 40 bytes each); beyond, rows meet them in a shuffle.
BROADCAST = 1_000_000


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and v (as it is stored) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"), v.alias("w")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    return rows.where(~bad & F.exists("w", lambda x: x != 0)).select("vec_id", "v")


def _functions(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucket(cells: np.ndarray, dim: int) -> np.ndarray:
    """A 64-bit number for each row of cell numbers of vectors of a length."""
    out = np.full(cells.shape[:-1], dim, np.uint64)
    for i in range(cells.shape[-1]):
        out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _by_length(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each length of vectors."""
    lengths = rows["v"].map(len).to_numpy()
    for n in np.unique(lengths):
        yield rows if (lengths == n).all() else rows[lengths == n]


def probes(f: np.ndarray, count: int) -> np.ndarray:
    """For each row of cell coordinates (n x hashes), the ``count`` most promising cells (n x count x hashes), its own first."""
    n, m = f.shape
    low = np.floor(f)
    fr = f - low
    steps = np.array([p for p in product((0, -1, 1), repeat=m) if sum(map(abs, p)) <= 4], dtype=np.int64)
    cost = np.zeros((n, len(steps)))
    for i in range(m):
        cost += np.stack([np.zeros(n), (1 - fr[:, i]) ** 2, fr[:, i] ** 2], axis=1)[:, steps[:, i]]
    best = np.argsort(cost, axis=1, kind="stable")[:, : min(count, len(steps))]
    return low[:, None, :].astype(np.int64) + steps[best]


def score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of a vector and rows, each a sum in one fixed order, so that equal vectors get equal scores."""
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def _nearest(qid: int, q: np.ndarray, unit_q: np.ndarray, vid: np.ndarray, x: np.ndarray, unit: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of some rows for a query, each vec_id once; a first ranking by matrix product, then exact with a margin for ties."""
    near = np.where(vid == qid, -9.0, unit @ unit_q)
    most = k
    while True:
        # Rows of one vec_id count once, so the cut moves down until k ids are above it, or all rows are.
        floor = np.partition(near, len(near) - most)[len(near) - most] if most < len(near) else -8.0
        at = np.flatnonzero(near >= max(floor, -8.0) - 1e-9)
        if most >= len(near) or len(np.unique(vid[at])) >= k:
            break
        most = min(len(near), most * 4)
    s = score(q, x[at])
    out, taken = [], set()
    for j in np.lexsort((vid[at], -s)):
        if (v := int(vid[at[j]])) not in taken:
            taken.add(v)
            out.append((int(qid), v, float(s[j])))
            if len(taken) == k:
                break
    return out


def _meet(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """index (cell, bucket, vec_id, v) and asked (cell, buckets, query_id, v) to query_id, vec_id, score."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        rows = {len(part["v"].iloc[0]): part.sort_values("bucket", kind="stable") for part in _by_length(left)} if len(left) else {}
        for asks in _by_length(right) if len(right) else ():
            mine = rows.get(len(asks["v"].iloc[0]))
            if mine is None:
                continue
            x, buckets, vid = _stack(mine["v"]), mine["bucket"].to_numpy(), mine["vec_id"].to_numpy()
            unit, q = _unit(x), _stack(asks["v"])
            for i, (qid, own, unit_q) in enumerate(zip(asks["query_id"], asks["buckets"], _unit(q), strict=True)):
                own = np.unique(own)
                low, high = np.searchsorted(buckets, own), np.searchsorted(buckets, own, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                if len(at):
                    found += _nearest(qid, q[i], unit_q, vid[at], x[at], unit[at], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return index.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, count: int = PROBES, seed: int = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``rows`` found for each of ``queries`` (both vec_id, embedding)."""
    ship(rows.sparkSession)
    x, q = valid(rows), valid(queries)
    stored = x.schema["v"].dataType.simpleString()
    n = x.count()
    # Cells of work per table, so that one holds about part_rows rows.
    spread = max(1, n // part_rows)

    def projected(d: pd.DataFrame) -> tuple[int, np.ndarray]:
        dim = len(d["v"].iloc[0])
        a, b = _functions(dim, tables, hashes, width, seed)
        return dim, ((_unit(_stack(d["v"])) @ a + b) / width).reshape(len(d), tables, hashes)

    def indexed(batches):
        for d in (part for batch in batches if len(batch) for part in _by_length(batch)):
            dim, f = projected(d)
            for t in range(tables):
                yield pd.DataFrame({"t": np.int32(t), "bucket": _bucket(np.floor(f[:, t]).astype(np.int64), dim), "vec_id": d["vec_id"], "v": d["v"]})

    def asking(batches):
        for d in (part for batch in batches if len(batch) for part in _by_length(batch)):
            dim, f = projected(d)
            for t in range(tables):
                buckets = _bucket(probes(f[:, t], count), dim)
                yield pd.DataFrame({"t": np.int32(t), "bucket": buckets.ravel(), "query_id": np.repeat(d["vec_id"].to_numpy(), buckets.shape[1])})

    index = x.mapInPandas(indexed, f"t int, bucket bigint, vec_id bigint, v {stored}")
    asked = q.mapInPandas(asking, "t int, bucket bigint, query_id bigint")
    # Only buckets over part_rows are split: at most n / part_rows of them in a table of hashes.
    hot = cut(index.groupBy("t", "bucket").count().where(F.col("count") > part_rows).select("t", "bucket", F.ceil(F.col("count") / part_rows).cast("bigint").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    part = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), parts)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    cell = lambda p: F.concat_ws(":", "t", p, F.pmod(F.xxhash64("bucket"), F.lit(spread)))
    large = hot.count()
    if large <= BROADCAST:
        hot = F.broadcast(hot)
    index, asked = (x.join(hot, ["t", "bucket"], "left") if large else x.withColumn("parts", F.lit(1).cast("bigint")) for x in (index, asked))
    visits = asked.withColumn("p", every).select(cell(F.col("p")).alias("cell"), "bucket", "query_id").groupBy("cell", "query_id").agg(F.collect_list("bucket").alias("buckets"))
    visits = visits.join(q.select(F.col("vec_id").alias("query_id"), "v"), "query_id")
    found = _meet(index.withColumn("p", part).select(cell(F.col("p")).alias("cell"), "bucket", "vec_id", "v"), visits.select("cell", "buckets", "query_id", "v"), k)

    def best(f: DataFrame) -> DataFrame:
        f = f.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        f = f.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
        return f.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    top = cut(best(found))
    full = top.groupBy("query_id").count().where(F.col("count") >= k)
    short = q.join(full, q.vec_id == full.query_id, "left_anti").select(F.col("vec_id").alias("query_id"), "v")
    if short.isEmpty():
        return top
    blocks = max(1, -(-n // part_rows))
    all_ = x.select(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(blocks)).cast("string").alias("cell"), F.lit(0).cast("bigint").alias("bucket"), "vec_id", "v")
    asks = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<string>")).alias("cell"), F.array(F.lit(0).cast("bigint")).alias("buckets"), "query_id", "v")
    again = best(_meet(all_, asks, k))
    return top.join(full.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(again)


def search_self(rows: DataFrame, every: int = EVERY, **options) -> DataFrame:
    """Every row whose vec_id is divisible by ``every`` against all rows but those of its own vec_id."""
    return search(rows, rows.where(F.col("vec_id") % every == 0), **options)
