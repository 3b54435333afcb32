"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import code_hash, coded_words, feature_tokens
from gleanery.session import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either vector is zero. Norms known beforehand spare their passes."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def hash_embedding(docs: DataFrame, dim: int = 128, key: str = "doc_id") -> DataFrame:
    """key, bucket, weight: signed feature hashing of a text's a-z 0-9 tokens, scaled to length 1; zero entries are left out.

    Sparse rows instead of a dense array: only distinct (document, bucket) pairs meet, summed on the map side.
    """
    words = docs.select(key, F.explode(feature_tokens(F.col("text"))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    h = code_hash(F.col("w"))
    sign = F.when(F.shiftrightunsigned(h.cast("int"), 16).bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)
    sums = words.select(key, (h.bitwiseAND(F.lit(2147483647)) % dim).cast("int").alias("bucket"), (sign * F.col("n")).alias("x")).groupBy(key, "bucket").agg(F.sum("x").alias("x")).where("x <> 0")
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("length"))
    return sums.join(length, key).select(key, "bucket", (F.col("x") / F.col("length")).alias("weight"))


def dense(sparse: DataFrame, dim: int = 128, key: str = "doc_id") -> DataFrame:
    """key, vec (array<double>) from (key, bucket, weight)."""
    entries = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return entries.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def embedded(docs: DataFrame, dim: int = 128, key: str = "doc_id") -> DataFrame:
    """key, vec: what ``dense`` makes of ``hash_embedding``, in one narrow pass; texts whose entries are all zero are left out."""
    ship(docs.sparkSession)
    line = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9]+", " ")
    return docs.select(key, line.alias("line")).mapInArrow(_embed(dim, key), f"{key} {docs.schema[key].dataType.simpleString()}, vec array<double>")


def _embed(dim: int, key: str):
    def run(batches):
        for batch in batches:
            at, codes, words = coded_words(batch.column(1))
            h = _code_hashes(words)
            real = pc.utf8_length(words).to_numpy(zero_copy_only=False) > 0
            sign = np.where(h >> np.uint64(16) & np.uint64(1), -1.0, 1.0) * real
            cell = at * dim + ((h & np.uint64(2147483647)) % np.uint64(dim)).astype(np.int64)[codes]
            x = np.bincount(cell, sign[codes], minlength=batch.num_rows * dim).reshape(-1, dim)
            length = np.sqrt((x * x).sum(axis=1))
            some = np.flatnonzero(length)
            x = x[some] / length[some, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(x.ravel()))], [key, "vec"])

    return run


def _code_hashes(words: pa.Array) -> np.ndarray:
    """``code_hash`` of ASCII words, unsigned."""
    data = words.cast(pa.binary())
    size = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.uint64)
    h, left, i = np.zeros(len(size), np.uint64), np.flatnonzero(size > 0), 0
    while len(left):
        h[left] = (h[left] * np.uint64(31) + flat[offsets[left] + i]) & np.uint64(4294967295)
        i += 1
        left = left[size[left] > i]
    return h


def unit_rows(vectors) -> np.ndarray:
    """A column of vectors as a matrix of rows of length 1; zero rows stay zero."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)
