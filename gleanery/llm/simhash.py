"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most r bits have a common point within r/2 of both. So every
distinct fingerprint emits all points of its ball of radius r // 2 (65 for r = 2), the points are
shuffled, and fingerprints that meet at a point are compared. For an even r every pair that meets is
within r; for an odd r one side would have to reach further, so the radius must be even.

Copies are folded into their fingerprint before anything else, so a group of copies is one row however
large it is, and at most 1 + 64 distinct fingerprints can meet at a point when r is 2. Each point links
its fingerprints to the smallest of them: a star has the components of all pairs without emitting them.
All 65 points of a fingerprint are shuffled, as two longs each; those where nothing meets vanish right after.

Components: large-star and small-star steps until no edge changes, each cut with a checkpoint; only links
(not documents) take part, and only a count comes to the driver.

Cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle of all words; a null doc_id never names a component unless all its ids
are null (then null); rows repeated stay repeated; extra columns are ignored by ``fingerprints`` and
kept by ``keep_representatives``; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, map_batches, text_of

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Keys of rows to drop that are broadcast at most (about 60 bytes each); they are counted first, and beyond that both sides are shuffled.
BROADCAST = 1_000_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle of a UTF-8 text, A-Z in lower case, words cut at ASCII white space."""
    words = text.lower().split()
    of, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([of(joined, SEED)], dtype=">u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([of(joined[s:e], SEED) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    over = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        over += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(over * 2 > len(hashes)).tobytes(), "big")


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of the shingles of a text; zero if it has no words."""
    return fingerprint(shingle_hashes(text, shingle)) if text.strip() else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) for every text of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([simhash(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().cast("binary").alias("bytes"))
    return map_batches(rows, run, "doc_id bigint, th bigint, fp bigint")


def ball(fp: Column, radius: int) -> Column:
    """All points within ``radius`` bits of a fingerprint, itself first."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a > b) from ``distinct`` (fp): enough of those within ``radius`` to join all that they join."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even")
    points = distinct.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("point"))
    met = points.withColumn("b", F.min("fp").over(Window.partitionBy("point"))).where("fp <> b")
    pairs = met.select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b), by alternating stars.

    Each round is two shuffles of links; neighbours are never gathered into a row, only their minimum.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Hang a node's larger (large star) or smaller (small star) neighbours, and itself, on the least of all."""
        sides = e.union(e.select("b", "a")).toDF("u", "v") if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = sides.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.where("a <> b").select("a", "b").distinct())
    was = mark(now)
    for _ in range(most_rounds):
        now = cut(star(star(now, True), False))
        before, was = was, mark(now)
        if was == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
    raise RuntimeError("components did not settle")


def _named(rows: DataFrame, radius: int) -> DataFrame:
    """For every distinct fp its root (a fingerprint of its component)."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("first"))
    roots = components(links(distinct.select("fp"), radius))
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    rows = cut(fingerprints(docs, shingle))
    named = _named(rows, radius)
    ids = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id (of several texts with that id, the one of the least hash).

    What goes is looked up by (doc_id, hash of the text). Up to BROADCAST such keys, which are counted first, are
    broadcast, and no text is shuffled; beyond, rows and keys are. Rows repeated with the same id and text are folded on their own, so only they are grouped.
    """
    rows = cut(fingerprints(docs, shingle))
    named = _named(rows, radius)
    keep = named.join(named.groupBy("root").agg(F.min("first").alias("keep")), "root").select("fp", F.col("keep.doc_id").alias("keep_id"), F.col("keep.th").alias("keep_th"))
    keys = cut(rows.groupBy("doc_id", "th", "fp").count().join(keep, "fp").select("doc_id", "th", "count", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))).alias("stays")))
    return keep_rows(docs, keys)


def rows_of(docs: DataFrame, which: DataFrame, kind: str) -> DataFrame:
    """``docs`` joined with the keys ``which`` (doc_id, th), which are broadcast if they are few."""
    which = which.select(F.col("doc_id").alias("_gl_id2"), F.col("th").alias("_gl_th2"))
    if which.count() <= BROADCAST:
        which = F.broadcast(which)
    held = docs.withColumns({"_gl_id": F.col("doc_id").cast("bigint"), "_gl_th": F.xxhash64(text_of())})
    return held.join(which, F.col("_gl_id").eqNullSafe(F.col("_gl_id2")) & (F.col("_gl_th") == F.col("_gl_th2")), kind)


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``keys`` (doc_id, th, count, stays) that stays."""
    again = keys.where("stays and count > 1")
    kept = rows_of(docs, keys.where("not stays or count > 1"), "left_anti")
    if not again.isEmpty():
        kept = kept.union(rows_of(docs, again, "left_semi").dropDuplicates(["_gl_id", "_gl_th"]))
    return kept.drop("_gl_id", "_gl_th")
