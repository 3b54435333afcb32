"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. One pass measures every document: its words, and hashes of id and text. Only these narrow rows are kept.
2. Targets: the weights share ``share`` of all words; a source takes at most ``most`` times its size and
   the excess is shared anew until none is above (``targets``, per source, on the driver).
3. Every source's documents fall into blocks by hash. About ``BLOCKS`` blocks are made in all, dealt by
   size, so the table of blocks is bounded however large the corpus, and a hot source has many.
4. A target is so many whole passes over the source and a rest. The rest takes the source's blocks in a
   seeded random order, each that still fits; of the first that did not it takes documents, in
   hash order, up to the one that comes nearest.
5. The tree: the root holds every source's quota of drawn blocks. A node splits its quotas between its two
   children by one multivariate-hypergeometric draw, so quotas stay exact at every level and each output
   shard ends with its own number of blocks of each source. Shards then take disjoint runs of the
   source's permuted draws, and a document's place in its shard is its hash under the shard's seed.

All is a function of the rows and the seed: reruns, retries and other partitionings agree.

Only a row per source and one per block reach the driver. Sources are assumed to be a vocabulary
(SOURCES at most, else ValueError), not a key; documents are never collected.

Cases: a null text has no words; a document without words is in its source's whole passes like any other;
a null source is a source of its own, last in order; a source without words has target 0 and, for want of a
size, draws nothing; rows repeated (same id and text) are drawn alike, so
where one row alone makes up much of a source its words are taken for all copies or none; extra columns are kept by
``mix``; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, map_batches, text_of

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 42
BLOCKS, SHARDS, SOURCES = 4096, 64, 100_000


def _keys(docs: DataFrame, seed: int) -> DataFrame:
    doc, text = F.col("doc_id").cast("bigint"), text_of()
    return docs.withColumns({"_gl_source": F.col("source").cast("string"), "_gl_h": F.xxhash64(F.lit(seed), doc, text), "_gl_th": F.xxhash64(text)})


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size (words of the text, cut at ASCII white space) and the keys: source, hash of id and text, hash of the text."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns[:4], pa.array([len(t.split()) for t in batch.column(4).to_pylist()], pa.int64())], names=["doc_id", "_gl_source", "_gl_h", "_gl_th", "size"])

    rows = _keys(docs.select("doc_id", "source", "text"), seed).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_gl_source", "_gl_h", "_gl_th", text_of().cast("binary").alias("bytes"))
    return map_batches(rows, words, "doc_id bigint, _gl_source string, _gl_h bigint, _gl_th bigint, size bigint")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: shares by weight of ``share`` times all words, none above ``most`` times its own."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * float(sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources): every node deals its quotas between its halves."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        mid = (low + high) // 2
        all_ = int(own.sum())
        # The left child gets its share of the node's blocks; the odd ones by an unbiased draw.
        exact = all_ * (mid - low) / (high - low)
        n = int(exact) + int(rng.random() < exact - int(exact))
        left = rng.multivariate_hypergeometric(own, n, method="marginals") if all_ else own
        todo += [(low, mid, left), (mid, high, own - left)]
    return out


class Plan:
    """What a mixture takes: a bounded table of sources and one of blocks, from which each row's draws follow without a shuffle."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> None:
        self.seed, spark = seed, docs.sparkSession
        self.measured = cut(measure(docs, seed))
        found = self.measured.groupBy("_gl_source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()
        if len(found) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        order = sorted(found, key=lambda r: (r["_gl_source"] is None, (r["_gl_source"] or "").encode()))
        sizes = [int(r["size"]) for r in order]
        want = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, most)
        words = max(1, sum(sizes))
        table = [(r["_gl_source"], i, s, t, max(1, math.ceil(blocks * s / words))) for i, (r, s, t) in enumerate(zip(order, sizes, want, strict=True))]
        self.sources = spark.createDataFrame(table, "_gl_of string, _gl_k int, _gl_size long, _gl_target double, _gl_blocks int")

        placed = self.place(self.measured)
        by_block: dict[int, dict[int, int]] = {}  # blocks + SOURCES entries at most
        for r in placed.groupBy("_gl_k", "_gl_block").agg(F.sum("size").alias("size")).collect():
            by_block.setdefault(r["_gl_k"], {})[r["_gl_block"]] = int(r["size"])
        rng = np.random.default_rng(seed)
        whole: list[list[int]] = []  # of each source the blocks drawn, in order
        edges: dict[int, tuple[int, int]] = {}  # of a source the block that is drawn in part, and the words wanted of it
        for k, size in enumerate(sizes):
            here, rest, mine = by_block.get(k, {}), want[k], []
            names = sorted(here)
            while size and rest > 0.5:
                skipped = -1
                for b in rng.permutation(len(names)):
                    block = names[int(b)]
                    if here[block] <= rest:
                        mine.append(block)
                        rest -= here[block]
                    elif skipped < 0:
                        skipped = block
                if skipped >= 0:  # the last pass: what no whole block fits comes from the first that was too large
                    edges[k] = (skipped, round(rest))
                    break
            whole.append(mine)
        quotas = np.array([len(m) + (k in edges) for k, m in enumerate(whole)], dtype=np.int64)
        dealt = split_tree(quotas, shards, rng)
        self.quotas, self.dealt = quotas, dealt

        cuts = {}
        if edges:
            edge = spark.createDataFrame([(k, b, n) for k, (b, n) in edges.items()], "_gl_k int, _gl_block int, want long")
            # One block of each source is put in order, in two steps so that no task holds a block: the stretch of
            # hashes (4,096 of equal length) where the words wanted end, then its rows; those of one id and text count as one.
            rows = placed.join(F.broadcast(edge), ["_gl_k", "_gl_block"]).withColumn("sub", F.shiftright("_gl_h", 52))
            run = Window.partitionBy("_gl_k").orderBy("sub")
            subs = rows.groupBy("_gl_k", "want", "sub").agg(F.sum("size").alias("size")).withColumn("past", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            subs = subs.where("past <= want").groupBy("_gl_k").agg(F.max(F.struct("sub", "past")).alias("x")).select("_gl_k", "x.sub", "x.past")
            run = Window.partitionBy("_gl_k").orderBy("_gl_h", "_gl_th")
            rows = rows.join(F.broadcast(subs), ["_gl_k", "sub"]).groupBy("_gl_k", "want", "sub", "past", "_gl_h", "_gl_th").agg(F.sum("size").alias("size"))
            rows = rows.withColumn("before", F.col("past") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            fits = F.when(F.col("before") + F.col("size") / 2 <= F.col("want"), F.struct("_gl_h", "_gl_th"))
            for r in rows.groupBy("_gl_k").agg(F.max(fits).alias("last"), F.min("sub").alias("sub")).collect():
                cuts[r["_gl_k"]] = r["last"] or (max(-(1 << 63), (r["sub"] << 52) - 1), (1 << 63) - 1)

        draws: dict[tuple[int, int], list] = {}
        for k, mine in enumerate(whole):
            # Draws are in permuted order and each shard takes the next run of them: disjoint and exact.
            shard_of = np.repeat(np.arange(shards), dealt[:, k]).tolist()
            for b, s in zip(mine, shard_of, strict=False):
                draws.setdefault((k, b), [[], None, None, None])[0].append(s)
            if k in edges and k in cuts:
                draws.setdefault((k, edges[k][0]), [[], None, None, None])[1:] = [shard_of[-1], *cuts[k]]
        self.blocks = spark.createDataFrame([(k, b, *v) for (k, b), v in draws.items()], "_gl_k2 int, _gl_block2 int, _gl_shards array<int>, _gl_edge int, _gl_cut_h long, _gl_cut_th long")

    def place(self, rows: DataFrame) -> DataFrame:
        """Source and block of rows with keys; the broadcast table has at most SOURCES rows."""
        rows = rows.join(F.broadcast(self.sources), F.col("_gl_source").eqNullSafe(F.col("_gl_of"))).drop("_gl_of")
        return rows.withColumn("_gl_block", F.pmod(F.xxhash64(F.lit(self.seed), "_gl_h"), F.col("_gl_blocks")).cast("int"))

    def draw(self, rows: DataFrame) -> DataFrame:
        """Placed rows with _gl_draws, a (shard, place) for each time they are taken; the broadcast table has at most blocks + SOURCES rows."""
        rows = rows.join(F.broadcast(self.blocks), (F.col("_gl_k") == F.col("_gl_k2")) & (F.col("_gl_block") == F.col("_gl_block2")), "left")
        taken = F.struct(F.col("_gl_h").alias("h"), F.col("_gl_th").alias("t")) <= F.struct(F.col("_gl_cut_h").alias("h"), F.col("_gl_cut_th").alias("t"))
        shards = F.coalesce("_gl_shards", F.array().cast("array<int>"))
        shards = F.when(F.col("_gl_edge").isNotNull() & taken, F.concat(shards, F.array("_gl_edge"))).otherwise(shards)
        return rows.withColumn("_gl_draws", F.transform(shards, lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(self.seed), s, i, F.col("_gl_h")).alias("place"))))


def mix_digest(docs: DataFrame) -> DataFrame:
    """A row per document: its size, its source's size and target, the words that the mixture takes of it, and the shards and places where it is taken, in order of shards."""
    plan = Plan(docs)
    rows = plan.draw(plan.place(plan.measured)).withColumn("_gl_draws", F.sort_array("_gl_draws"))
    joined = lambda name: F.array_join(F.transform("_gl_draws", lambda d: d[name].cast("string")), ",")
    taken = (F.size("_gl_draws") * F.col("size")).cast("bigint")
    return rows.select("doc_id", "size", F.col("_gl_size").alias("source_size"), F.col("_gl_target").alias("target"), taken.alias("taken"), joined("shard").alias("shards"), joined("place").alias("places"))


def mix(docs: DataFrame, ordered: bool = False, labels: bool = True, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with mix_shard and mix_place (instead of columns of these names, if there are any).

    Texts aren't shuffled unless ``ordered``: a row's draws follow from its own keys and two bounded tables. ``ordered`` puts
    all rows in the order of shards and places, cut into ranges of it, so that no partition holds a whole shard of a large corpus;
    without ``labels`` only the columns of ``docs`` are returned.
    """
    plan = Plan(docs, **options)
    out = plan.draw(plan.place(_keys(docs, plan.seed))).withColumn("_gl_draw", F.explode("_gl_draws"))
    shard, place = F.col("_gl_draw.shard"), F.col("_gl_draw.place")
    if ordered:
        out = out.repartitionByRange(shard, place).sortWithinPartitions(shard, place)
    if not labels:
        return out.select(*docs.columns)
    return out.select(*[c for c in docs.columns if c not in ("mix_shard", "mix_place")], shard.alias("mix_shard"), place.alias("mix_place"))
