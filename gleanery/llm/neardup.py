"""Near-duplicates for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. SimHash: fingerprints of the same shingles within RADIUS bits (``simhash.links``) name a leader for each of
   their texts; what is really similar to its leader is linked. That joins the close copies for a row each.
2. Prefixes find what fingerprints miss. Two texts this similar share a shingle among the first
   n - ceil(4n/5) + 1 of their n, in any order common to all texts. Of the texts that meet at a shingle each is
   compared with the least of them; what is similar has that one as its leader, and what is linked by now is a group.
3. Texts that meet, of different groups, are compared unless their leaders rule it out: distances obey the
   triangle, a text is at most 0.2 from its leader, so leaders of a similar pair are at most 0.6 apart. Pairs of leaders
   are met first and only texts of the pairs that are left are, so that two families of copies cost one comparison, and no pair is missed.
   How many shingles of their prefixes two texts share bounds what they share in all (``_often``), so those that meet by chance are never compared.
4. Sketches spare most comparisons of sets: a text's shingles as 16-bit numbers, whose common multiset bounds from above what
   the sets share. Every link is verified on the whole sets (9 |a & b| >= 4 (|a| + |b|)); components of links are groups.

The order puts frequent shingles last, so that boilerplate isn't where texts meet. Frequencies come from a
sample of the texts (one in EVERY, by hash) and at most HOT shingles are kept; they only decide how many pairs are compared, not what is found.

Scale: a fifth of the shingles is shuffled, as two longs each; shingles that only one text or one group has go before pairs
are made; copies within a task emit theirs once. Sketches and sets are made only of texts in a pair, and shuffled once as they are and once for each pair.
Texts aren't shuffled unless more than ``simhash.BROADCAST`` of them are to go or to be compared.

Cases: words are cut at ASCII white space, A-Z in lower case; fewer words than a shingle make one
shingle of all words, none an empty one; a null text is empty; ids, repeated rows, extra and empty tables as in ``simhash``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, map_batches, text_of
from gleanery.llm.simhash import components, fingerprint, keep_rows, links, rows_of, shingle_hashes

SHINGLE, RADIUS, EVERY, HOT, SEEN = 5, 2, 16, 500_000, 100_000


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of a text as signed longs, in order."""
    return np.unique(shingle_hashes(text, SHINGLE).astype(np.uint64).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().cast("binary").alias("bytes"))


def _prefixed(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """th, n and prefix (the shingles at which a text can meet similar ones)."""
    known, times = hot

    def prefix(x: np.ndarray) -> np.ndarray:
        if len(known):
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            x = x[np.lexsort((x, np.where(known[at] == x, times[at], 0)))]
        return x[: len(x) - (4 * len(x) + 4) // 5 + 1]

    seen: set[int] = set()  # texts of this task, up to a bound: a copy meets what its like has met

    def new(th: int) -> bool:
        if th in seen:
            return False
        if len(seen) < SEEN:
            seen.add(th)
        return True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) if new(th) else np.zeros(0, np.int64) for th, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([prefix(x) for x in sets], pa.list_(pa.int64()))], names=["th", "n", "prefix"])

    return map_batches(_texts(docs), run, "th bigint, n bigint, prefix array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(1), pa.array([shingle_set(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["th", "set"])

    return map_batches(texts, run, "th bigint, set array<bigint>")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample have, and how many: HOT at most, the most frequent."""
    sample = _sets(_texts(docs).where(F.pmod(F.xxhash64(F.lit(EVERY), "th"), F.lit(EVERY)) == 0)).dropDuplicates(["th"])
    found = sample.select(F.explode("set").alias("s")).groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(HOT).toPandas().sort_values("s")
    return found["s"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _sketches(texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.sort((shingle_set(t) & 0xFFFF).astype(np.uint16)).tobytes() for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(1), pa.array(found, pa.binary())], names=["th", "set"])

    return map_batches(texts, run, "th bigint, set binary")


def _beside(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, what) -> DataFrame:
    """``pairs`` (a, b: hashes of texts) with sa and sb, what is made of their texts."""
    need = pairs.select(F.col("a").alias("th")).union(pairs.select("b")).distinct().join(firsts.select("th", "doc_id"), "th")
    made = what(_texts(rows_of(docs, cut(need), "left_semi"))).dropDuplicates(["th"])
    return pairs.join(made.toDF("a", "sa"), "a").join(made.toDF("b", "sb"), "b")


def shared(x: bytes, y: bytes) -> int:
    """How many numbers two sketches have in common, repeats as often as both have them."""
    a, b = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    values, first = np.unique(both, return_index=True)
    low = np.searchsorted(a, values), np.searchsorted(b, values)
    high = np.searchsorted(a, values, "right"), np.searchsorted(b, values, "right")
    return int(np.minimum(high[0] - low[0], high[1] - low[1]).sum()) if len(first) else 0


def _possible(docs: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, least: the least similarity that is asked for, in percent) without those that the sketches rule out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, least, sa, sb = (c.to_pylist() for c in batch.columns)
        kept = [i for i in range(len(a)) if (100 + least[i]) * shared(sa[i], sb[i]) >= least[i] * (len(sa[i]) + len(sb[i])) // 2]
        return pa.record_batch([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64()), pa.array([least[i] for i in kept], pa.int32())], names=["a", "b", "least"])

    return cut(map_batches(_beside(docs, firsts, pairs, _sketches).select("a", "b", "least", "sa", "sb"), run, "a bigint, b bigint, least int"))


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` that are similar."""
    both = _beside(docs, firsts, pairs, _sets)
    return cut(both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))


def _linked(docs: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    possible = _possible(docs, firsts, cut(pairs.withColumn("least", F.lit(80))))
    return _verified(docs, firsts, possible.select("a", "b"))


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' keys (doc_id, th), and for each text that is similar to another th and root (th of its group)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(shingle_hashes(t, SHINGLE)) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "th", "fp"])

    rows = cut(map_batches(_texts(docs), run, "doc_id bigint, th bigint, fp bigint"))
    firsts = cut(rows.groupBy("th").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("doc_id")))
    near = components(links(firsts.select("fp").distinct(), RADIUS))
    led = firsts.join(near.toDF("fp", "root"), "fp", "left").select("th", F.coalesce("root", "fp").alias("root"))
    led = led.withColumn("b", F.min("th").over(Window.partitionBy("root"))).where("th <> b").select(F.col("th").alias("a"), "b")
    close = _verified(docs, firsts, cut(led))
    at = Window.partitionBy("s")

    def meeting(rows: DataFrame, by: str) -> DataFrame:
        """Rows of shingles where more than one of ``by`` meet."""
        return rows.withColumns({"low": F.min(by).over(at), "high": F.max(by).over(at)}).where("low <> high").drop("low", "high")

    met = _prefixed(docs, _frequent(docs)).select("th", "n", F.explode("prefix").alias("s"))
    met = cut(meeting(met, "th").select("s", "th", "n").distinct())

    # Each text and the least that it meets, if they meet often enough at the least one's shingles; what this leaves out is compared below.
    first = met.select("s", F.struct("th", "n").alias("x")).groupBy("s").agg(F.min("x").alias("x")).select("s", F.col("x.th").alias("b"), F.col("x.n").alias("nb"))
    stars = met.select("s", F.col("th").alias("a"), F.col("n").alias("na")).join(first, "s").where("a <> b and 5 * least(na, nb) >= 4 * greatest(na, nb)")
    stars = stars.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(_often("least(na, nb)", "greatest(na, nb)"))
    close = cut(close.union(_linked(docs, firsts, stars.select("a", "b").join(close, ["a", "b"], "left_anti"))))
    group = components(close).toDF("th", "g")
    leader = close.groupBy(F.col("a").alias("th")).agg(F.min("b").alias("leader"))

    named = met.join(group, "th", "left").join(leader, "th", "left").select("s", "th", "n", F.coalesce("g", "th").alias("g"), F.coalesce("leader", "th").alias("leader"))
    met = cut(meeting(named, "g"))
    family = met.groupBy("leader").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("th") != F.col("leader")).alias("more"))
    led = met.select("s", "leader", "g").distinct()
    l, r = led.toDF("s", "a", "ga"), led.toDF("s", "b", "gb")
    heads = l.join(r, "s").where("a > b and ga <> gb").groupBy("a", "b").agg(F.count("*").alias("c"))
    heads = heads.join(family.toDF("a", "la", "ha", "ma"), "a").join(family.toDF("b", "lb", "hb", "mb"), "b")
    heads = heads.where("5 * ha >= 4 * lb and 5 * hb >= 4 * la").where(_often("least(la, lb)", "greatest(ha, hb)")).select("a", "b", F.when(F.col("ma") | F.col("mb"), 40).otherwise(80).alias("least"))
    heads = _possible(docs, firsts, cut(heads)).select("a", "b")
    a, b, both = met.toDF("s", "a", "na", "ga", "la"), met.toDF("s", "b", "nb", "gb", "lb"), heads.union(heads.select("b", "a")).toDF("la", "lb")
    pairs = a.join(both, "la").join(b, ["s", "lb"]).where("ga < gb and 5 * least(na, nb) >= 4 * greatest(na, nb)").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.where(_often("least(na, nb)", "greatest(na, nb)")).select("a", "b")
    return rows.select("doc_id", "th"), components(close.union(_linked(docs, firsts, pairs))).toDF("th", "root")


def _often(low: str, high: str) -> str:
    """Whether texts that share c shingles of their prefixes can be similar, from the least and the largest size.

    In the common order one prefix ends first, at a text of n shingles say: what the two share is in both prefixes up to there, or
    among the ceil(4n/5) - 1 shingles of that text that follow. So they share c + ceil(4n/5) - 1 at most, and need 4/9 of both sizes.
    """
    return f"45 * c >= 20 * {low} - 16 * {high} + 9"


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the one of the smallest doc_id (of several texts with that id, the one of the least hash)."""
    rows, roots = similar(docs)
    rows = rows.groupBy("doc_id", "th").count().join(roots, "th", "left").withColumn("root", F.coalesce("root", "th"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th"))
    keep = rows.groupBy("root").agg(first.alias("keep")).select("root", F.col("keep.doc_id").alias("keep_id"), F.col("keep.th").alias("keep_th"))
    keys = cut(rows.join(keep, "root").select("doc_id", "th", "count", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))).alias("stays")))
    return keep_rows(docs, keys)
