"""Link graphs and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import cut

DAMPING, ROUNDS, CUT = 0.85, 40, 10


def link_edges(links: DataFrame, pages: DataFrame, normalize: bool = False) -> DataFrame:
    """src, dst for links (src, url) whose URL is a page's (id, url); no self links, repeats kept. ``normalize`` compares canonical URLs."""
    if normalize:
        links, pages = links.withColumn("url", T.normalize_url(F.col("url"))), pages.withColumn("url", T.normalize_url(F.col("url")))
    return links.join(pages.select(F.col("id").alias("dst"), "url"), "url").where("src <> dst").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """node, pagerank after a fixed number of rounds over a multigraph; what dangling nodes hold is spread over all.

    Repeated edges become one with a weight, and only what comes in over edges is kept: a node's rank is that,
    damped, and one number for all nodes, which follows from the total because ranks add up to 1. Nodes that no edge leads to all have that one number
    in every round, so what their edges bring is summed once (``_fixed``), and only edges from nodes that something leads to are walked again.
    Such a round is one join with edges that stay partitioned by their source, one sum, combined on the map side, and one number for the driver; where no such edge
    is left, as in a bipartite graph, it is one number alone. What a round gives is kept in memory and disk by the executors; every CUT rounds a reliable checkpoint
    cuts the lineage, which is what a lost executor costs at most.
    """
    nodes = cut(nodes.select("node").distinct())
    weighted = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("m")))
    out = weighted.groupBy("src").agg(F.sum("m").alias("d"))
    reached = weighted.select(F.col("dst").alias("src")).distinct().withColumn("_in", F.lit(1))
    sources = cut(out.join(reached, "src", "left").select("src", "d", F.col("_in").isNotNull().alias("live")))
    w = F.col("m") / F.col("d")
    shared = weighted.join(sources, "src").select("src", "dst", w.alias("w"), "live")
    fixed = cut(shared.where("NOT live").groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("_fixed")))
    constant = fixed.agg(F.sum("_fixed")).first()[0] or 0.0
    lively = bool(sources.where("live").limit(1).count())
    e = cut(shared.where("live").drop("live")).repartition("src").persist() if lively else None
    n = nodes.count()
    came, kept, same, damped = None, [], 1.0 / max(1, n), 0.0
    for i in range(rounds if n and lively else 0):
        if came is None:
            rows = e.select("dst", (F.col("w") * same).alias("x"))
        else:
            rows = e.join(came.withColumnRenamed("node", "src"), "src", "left").select("dst", (F.col("w") * (same + damped * F.coalesce("came", F.lit(0.0)))).alias("x"))
        rows = rows.union(fixed.select("node", F.col("_fixed") * same))
        came = rows.groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("came"))
        last = i == rounds - 1
        came = cut(came) if last or i % CUT == CUT - 1 else came.persist()
        loose = 1.0 - (came.agg(F.sum("came")).first()[0] or 0.0)
        same, damped = (1 - damping) / n + damping * loose / n, damping
        if last or i % CUT == CUT - 1:
            for old in kept:
                old.unpersist()
            kept = []
        else:
            kept.append(came)
    if not lively:
        before = same
        for _ in range(rounds if n else 0):
            before, damped = same, damping
            same = (1 - damping) / n + damping * (1.0 - before * constant) / n
        came = fixed.select("node", (F.col("_fixed") * before).alias("came")) if damped else None
        return nodes.select("node", F.lit(same).alias("pagerank")) if came is None else nodes.join(came, "node", "left").select("node", (same + damped * F.coalesce("came", F.lit(0.0))).alias("pagerank"))
    e.unpersist()
    if came is None:
        return nodes.select("node", F.lit(same).alias("pagerank"))
    return nodes.join(came, "node", "left").select("node", (same + damped * F.coalesce("came", F.lit(0.0))).alias("pagerank"))
