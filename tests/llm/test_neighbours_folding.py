"""Rows of one vec_id count once before a block's cut."""

import numpy as np

from gleanery.llm import ann


def test_an_id_repeated_more_than_k_times(spark):
    rnd = np.random.default_rng(1)
    rows = [(100, [1.0, 0.0, 0.0, 0.0])] + [(7, [1.0, 0.001 * i, 0.0, 0.0]) for i in range(12)] + [(9, [1.0, 0.0, 0.02, 0.001 * i]) for i in range(8)]
    rows += [(i, [1.0, *(0.3 + 0.3 * rnd.random(3)).tolist()]) for i in range(11, 31)]
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2), float(ann.score(np.array(rows[0][1]), np.array([v]))[0]))
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (20_000, 6):  # whole, and buckets that are split
        got = ann.search(df, df.where("vec_id = 100"), part_rows=parts).toPandas().sort_values("rank")
        assert got.vec_id.tolist() == want
    few = spark.createDataFrame([r for r in rows if r[0] in (100, 7, 9, 11)], df.schema)
    assert ann.search(few, few.where("vec_id = 100")).toPandas().sort_values("rank").vec_id.tolist() == [7, 9, 11]
