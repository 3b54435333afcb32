"""What the splitting tree deals is what the query returns."""

import random

import numpy as np
import pytest

from gleanery.llm import mixing


def table(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(1, 60), rnd.choice("aaaaaabbc")) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_draws_are_dealt_by_the_tree(spark):
    plan = mixing.Plan(table(spark), shards=8, blocks=512)
    blocks = [r.asDict() for r in plan.blocks.collect()]
    for k in range(3):
        dealt = np.bincount([s for b in blocks if b["_gl_k2"] == k for s in [*b["_gl_shards"], *([] if b["_gl_edge"] is None else [b["_gl_edge"]])]], minlength=8)
        assert dealt.tolist() == plan.dealt[:, k].tolist() and dealt.sum() == plan.quotas[k]
    # Every row's draws, made anew from the bounded table alone.
    by = {(b["_gl_k2"], b["_gl_block2"]): b for b in blocks}
    for r in plan.draw(plan.place(plan.measured)).collect():
        b = by.get((r["_gl_k"], r["_gl_block"]))
        want = list(b["_gl_shards"]) if b else []
        if b and b["_gl_edge"] is not None and (r["_gl_h"], r["_gl_th"]) <= (b["_gl_cut_h"], b["_gl_cut_th"]):
            want.append(b["_gl_edge"])
        assert [d["shard"] for d in r["_gl_draws"]] == want


def test_the_query_returns_shards_and_places(spark):
    df = table(spark)
    got = mixing.mix_digest(df).toPandas()
    words = np.zeros(mixing.SHARDS)
    for r in got.itertuples():
        shards, places = [x.split(",") if x else [] for x in (r.shards, r.places)]
        assert len(shards) == len(places) and len(shards) * r.size == r.taken and shards == sorted(shards, key=int)
        for s in shards:
            words[int(s)] += r.size
    assert (words > 0).all() and words.max() < 2 * words.mean() and words.sum() == got.taken.sum()
    mixed = mixing.mix(df, ordered=True).toPandas()
    assert np.array_equal(np.bincount(mixed.mix_shard, [len(t.split()) for t in mixed.text], mixing.SHARDS), words)
    assert list(zip(mixed.mix_shard, mixed.mix_place, strict=True)) == sorted(zip(mixed.mix_shard, mixed.mix_place, strict=True))
    plain = mixing.mix(df, ordered=True, labels=False)
    assert plain.columns == df.columns and [r["doc_id"] for r in plain.collect()] == mixed.doc_id.tolist()


def test_one_large_block_is_cut_where_its_words_end(spark):
    """One block a source: all of the rest comes from the ordered stretch."""
    df = table(spark)
    plan = mixing.Plan(df, blocks=1)
    rows = plan.draw(plan.place(plan.measured)).toPandas()
    rows["n"] = rows._gl_draws.map(len)
    for _, g in rows.groupby("_gl_k"):
        g = g.sort_values(["_gl_h", "_gl_th"])
        assert (g.n.diff().dropna() <= 0).all()  # a prefix of the block is drawn once more
        assert abs((g.n * g["size"]).sum() - g._gl_target.iloc[0]) <= 30 + 1


def test_own_columns_of_the_shard_names(spark):
    df = table(spark).selectExpr("*", "source AS mix_shard")
    assert mixing.mix(df, labels=False).columns == df.columns
    out = mixing.mix(df)
    assert out.columns.count("mix_shard") == 1 and dict(out.dtypes)["mix_shard"] == "int"


@pytest.mark.parametrize("shards", [1, 5])
def test_tree_of_few_shards(shards):
    quotas = np.array([9, 4])
    assert (mixing.split_tree(quotas, shards, np.random.default_rng(0)).sum(axis=0) == quotas).all()
