"""Steps whose work or memory must not grow faster than their input."""

import numpy as np
import pytest
from gleanery.operators import graph, rank, vectorindex


def test_pagerank_walks_no_edge_again_that_starts_where_none_leads(spark):
    edges = [(s, 10 + (s * i) % 7) for s in range(5) for i in range(4)]
    sc, n = spark.sparkContext, 17
    sc.setJobGroup("bipartite", "")
    got = {x["node"]: x["pagerank"] for x in graph.pagerank(spark.range(n).toDF("node"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    sc.setJobGroup("other", "")
    assert len(sc.statusTracker().getJobIdsForGroup("bipartite")) < 40  # there are 40 rounds
    out, r = np.bincount([s for s, _ in edges], minlength=n), np.full(n, 1 / n)
    for _ in range(40):
        new = np.full(n, 0.15 / n + 0.85 * r[out == 0].sum() / n)
        for s, d in edges:
            new[d] += 0.85 * r[s] / out[s]
        r = new
    assert got == pytest.approx(dict(enumerate(r)))


def test_best_cells_and_lists_whose_queries_are_split(spark, monkeypatch):
    r = np.random.default_rng(5)
    scores, ids = np.round(r.random((40, 90)), 1), r.permutation(90)
    row, at, s = rank.best_cells(scores, ids, 6)
    assert (s == scores[row, at]).all()
    assert [ids[at[row == i]].tolist() for i in range(40)] == [ids[np.lexsort((ids, -x))[:6]].tolist() for x in scores]
    monkeypatch.setattr(vectorindex, "PART", 20)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(70, 8)))], "doc_id long, vec array<double>")
    q = v.toDF("query_id", "vec")
    centres = vectorindex.fit(v, 3)
    pick = lambda d: sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in d.collect())
    assert pick(vectorindex.search(vectorindex.build(v, centres), centres, q, 4, 3)) == pick(rank.vector_top(v, q, 4))


def test_index_of_a_stated_query_is_the_whole_index_of_its_words(spark):
    from gleanery.operators import index as I
    from gleanery.plans import search

    docs = spark.createDataFrame([(1, "The java, java compiler"), (2, ""), (None, "compilers of java"), (3, "stone and compiler java compiler")], "doc_id long, text string")
    found = search.asked_index(docs, 'java AND "the compiler" AND NOT lamp')
    assert found.names is not None
    want = I.postings(docs).where("term IN ('java', 'compil')")
    pick = lambda d: sorted(str((x["term"], x["doc_id"], x["tf"], x["positions"])) for x in d.collect())
    assert pick(found.postings) == pick(want) and want.count() == 6
    assert pick(found.postings.where("false")) == []
