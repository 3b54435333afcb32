"""Steps that were made to grow with their input: the same results as plain definitions, and less work."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vector as V
from gleanery.operators import index as I
from gleanery.operators import rank, retrieve, semantic
from gleanery.plans import live, more


def _plain_pmi(texts, window, threshold, most):
    one, two, n = Counter(), Counter(), 0
    for t in texts:
        ws = [w for w in t.lower().split() if len(w) > 1 and w not in T.STOP_WORDS]
        for i in range(len(ws) - window + 1):
            own = sorted(set(ws[i : i + window]))
            n += 1
            one.update(own)
            two.update(combinations(own, 2))
    near = {}
    for (a, b), c in two.items():
        v = math.log(c * n / (one[a] * one[b]))
        if round(v, 9) >= threshold:
            near.setdefault(a, []).append((-round(v, 9), b))
            near.setdefault(b, []).append((-round(v, 9), a))
    return {(a, i + 1, b) for a, bs in near.items() for i, (_, b) in enumerate(sorted(bs)[:most])}


def test_pmi_counts_windows_by_places_and_sends_asked_pairs_only(spark):
    r = random.Random(3)
    words = ["ab", "cd", "ef", "é1", "gh", "the", "x", "ij", "kl", "mn", "op"]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 3, 4, 5, 6, 40, 200)] + ["ab ab ab ab ab ab", "ab cd ab cd ab cd"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string").repartition(3)
    for window in (2, 5):
        expected = _plain_pmi(texts, window, 0.05, 3)
        rows = {(r["term"], r["rank"], r["neighbour"]) for r in semantic.pmi(docs, window, 0.05, 3).collect()}
        assert rows == expected and expected
        some = spark.createDataFrame([("ab",), ("é1",), ("absent",)], "word string")
        rows = {(r["term"], r["rank"], r["neighbour"]) for r in semantic.pmi(docs, window, 0.05, 3, some).collect()}
        assert rows == {x for x in expected if x[0] in ("ab", "é1")}
    sent = [semantic._windows(docs, 5, asked).where("a <> b").count() for asked in (None, ["é1"])]
    places = sum(max(0, len(t.split())) for t in texts)
    assert sent[1] < sent[0] <= 4 * places


def test_pmi_sends_packed_numbers_and_joins_nothing(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{int(40 * r.paretovariate(0.6))}" for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 60))) for _ in range(120)] + ["the x the", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = _plain_pmi([t or "" for t in texts], 5, 1.0, 5)
    rows = lambda d: {(x["term"], x["rank"], x["neighbour"]) for x in d.collect()}
    found = semantic.pmi(docs)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == expected and len(expected) > 500
    with monkeypatch.context() as m:  # many buckets
        m.setattr(semantic, "BUCKET", 400)
        assert rows(semantic.pmi(docs)) == expected
    with monkeypatch.context() as m:  # more words than may be numbered
        m.setattr(semantic, "NUMBERED", 10)
        assert rows(semantic.pmi(docs)) == expected


def test_pairs_are_packed_and_summed_without_loss():
    r = np.random.default_rng(4)
    for top, many in ((50, 9), (1 << 50, 9), (50, 1 << 40), (1 << 50, 1 << 40)):
        pairs, counts = r.integers(0, top, 700), r.integers(1, many, 700)
        got, sums = semantic._summed(pairs, counts)
        plain = Counter()
        for p, c in zip(pairs.tolist(), counts.tolist(), strict=True):
            plain[p] += c
        assert list(zip(got.tolist(), sums.tolist(), strict=True)) == sorted(plain.items())
        again = semantic._unpack(semantic._pack(got, sums))
        assert (again[0] == got).all() and (again[1] == sums).all()
    for words, buckets in ((1, 8), (7, 3), (100, 7)):
        places, ids = semantic._Places(words, buckets), np.arange(words)
        first, second = places.split(places.of(ids) << places.bits | ids[::-1])
        assert (first == ids).all() and (second == ids[::-1]).all()


def test_best_pairs_keep_ties_by_name_and_what_rounding_may_tie():
    r = np.random.default_rng(6)
    term, other = r.integers(0, 30, 3000), np.arange(3000)
    x = r.integers(1, 60, 3000) * np.where(r.random(3000) < 0.3, 1 + 2e-10, 1.0)
    some = semantic._best(term, other, x, 4, 30)
    order = lambda at: sorted(at, key=lambda i: (-round(math.log(x[i]), 9), other[i]))
    for t in range(30):
        assert order(np.flatnonzero(term == t))[:4] == order([i for i in some if term[i] == t])[:4]
    assert len(some) < 1000


def test_names_that_share_a_hash_get_another_seed(monkeypatch):
    names, plain = pa.array(["ab", "ba", "é", "longer", "a" * 99, "ñ1"]), semantic._hashes
    assert (semantic._hashes(names.slice(2, 3), 0) == semantic._hashes(names, 0)[2:5]).all()
    monkeypatch.setattr(semantic, "_hashes", lambda n, seed: plain(n, seed) // np.uint64(1 << 63) if seed < 3 else plain(n, seed))
    known, ids, seed = semantic._by_hash(names)
    assert seed == 3 and (ids[np.searchsorted(known, plain(names, 3))] == np.arange(len(names))).all()


def _pages(spark, folder):
    rows = [(1, "https://h.test/a", "one"), (2, "https://h.test/a", "other"), (4, "https://h.test/a", ""), (3, None, "three"), (6, "https://h.test/b", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return [(str(i), u, None if h is None else len(h)) for i, u, h in rows]


def test_crawl_log_keeps_pages_that_share_a_url(spark, tmp_path):
    expected = _pages(spark, tmp_path)
    assert sorted(tuple(r) for r in more.QUERIES["crawl_log"](spark, str(tmp_path)).collect()) == sorted(expected)


def test_crawl_store_keeps_pages_that_share_a_url(spark, tmp_path):
    expected = _pages(spark, tmp_path)
    assert sorted(tuple(r) for r in live.QUERIES["crawl_store"](spark, str(tmp_path)).collect()) == sorted((i, u, "new", n) for i, u, n in expected)


def _some(spark):
    r = random.Random(5)
    words = ["running", "passes", "tied", "feed", "bigger", "the", "Straße", "x1", "dogs", "all", "boxed", "ings", "eed"]
    return spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(150)] + [(200, None), (201, "...")], "doc_id long, text string").repartition(3)


def test_stemmed_is_stem(spark):
    words = sorted({a + b for a in ("", "a", "be", "pas", "ti", "hopp", "fall", "gre", "ing", "é") for b in ("", "s", "es", "ses", "sses", "ies", "ed", "eed", "ing", "ings", "er", "ers", "nn", "ll", "ered", "dd", "éé")} - {""})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert [(r["w"], r["s"]) for r in rows] == [(r["w"], T.stemmed(r["w"])) for r in rows]


def test_restricted_index_scores_without_a_shuffle(spark):
    docs = _some(spark)
    terms = retrieve.query_terms(spark.createDataFrame([(1, "running dogs"), (2, "pass tied feed dogs big"), (3, "nothing"), (4, "the")], "query_id int, text string"))
    whole, part = I.build(docs, positions=False), I.restricted(docs, terms)
    plain = {(r["query_id"], r["doc_id"]): round(r["bm25"], 9) for r in rank.bm25(whole, terms).collect()}
    scored = rank.bm25(part, terms)
    assert plain and {(r["query_id"], r["doc_id"]): round(r["bm25"], 9) for r in scored.collect()} == plain
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    key = lambda d: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in d.collect())
    for k in (1, 4, 500):
        assert key(rank.bm25_top(part, terms, k)) == key(rank.ranked(rank.bm25(whole, terms), k, "bm25"))
    assert sorted(map(tuple, part.stats.collect())) == sorted(map(tuple, whole.stats.select("doc_id", "doc_len").collect()))


def test_embedded_is_the_dense_hash_embedding(spark):
    docs = _some(spark)
    a, b = ({r[0]: list(r[1]) for r in d.collect()} for d in (V.embedded(docs), V.dense(V.hash_embedding(docs))))
    assert a == b and a


def test_built_index_is_saved_from_one_analysis(spark, tmp_path):
    index = I.build(_some(spark), positions=True)
    index.postings = index.postings.limit(0)  # saving groups the tokens itself and doesn't need them
    index.save(str(tmp_path))
    whole, again = I.build(_some(spark)), I.load(spark, str(tmp_path))
    for t in ("postings", "dictionary", "stats", "corpus"):
        a, b = getattr(whole, t), getattr(again, t)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect())), t
