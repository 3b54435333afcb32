"""Pruned ranking, vector lists, expansion, snapshots, versions, hot lists and coding on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import frontier, graph, learn, placement, rank, retrieve, semantic, vectorindex
from gleanery.operators import index as I
from gleanery.session import drop_folder, shared_folder
from gleanery.sources import stores


def texts(spark, n=300, seed=1):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7)) % 90}" for _ in range(5000)]
    return spark.createDataFrame([(i * 7, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(n)], "doc_id long, text string")


def test_block_max_finds_what_a_whole_ranking_finds(spark):
    docs = texts(spark)
    queries = spark.createDataFrame([(0, "w1 w2 w77"), (1, "w5 w5 w13"), (2, "w88"), (3, "nothing there"), (4, "w1")], "query_id int, text string")
    terms = retrieve.query_terms(queries)
    index = I.build(docs, positions=False)
    want = rank.ranked(rank.bm25(index, terms), 7, "bm25").select("query_id", "rank", "doc_id").collect()
    for size in (50, 400, 10**6):
        impacts, blocks = rank.impact_blocks(index, size)
        got = rank.block_max_top(index, impacts, blocks, terms, 7, probe=1).select("query_id", "rank", "doc_id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_restricted_index_is_the_whole_one_for_its_terms(spark):
    docs = texts(spark).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the of")], "doc_id long, text string"))
    queries = spark.createDataFrame([(0, "w1 w2 running"), (1, "absent")], "query_id int, text string")
    terms = retrieve.query_terms(queries)
    whole, part = I.build(docs, positions=False), I.restricted(docs, terms)
    assert sorted(map(str, rank.bm25(whole, terms).collect())) == sorted(map(str, rank.bm25(part, terms).collect()))
    assert whole.corpus.collect() == part.corpus.collect()


def test_vector_lists_and_scans_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12))
    x[5], x[6] = 0.0, x[7]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    q = v.where("doc_id % 40 = 7").toDF("query_id", "vec")
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    want = {i: [int(j) for j in np.lexsort((np.arange(400), -np.round(unit @ unit[i], 6)))[:9]] for i in range(7, 400, 40)}
    for at_once in (4096, 3):
        got = rank.vector_top(v, q, 9, at_once).collect()
        assert {i: [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] for i in want} == want
    centres = vectorindex.fit(v, 8)
    index = vectorindex.build(v, centres)
    assert index.count() == 399 and index.where("doc_id = 5").count() == 0
    whole = vectorindex.search(index, centres, q, 9, 8).collect()
    assert {(r["query_id"], r["doc_id"]) for r in whole} == {(i, j) for i, js in want.items() for j in js}
    some = {(r["query_id"], r["doc_id"]) for r in vectorindex.search(index, centres, q, 9, 5).collect()}
    assert len(some & {(i, j) for i, js in want.items() for j in js}) >= 0.6 * 90
    assert vectorindex.search(index.where("false"), centres, q, 3).count() == 0 and vectorindex.fit(v.where("false")).size == 0


def test_numbers_and_gaps_of_lists_cut_into_stretches(spark):
    rnd = random.Random(2)
    rows = [("hot", d, 1) for d in rnd.sample(range(10**9), 3000)] + [("rare", 5, 2), ("rare", 10**9, 1), ("one", 77, 3)]
    posts = spark.createDataFrame(rows, "term string, doc_id long, tf int")
    lists = {t: sorted(d for x, d, _ in rows if x == t) for t in ("hot", "rare", "one")}
    assert {(r["term"], r["seq"]): r["doc_id"] for r in I.numbered(posts).collect()} == {(t, i): d for t, ds in lists.items() for i, d in enumerate(ds)}
    assert {(r["term"], r["doc_id"]): r["gap"] for r in I.gaps(posts).collect()} == {(t, d): d - ([0] + ds)[i] for t, ds in lists.items() for i, d in enumerate(ds)}
    assert I.gaps(posts.where("false")).count() == 0


def test_variable_byte_numbers():
    rnd = random.Random(4)
    numbers = [0, 1, 127, 128, 16383, 16384, 2**35, 2**62, *[rnd.getrandbits(rnd.randint(1, 62)) for _ in range(500)]]
    assert I._unvbyte(I._vbyte(np.array(numbers))) == numbers and I._vbyte(np.array([128])) == b"\x01\x80" and I._vbyte(np.array([], dtype=np.int64)) == b""
    assert I._unvbyte(b"") == []


def test_expansion_takes_the_first_synonyms(spark):
    thesaurus = spark.createDataFrame([("car", 1, "auto"), ("car", 2, "car"), ("car", 3, "van"), ("the", 1, "a")], "term string, rank int, neighbour string")
    q = spark.createDataFrame([(1, "The car Car stops")], "query_id int, text string")
    got = {(r["word"], r["expansion"], r["place"]) for r in semantic.expand_terms(q, thesaurus, 1).collect()}
    assert got == {("car", "car", 0), ("car", "auto", 1), ("stops", "stops", 0)}


def test_snapshots_versions_and_shards(spark, tmp_path):
    tasks = spark.createDataFrame([("/a", "IN_FLIGHT"), ("/b", "DONE"), ("/c", "QUEUED")], "url string, state string")
    frontier.snapshot(tasks, tasks.select("url"), str(tmp_path / "f"))
    back, known = frontier.restore(spark, str(tmp_path / "f"))
    assert {(r["url"], r["state"]) for r in back.collect()} == {("/a", "QUEUED"), ("/b", "DONE"), ("/c", "QUEUED")} and known.count() == 3
    root = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        I.load_current(spark, root)
    first = texts(spark, 5)
    assert I.publish(I.build(first), root, 2) == 1
    old = I.load_current(spark, root)
    assert I.publish(I.build(texts(spark, 9)), root, 2) == 2
    assert old.stats.count() == 5 and I.load_current(spark, root).stats.count() == 9
    rows = spark.createDataFrame([(1, s, s * 10 + i) for s in range(3) for i in range(s + 1)], "query_id int, shard int, doc_id int")
    assert learn.total_hits(rows).first()["total"] == 6
    got = placement.gather(rows, spark.createDataFrame([(0, True), (1, False), (2, True)], "shard int, in_time boolean")).collect()
    assert len(got) == 4 and all(r["partial"] for r in got)
    moved = placement.migrations(spark.createDataFrame([(str(i),) for i in range(50)], "key string"), 4, 5).collect()
    assert moved and all(r["from_shard"] != r["to_shard"] for r in moved)


def test_hashes_and_folders(spark):
    r = spark.createDataFrame([("",), ("a",), ("foobar",), ("é",)], "t string").select("t", T.fnv1a(F.col("t")).alias("f"), T.djb2(F.col("t")).alias("d")).collect()
    assert [x["f"] for x in r][:3] == [2166136261, 0xE40C292C, 0xBF9CF968] and [x["d"] for x in r][:2] == [5381, 177670]
    at = shared_folder(spark)
    spark.range(3).write.parquet(f"{at}/x")
    drop_folder(spark, f"{at}/x")
    drop_folder(spark, f"{at}/never")
    with pytest.raises(Exception):
        spark.read.parquet(f"{at}/x").count()


def test_served_features_are_of_the_last_impression(spark):
    raw = "f_bm25 double, f_pagerank double, f_title_match double, f_url_match double, f_term_overlap double, f_semantic double, f_doc_length long"
    log = spark.createDataFrame([("Q ", 1, 7, 0.9, 0.5, 0.0, 0.0, 0.0, 0.0, 9, 0.5, 9), ("q", 2, 8, 0.4, 0.25, 1.0, 0.0, 0.5, 0.0, 9, 0.5, 9)], f"query string, ts int, doc_id int, {raw}, max_pagerank double, max_length long")
    got = learn.served_features(log, spark.createDataFrame([("q", 7), ("q", 8), ("r", 8)], "query string, doc_id int")).collect()
    assert [(r["doc_id"], r["bm25"], r["pagerank_n"], r["doc_length"], r["position"]) for r in got] == [(8, 0.4, 0.5, 1.0, 1.0)]


def test_demo_corpus_is_linked(spark):
    docs, links = stores.demo_corpus(spark)
    pr = {r["node"]: r["pagerank"] for r in graph.pagerank(docs.select(F.col("doc_id").alias("node")), links).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-9 and max(pr, key=pr.get) in (1, 2)
