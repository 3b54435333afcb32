import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import language as L
from gleanery.functions import text as T
from gleanery.functions import vector as V
from gleanery.operators import analytics, evaluate, frontier, graph, learn, placement, rank, retrieve, semantic
from gleanery.operators import index as I
from gleanery.plans import search
from gleanery.sources import pages, stores, wordpiece

DOCS = [
    (1, "https://a.test/1", "Java", "Java is a language for programs"),
    (2, "https://b.test/2", "Python", "Python scripts and notebooks are short"),
    (3, "https://a.test/3", "Compilers", "the java compiler turns source, not compiler java"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, url string, title string, text string").cache()


@pytest.fixture(scope="module")
def index(docs):
    i = I.build(docs)
    return I.Index(i.postings.cache(), i.stats.cache(), i.dictionary.cache(), i.corpus.cache())


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def stem_rules(w):
    if len(w) <= 2:
        return w
    w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w.removesuffix("s")
    w = w[:-1] if w.endswith("eed") else w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else w
    w = w.removesuffix("er")
    return w[:-1] if len(w) > 2 and w[-1] == w[-2] and w[-1] not in "lsz" else w


def test_tokens_and_stems(spark):
    assert column(spark, ["One two-three, 4x!", "", None], T.tokens) == [["One", "two", "three", "4x"], [], []]
    words = "running runner runs agreed us glass classes ponies ties ied ed ing er err stopped falling buzzed aaa aaaa xx seed needs Added sses ss s".split()
    got = column(spark, words, T.stem)
    assert got == [stem_rules(w) for w in words] and got[:6] == ["run", "run", "run", "agre", "us", "glass"]


def test_text_functions(spark):
    assert column(spark, ["ﬁne x²", "plain"], T.nfkc) == ["fine x2", "plain"]
    assert column(spark, ["Marie Curie met The Queen and Pierre in Paris-Nord", None], T.entities) == [["Marie Curie", "Pierre", "Paris-Nord"], []]
    assert column(spark, ["hello", "Aa", "BB", "polygenelubricants"], T.code_hash) == [99162322, 2112, 2112, -2147483648]
    urls = ["HTTP://Ex.COM:80//a//b/?utm_source=x&b=2&a=1#f", "https://e.org", "ftp://e.org/x", "junk", "https://e.org:8443/x/", None, "https://u@e.org/p?FBCLID=1"]
    assert column(spark, urls, T.normalize_url) == ["http://ex.com/a/b?a=1&b=2", "https://e.org/", None, None, "https://e.org:8443/x", None, "https://u@e.org/p"]
    base = F.lit("https://h.test/d/p.html?q=1#z")
    assert column(spark, ["x", "/r", "//o.test/y", "?k", "#s", "http://z.test/"], lambda c: T.resolve_url(base, c)) == ["https://h.test/d/x", "https://h.test/r", "https://o.test/y", "https://h.test/d/p.html?k", "https://h.test/d/p.html?q=1#s", "http://z.test/"]
    assert column(spark, ["kitten", ""], lambda c: F.round(T.similarity(c, F.lit("sitting")), 4)) == [0.5714, 0.0]


def test_index(index):
    row = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.postings.collect()}
    assert row["java", 1] == (2, [0, 1]) and row["java", 3] == (2, [2, 8]) and row["compil", 3] == (3, [0, 3, 7])
    assert ("the", 3) not in row
    assert {r["term"]: r["df"] for r in index.dictionary.collect()}["java"] == 2
    c = index.corpus.first()
    assert (c["n_docs"], c["avg_len"]) == (3, (7 + 7 + 9) // 3)


def test_index_files_and_segments(spark, docs, index, tmp_path):
    index.save(str(tmp_path), 4)
    again = I.load(spark, str(tmp_path))
    assert sorted(map(str, again.postings.collect())) == sorted(map(str, index.postings.collect()))
    assert "PushedFilters: [In(term" in (p := I.lookup(again.postings, ["java", "python"])._jdf.queryExecution().toString()) or "In(term" in p
    merged = I.merge_segments([I.postings(docs.where("doc_id < 2")), I.postings(docs.where("doc_id >= 2"))])
    assert sorted(map(str, merged.collect())) == sorted(map(str, index.postings.collect()))
    coded = I.unvbyte(I.vbyte(I.gaps(index.postings), 2)).groupBy("term").agg(F.sum("gap").alias("last")).where("term = 'java'").first()
    assert coded["last"] == 3 and I._unvbyte(I._vbyte([0, 127, 128, 10**9])) == [0, 127, 128, 10**9]
    back = I.ungap(I.gaps(index.postings).selectExpr("term", "gap", "doc_id AS seq"))
    assert back.where("doc_id <> seq").count() == 0


@pytest.mark.parametrize(
    ("query", "want"),
    [("java AND language", [1]), ("java OR python", [1, 2, 3]), ('"java compiler"', [3]), ("NOT java", [2]), ("java AND NOT compiler", [1]), ("java python", [1, 2, 3]), ("java AND the", []), ('"the java"', []), ("(java OR python) AND short", [2]), ("nothing", [])],
)
def test_boolean(spark, index, query, want):
    assert ids(retrieve.matches(spark, index, L.parse_query(query))) == want


def test_prefix_fuzzy_wand(spark, index):
    assert ids(retrieve.prefix_docs(index, "compil")) == [3] and ids(retrieve.prefix_docs(index, "zz")) == []
    assert {r["term"]: r["distance"] for r in retrieve.fuzzy_terms(index.dictionary, "jave", 1).collect()} == {"java": 1}
    terms = spark.createDataFrame([(0, "java"), (0, "compil")], "query_id int, term string")
    assert [tuple(r) for r in retrieve.all_terms(index, terms).collect()] == [(0, 3, 5)]


def test_bm25_by_hand(spark, index):
    terms = spark.createDataFrame([(0, "java", 2), (0, "short", 1)], "query_id int, term string, qtf int")
    got = {r["doc_id"]: r["bm25"] for r in rank.bm25(index, terms).collect()}
    idf = lambda df: math.log((3 - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 7))
    assert got == pytest.approx({1: 2 * idf(2) * part(2, 7), 3: 2 * idf(2) * part(2, 9), 2: idf(1) * part(1, 7)})
    v = spark.range(1).select(rank.idf(F.lit(1000), F.lit(10)).alias("a"), rank.idf(F.lit(1000), F.lit(900)).alias("b")).first()
    assert (round(v["a"], 7), round(v["b"], 7)) == (4.5573795, 0.1058046)


def test_fusion_and_paging(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (1, 3, 5.0)], "query_id int, doc_id long, bm25 double")
    pr = spark.createDataFrame([(1, 0.5), (2, 0.1)], "node long, pagerank double")
    got = {(r["query_id"], r["doc_id"]): r["final"] for r in rank.fuse(rows, pr).collect()}
    assert got == pytest.approx({(0, 1): 0.25, (0, 2): 0.75, (1, 3): 0.5})
    many = spark.range(1, 26).selectExpr("0 AS query_id", "id AS doc_id", "double(100 - id) AS bm25")
    r = rank.ranked(many, 25, "bm25")
    assert ids(rank.page(r, 2, 10)) == list(range(11, 21)) and ids(rank.page(r, 0, 0)) == list(range(1, 11)) and len(ids(rank.page(r, 1, 999))) == 25


def test_rrf_and_hybrid(spark):
    one = spark.createDataFrame([(0, 0, 1, 7), (0, 0, 2, 3), (0, 0, 3, 9), (0, 1, 1, 3), (0, 1, 2, 5), (0, 1, 9, 5)], "query_id int, channel int, rank int, doc_id long")
    got = [(r["doc_id"], r["score"]) for r in rank.rrf(one).orderBy("rank").collect()]
    assert got == [(3, pytest.approx(1 / 62 + 1 / 61)), (7, pytest.approx(1 / 61)), (5, pytest.approx(1 / 62)), (9, pytest.approx(1 / 63))]
    a = spark.createDataFrame([(0, 1, 10.0), (0, 2, 5.0)], "query_id int, doc_id long, score double")
    b = spark.createDataFrame([(0, 2, 0.8), (0, 3, 0.4)], "query_id int, doc_id long, score double")
    assert {r["doc_id"]: r["score"] for r in rank.hybrid(a, b).collect()} == pytest.approx({1: 0.5, 2: 0.75, 3: 0.25})
    assert {r["doc_id"]: r["score"] for r in rank.hybrid(a, b, 1.0).collect()} == pytest.approx({1: 0.0, 2: 1.0, 3: 0.5})


def brute_snippet(body, terms, n=150):
    low = body.lower()
    best, at = -1, 0
    for i in range(max(0, len(body) - n) + 1):
        w = low[i : i + n]
        found = [w.find(t) for t in terms if t in w]
        value = len(found) + (1 - min([*found, len(w)]) / n) * 0.5
        if value > best:
            best, at = value, i
    return at


def test_snippets(spark):
    rng = np.random.default_rng(3)
    for _ in range(60):
        body = " ".join(rng.choice(["red", "blue", "green", "Deep", "sea"], rng.integers(1, 90)))
        terms = list(rng.choice(["blue", "deep", "see", "sea red"], 2, replace=False))
        at = brute_snippet(body, terms)
        s = rank.snippet(body, terms)
        plain = s.replace("**", "").removeprefix("..." if at else "")
        assert s.startswith("...") == (at > 0) and body[at : at + 150] == plain.removesuffix("..." if at + 150 < len(body) else "")
    assert rank.snippet("no hit here", ["zebra"]) == "no hit here" and rank.snippet("", ["a"]) == "" == rank.snippet(None, None)
    assert rank.snippet("The Sea", ["sea"]) == "The **Sea**" and rank.snippet("x" * 160, []) == "x" * 150 + "..."
    df = spark.createDataFrame([("A sea", ["sea"]), (None, None)], "text string, terms array<string>")
    assert [r["snippet"] for r in rank.snippets(df).collect()] == ["A **sea**", ""]


def test_diversity(spark):
    hosts = "aaaabbac"
    rows = spark.createDataFrame([(0, i, i + 1, f"https://{h}.test/{i}") for i, h in enumerate(hosts)], "query_id int, doc_id long, rank int, url string")
    assert [r["doc_id"] for r in rank.diversify(rows).orderBy("place").collect()] == [0, 1, 4, 5, 6, 7, 2, 3]


@pytest.mark.parametrize(("edges", "n"), [([(0, 1), (1, 2)], 3), ([(0, 1), (1, 2), (2, 0)], 3), ([(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (3, 4)], 5), ([], 2)])
def test_pagerank_is_dense_iteration(spark, edges, n):
    got = graph.pagerank(spark.range(n).toDF("node"), spark.createDataFrame(edges, "src long, dst long"))
    out = np.bincount([s for s, _ in edges], minlength=n) if edges else np.zeros(n)
    r = np.full(n, 1 / n)
    for _ in range(40):
        new = np.full(n, 0.15 / n + 0.85 * r[out == 0].sum() / n)
        for s, d in edges:
            new[d] += 0.85 * r[s] / out[s]
        r = new
    assert {x["node"]: x["pagerank"] for x in got.collect()} == pytest.approx(dict(enumerate(r)))


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "doc_id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vec array<double>")
    assert [(r["doc_id"], round(r["score"], 6)) for r in rank.vector_top(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (2, 0.707107)]
    e = V.dense(V.hash_embedding(spark.createDataFrame([(1, "Aa x y x!")], "doc_id long, text string"))).first()["vec"]
    assert len(e) == 128 and sum(x * x for x in e) == pytest.approx(1)
    want = np.zeros(128)
    for w in "aa x y x".split():
        h = 0
        for c in w:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        want[(h & 0x7FFFFFFF) % 128] += -1 if h >> 16 & 1 else 1
    assert e == pytest.approx((want / np.linalg.norm(want)).tolist())


def test_suggest_and_spell(spark):
    v = spark.createDataFrame([("search", 10), ("sea", 3), ("season", 3), ("seam", 1), ("deep sea", 2)], "word string, freq long")
    p = spark.createDataFrame([("SEA",), ("d",)], "prefix string")
    got = semantic.autocomplete(v, p, 3).orderBy("prefix", "rank").collect()
    assert [(r["prefix"], r["word"]) for r in got] == [("d", "deep sea"), ("sea", "sea"), ("sea", "search"), ("sea", "season")]
    assert got[1]["score"] == pytest.approx(math.log(4))
    near = semantic.spell(v, spark.createDataFrame([("seem",)], "word string")).orderBy("rank").collect()
    assert [(r["suggestion"], r["distance"]) for r in near] == [("seam", 1), ("sea", 2)]


def test_pmi(spark):
    texts = ["alpha beta filler one two"] * 3 + [f"x{i} y{i} z{i} w{i} v{i}" for i in range(20)] + ["too short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["term"], r["neighbour"]): r["pmi"] for r in semantic.pmi(docs).collect()}
    assert got["alpha", "beta"] == pytest.approx(math.log((3 / 23) / (3 / 23) ** 2)) and ("alpha", "x1") not in got and ("short", "too") not in got
    assert semantic.pmi(docs.where("false")).count() == 0
    assert max(sum(1 for a, _ in got if a == t) for t, _ in got) <= 5


def test_synonyms_and_entities(spark):
    s = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {(r["other"], r["hop"]) for r in semantic.two_hop(s).where("term = 'a'").collect()} == {("b", 1), ("c", 2)}
    d = spark.createDataFrame([(1, "Ada Lovelace", "Ada met Charles Babbage. Charles Babbage spoke."), (2, None, "Charles Babbage and Ada"), (3, None, None)], "doc_id long, title string, text string")
    e = semantic.entities(d)
    assert [(r["entity"], r["weight"]) for r in e.where("doc_id = 1").orderBy("rank").collect()] == [("Ada Lovelace", 3), ("Charles Babbage", 2), ("Ada", 1)]
    assert {(r["a"], r["b"]): r["weight"] for r in semantic.entity_edges(e).collect()}["Ada", "Charles Babbage"] == 2
    assert [r["entity"] for r in semantic.find_entities(semantic.entity_counts(e), "babb").collect()] == ["Charles Babbage"]


def test_metrics(spark):
    q = spark.createDataFrame([("q", d, g) for d, g in ((1, 3), (2, 1), (9, 2), (8, 0))] + [("none", 5, 1)], "query_id string, doc_id long, grade int")
    r = spark.createDataFrame([("q", 1, 1), ("q", 7, 2), ("q", 2, 3)], "query_id string, doc_id long, rank int")
    got = {x["query_id"]: x for x in evaluate.metrics(r, q).collect()}
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert got["q"]["ndcg"] == pytest.approx((3 + 1 / 2) / ideal) and got["q"]["average_precision"] == pytest.approx((1 + 2 / 3) / 3)
    assert (got["q"]["reciprocal_rank"], got["q"]["recall"], got["q"]["precision5"]) == pytest.approx((1, 2 / 3, 2 / 3))
    assert got["none"]["ndcg"] == 0 == got["none"]["recall"]
    p = evaluate.percentiles(spark.range(1, 11).selectExpr("1 AS g", "id AS x"), "x", ["g"]).first()
    assert (p["p50"], p["p95"], p["p99"], p["minimum"], p["maximum"]) == (5, 10, 10, 1, 10)


def test_clicks_and_training(spark):
    clicks = spark.createDataFrame([(" Java ", 3), ("java", 9), ("java", 1), ("other", 1)], "query string, doc_id long")
    seen = spark.createDataFrame([("java", 1, [7, 8]), ("Java", 2, [1, 2, 3])], "query string, ts long, docs array<long>")
    assert {(r["preferred"], r["other"]) for r in learn.preference_pairs(clicks, seen).collect()} == {(3, 1), (3, 2)}
    w = learn.train_pairwise([([1, 0, 0, 0, 0, 0, 0, 0], [0] * 8)] * 5)
    assert w[0] > learn.WEIGHTS[0] and w[1] < learn.WEIGHTS[1]
    assert learn.train_pairwise([]) == list(learn.WEIGHTS)
    shown = spark.createDataFrame([("a",), ("a",), ("b",)], "query string")
    done = spark.createDataFrame([("a", 2), ("c", 1)], "query string, position int")
    assert {r["query"]: r["ctr"] for r in learn.click_through(done, shown).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}


def test_features(spark):
    row = [("Java sea", "Java title", "https://x.test/java", "java java deep", 0.2, 1.5, 3)]
    raw = learn.raw_features(spark.createDataFrame(row, "query string, title string, url string, text string, pagerank double, cos double, doc_len int"))
    got = learn.normalized_features(raw, F.lit(0.4), F.lit(9), F.lit(1)).first()
    assert [got[c] for c in ("bm25", "pagerank_n", "title_match", "url_match", "term_overlap", "semantic", "doc_length", "position")] == pytest.approx([1 - math.exp(-math.log(3)), 0.5, 0.5, 0.5, 0.5, 1.0, math.log(4) / math.log(10), 0.5])


def test_shards_and_ring(spark):
    rows = spark.createDataFrame([(0, 0, 1, "u1", 9.0), (0, 0, 2, "u2", 8.0), (0, 1, 3, "u1", 11.0), (0, 1, 4, "u4", 10.0)], "query_id int, shard int, doc_id long, url string, score double")
    assert [(r["doc_id"], r["rank"]) for r in learn.shard_top(rows, 2).orderBy("rank").collect()] == [(4, 1), (1, 2)]
    ring = placement.ring(spark, ["n1", "n2", "n3"])
    table = sorted((r["position"], r["node"]) for r in ring.collect())
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    h = {r["key"]: r["h"] for r in keys.select("key", placement.ring_hash(F.col("key")).alias("h")).collect()}
    for r in placement.owner(keys, ring).collect():
        assert r["node"] == next((n for p, n in table if p >= h[r["key"]]), table[0][1]) == placement.replicas(table, h[r["key"]], 2)[0]
    assert len(set(placement.replicas(table, 0, 3))) == 3
    moves = placement.rebalance({"a": [f"s{i}" for i in range(9)], "b": [], "c": []})
    assert [(m[1], m[2]) for m in moves] == [("a", "b"), ("a", "c"), ("a", "b")] and placement.rebalance({}) == []


def test_frontier(spark):
    robots = "User-agent: *\nDisallow: /p\nAllow: /p/open\nDisallow:\nCrawl-delay: 2.5\n# no\nUser-agent: other\nDisallow: /\n"
    rules = frontier.parse_robots(spark.createDataFrame([("h", 200, robots), ("shut", 403, None), ("gone", 404, None)], "host string, status int, content string"), "me")
    urls = spark.createDataFrame([("1", "h", "/p/x"), ("2", "h", "/p/open/x"), ("3", "h", "/q"), ("4", "shut", "/"), ("5", "gone", "/"), ("6", "new", "/")], "url string, host string, path string")
    assert {r["url"]: r["allowed"] for r in frontier.robots_allowed(urls, rules).collect()} == {"1": False, "2": True, "3": True, "4": False, "5": True, "6": True}
    assert {r["crawl_delay"] for r in rules.where("host = 'h'").collect()} == {2}
    urls = ["https://en.wikipedia.org/x", "https://mit.edu/", "https://x.org/a.PDF", "https://mywiki.org/", "https://x.org/"]
    assert column(spark, urls, frontier.recrawl_minutes) == [30, 10080, 525600, 60, 1440]
    m, k = frontier.bloom_size(1000, 0.01)
    assert (m, k) == (9586, 7)
    a, b = spark.range(500).toDF("key"), spark.range(500, 1000).toDF("key")
    bloom = frontier.bloom_merge(frontier.bloom_build(a, "key", m, k), frontier.bloom_build(b, "key", m, k))
    got = frontier.bloom_maybe(spark.range(3000).toDF("key"), "key", bloom, m, k)
    assert got.where("key < 1000 AND NOT maybe").count() == 0 and got.where("key >= 1000 AND maybe").count() < 60
    page = spark.createDataFrame([("https://a.test/d/x", 3, ["y", "y#top", "/d/x", "mailto:q@r"]), ("https://a.test/z", 4, ["deep"])], "url string, depth int, links array<string>")
    assert [tuple(r) for r in frontier.discover(page, page).collect()] == [("https://a.test/d/y", 4)]
    reg = spark.createDataFrame([(f"u{i}", "DONE", i if i < 3 else None) for i in range(5)], "url string, state string, finished int")
    assert sorted(r["url"] for r in frontier.evict(reg, 3).collect()) == ["u2", "u3", "u4"]
    now = dt.datetime(2024, 1, 1, 12)
    beats = spark.createDataFrame([("w1", now), ("w2", now - dt.timedelta(seconds=20))], "worker string, ts timestamp")
    lost = frontier.lost_workers(beats, F.lit(now))
    tasks = spark.createDataFrame([("t1", "w1", "FETCHING"), ("t2", "w2", "FETCHING"), ("t3", "w2", "DONE")], "url string, worker string, state string")
    assert {r["url"]: (r["state"], r["worker"]) for r in frontier.requeue(tasks, lost).collect()} == {"t1": ("FETCHING", "w1"), "t2": ("QUEUED", None), "t3": ("DONE", None)}
    retry = spark.createDataFrame([(0,), (2,), (3,)], "n int").select("n", frontier.retry_at(F.lit(now), F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in retry} == {0: now + dt.timedelta(seconds=5), 2: now + dt.timedelta(seconds=20), 3: None}
    due = spark.createDataFrame([("a", "INDEXED", now), ("b", "QUEUED", now), ("c", "FETCHED", now + dt.timedelta(1))], "url string, state string, next_crawl timestamp")
    assert [r["url"] for r in frontier.due(due, F.lit(now)).collect()] == ["a"]


def test_analytics(spark):
    log = spark.createDataFrame([("A ", 1.0, 0), ("a", 3.0, 2), ("b", 2.0, 0)], "query string, latency double, results int")
    r = analytics.query_log(log).first()
    assert (r["total"], r["mean_latency"], round(r["zero_rate"], 4), r["distinct_queries"]) == (3, 2.0, 0.6667, 2)
    assert [tuple(x) for x in analytics.top_queries(log, 1).collect()] == [("a", 2)]
    h = {x["le"]: x["n"] for x in analytics.histogram(log, "latency", [], (1.0, 2.5)).collect()}
    assert h == {"1.0": 1, "2.5": 2, "+Inf": 3}
    m = spark.createDataFrame([("x", i, float(i)) for i in range(10)], "name string, ts int, value double")
    s = analytics.series(m, "name", "ts", "value", keep=4)
    assert tuple(s.first()) == ("x", 9.0, 7.5, 4)
    assert analytics.alerts(s, spark.createDataFrame([("x", 8.0)], "name string, threshold double")).count() == 1


def test_pages():
    html = '<html><head><title> A  b </title><style>x{}</style></head><body>One<p>two<script>no()</script><a href="/x">th</a>ree<a href="http://[bad">q</a><a href="#t">r</a>'
    assert pages.parse_page(html, "https://h.test/d/p") == ("A b", "One two threeqr", ["https://h.test/x", "https://h.test/d/p#t"])
    assert pages.parse_page("  ", "u") == pages.parse_page(None, None) == ("", "", [])


def test_stores(spark, tmp_path):
    p = tmp_path / "crawl.jsonl"
    p.write_text('{"url":"u1","title":"old","new_field":1}\n{"url":"u2","title":"b"}\n{"url":"u1","title":"new"}\n{"url":"u3","ti')
    assert [(r["url"], r["title"]) for r in stores.read_crawled(spark, str(p)).orderBy("seq").collect()] == [("u1", "new"), ("u2", "b")]
    c = tmp_path / "corpus.jsonl"
    c.write_text('{"_id":"d1","title":"t","text":"x"}\nbroken\n{"title":"no id"}\n{"_id":"d2","text":"y"}\n{"_id":"d1","text":"again"}\n')
    docs = stores.read_judged_documents(spark, str(c))
    assert [(r["doc_id"], r["ext_id"], r["text"]) for r in docs.orderBy("doc_id").collect()] == [(1, "d1", "x"), (2, "d2", "y")]
    assert stores.read_judged_documents(spark, str(c), 1).count() == 1
    assert stores.write_manifest(docs, str(tmp_path / "m")).first()["documents"] == 2
    q = tmp_path / "queries.jsonl"
    q.write_text('{"_id":"q1","text":"hello"}\n{"_id":"q2","text":" "}\nbad\n')
    assert [r["query_id"] for r in stores.read_judged_queries(spark, str(q)).collect()] == ["q1"]
    r = tmp_path / "qrels.tsv"
    r.write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\nq1 0 d3 1.6\n\n")
    assert [tuple(x) for x in stores.read_qrels(spark, str(r)).collect()] == [("q1", "d1", 2), ("q1", "d3", 2)]
    v = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, vec array<double>")
    stores.write_vectors(v, str(tmp_path / "v"))
    assert stores.read_vectors(spark, str(tmp_path / "v"), 2).first()["vec"] == [1.0, 2.0]
    with pytest.raises(Exception, match="isn't 3 long"):
        stores.read_vectors(spark, str(tmp_path / "v"), 3).collect()


def test_wordpiece(spark):
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!", "中"]
    assert wordpiece.basic_tokens("Café, 中x!") == ["cafe", ",", "中", "x", "!"]
    ids_ = {w: i for i, w in enumerate(vocab)}
    assert wordpiece.encode("unaffable Café! zz", ids_, 10) == [2, 4, 5, 6, 7, 8, 1, 3, 0, 0]
    assert wordpiece.encode_documents(spark.createDataFrame([(1, "un " * 50), (2, None)], "doc_id long, text string"), vocab, 6).orderBy("doc_id").first()["ids"] == [2, 4, 4, 4, 4, 3]


def test_engine(spark, docs, index):
    vocabulary = I.surface_vocabulary(docs)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id long, vec array<double>")
    e = search.Engine(spark, index, docs, vocabulary=vocabulary, vectors=vectors, synonyms={"scripts": ["java"]})
    rows = e.search("java compiler").collect()
    assert [r["doc_id"] for r in rows] == [3, 1] and "**java**" in rows[0]["snippet"] and 0 <= rows[0]["final"] <= 1
    assert [r["final"] for r in e.search('"java compiler"').collect()] == [1.0]
    assert [r["doc_id"] for r in e.search("pythom").collect()] == [2]  # corrected
    assert ids(e.search("scripts", expand=4)) == [1, 2, 3] and ids(e.search("")) == []
    assert ids(e.search('java OR "scripts and"')) == [1, 3]
    for mode in ("hybrid", "rrf", "semantic"):
        assert e.search("java", mode=mode, vector=[0.0, 1.0]).count() == 3
    assert [r["doc_id"] for r in e.search("java", mode="semantic", vector=[0.0, 1.0], diverse=False).collect()] == [2, 3, 1]
    assert ids(search.Engine(spark, index, truncate_first=True).search("java AND NOT compiler")) == [1]
    assert e.suggest("pyt").first()["word"] == "python"
    assert ids(e.search("java compiler", k=1, page=2)) == [1]
