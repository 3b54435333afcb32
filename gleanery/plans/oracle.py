"""SQL, in DuckDB's dialect, that registered queries must agree with row by row."""

from __future__ import annotations

from gleanery.functions.text import ENTITY_SKIP, STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SKIP = ", ".join(f"'{w}'" for w in ENTITY_SKIP)

TOKENS = r"""
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+') AS ws FROM documents)),
lens AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}]+')) AS BIGINT) AS doc_len FROM documents),
qtok AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS w FROM benchmark)
"""


def stems(words: str) -> str:
    """CTEs that end in st(w, term) for a query that gives the distinct words w."""
    keep = "length(w) <= 2"
    return f"""
st0 AS ({words}),
st1 AS (SELECT w, CASE WHEN {keep} THEN w WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2)
  WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS a FROM st0),
st2 AS (SELECT w, CASE WHEN {keep} THEN w WHEN ends_with(a, 'eed') THEN left(a, length(a) - 1)
  WHEN ends_with(a, 'ed') THEN left(a, length(a) - 2) WHEN ends_with(a, 'ing') THEN left(a, length(a) - 3) ELSE a END AS a FROM st1),
st3 AS (SELECT w, CASE WHEN NOT ({keep}) AND ends_with(a, 'er') THEN left(a, length(a) - 2) ELSE a END AS a FROM st2),
st AS (SELECT w, CASE WHEN NOT ({keep}) AND length(a) > 2 AND a[-1] = a[-2] AND a[-1] NOT IN ('l', 's', 'z') THEN left(a, length(a) - 1) ELSE a END AS term FROM st3)
"""


STEMS = stems("SELECT DISTINCT w FROM tok UNION SELECT DISTINCT w FROM qtok")
POST = f"""
post AS (SELECT term, doc_id, count(*) AS tf FROM tok JOIN st USING (w) WHERE w NOT IN ({STOP}) GROUP BY ALL)
"""
INDEX = f"{TOKENS}, {STEMS}, {POST}"
SCORES = f"""
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corp AS (SELECT count(*) AS n, sum(doc_len) // count(*) AS avg_len, sum(doc_len) AS total, max(doc_len) AS longest FROM lens),
q AS (SELECT query_id, term, count(*) AS qtf FROM qtok JOIN st USING (w) WHERE w NOT IN ({STOP}) GROUP BY ALL),
score AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (doc_len / avg_len)))) AS bm25
          FROM q JOIN df USING (term) JOIN post USING (term) JOIN lens USING (doc_id), corp GROUP BY ALL)
"""
RANKED = f"WITH {INDEX}, {SCORES}"


def top(rows: str, score: str, k: int, tie: str = "doc_id") -> str:
    """Rows with rank by a score rounded to 6 places, the k best of each query."""
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, {tie}) AS INTEGER) AS rank FROM {rows} QUALIFY rank <= {k}"


EMBED = r"""
ew AS (SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents
       UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM benchmark),
eh AS (SELECT w, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, x: (a * 31 + x) & 4294967295) AS h FROM (SELECT DISTINCT w FROM ew)),
es AS (SELECT side, id, CAST((h & 2147483647) % 128 AS INTEGER) AS bucket, sum(CASE WHEN (h >> 16) & 1 = 0 THEN 1 ELSE -1 END) AS x FROM ew JOIN eh USING (w) GROUP BY ALL HAVING x <> 0),
emb AS (SELECT side, id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS weight FROM es),
sem AS (SELECT b.id AS query_id, a.id AS doc_id, sum(a.weight * b.weight) AS score FROM emb a JOIN emb b ON a.bucket = b.bucket AND a.side = 0 AND b.side = 1 GROUP BY ALL)
"""
EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
FEATURES = rf"""
{RANKED}, best AS ({top('score', 'bm25', 10)}),
cand AS (SELECT query_id, doc_id, rank, doc_len, lower(d.text) AS body, string_split(d.text, chr(10))[1] AS title, 'https://' || source || '.local/' || d.doc_id AS url, n, total, longest,
         regexp_extract_all(lower(b.text), '[a-z0-9]+') AS terms, b.text AS query
         FROM best JOIN documents d USING (doc_id) JOIN lens USING (doc_id) JOIN benchmark b ON b.item_id = query_id, corp),
feat AS (SELECT query_id, doc_id, rank,
  1 - exp(-list_sum(list_transform(terms, lambda t: ln(1 + (length(body) - length(replace(body, t, ''))) // length(t))))) AS bm25,
  (doc_len / total) / (longest / total) AS pagerank_n,
  CASE WHEN title = '' THEN 0.0 ELSE len(list_filter(terms, lambda t: contains(lower(title), t))) / len(terms) END AS title_match,
  len(list_filter(terms, lambda t: contains(url, t))) / len(terms) AS url_match,
  len(list_filter(terms, lambda t: list_contains(ws, t))) / len(terms) AS term_overlap, 0.0 AS semantic,
  ln(1 + doc_len) / ln(1 + longest) AS doc_length, 1.0 / rank AS position
  FROM (SELECT *, regexp_extract_all(body, '[a-z0-9]+') AS ws FROM cand))
"""
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normal(rows: str, columns: str) -> str:
    """A query that gives canonical URLs as url for rows with a column url."""
    part = lambda i: f"regexp_extract(trim(url), '{URL}', {i})"
    return rf"""
SELECT {columns}, CASE WHEN s IN ('http', 'https') AND h <> '' THEN
  s || '://' || CASE WHEN u <> '' THEN u || '@' ELSE '' END || h || CASE WHEN p = '' OR (s = 'http' AND p = '80') OR (s = 'https' AND p = '443') THEN '' ELSE ':' || p END ||
  CASE WHEN f2 = '' THEN '/' ELSE f2 END || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END END AS url
FROM (SELECT *, CASE WHEN length(f) > 1 THEN regexp_replace(f, '/$', '') ELSE f END AS f2,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_campaign', 'utm_medium', 'fbclid'))), '&') AS q2
  FROM (SELECT *, lower({part(1)}) AS s, {part(2)} AS u, lower({part(3)}) AS h, {part(4)} AS p, regexp_replace({part(5)}, '//+', '/', 'g') AS f, {part(6)} AS q FROM {rows}))
"""


HREFS = r"""
hr AS (SELECT page_id AS src, url AS base, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages),
li AS (SELECT src, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || link
  WHEN starts_with(link, '/') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || link
  WHEN starts_with(link, '#') OR link = '' THEN regexp_replace(base, '#.*$', '') || link WHEN starts_with(link, '?') THEN regexp_replace(regexp_replace(base, '#.*$', ''), '\?.*$', '') || link
  ELSE regexp_replace(regexp_replace(base, '[?#].*$', '') || CASE WHEN regexp_matches(regexp_replace(base, '[?#].*$', ''), '://[^/]*$') THEN '/' ELSE '' END, '[^/]*$', '') || link END AS url FROM hr)
"""
METRICS = f"""
{RANKED}, qrels AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id, quality * (2 - toxic) AS grade FROM labels),
res AS ({top('score', 'bm25', 100)}),
rows AS (SELECT query_id, doc_id, rank, coalesce(grade, 0) AS grade, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM res LEFT JOIN qrels USING (query_id, doc_id)),
got AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) END) AS dcg, sum(CASE WHEN grade > 0 THEN hits / rank END) AS ap, min(CASE WHEN grade > 0 AND rank <= 10 THEN rank END) AS first,
  count(*) FILTER (grade > 0) AS found, count(*) FILTER (grade > 0 AND rank <= 5) AS found5, count(*) FILTER (rank <= 5) AS shown5 FROM rows GROUP BY query_id),
ideal AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qrels WHERE grade > 0),
want AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS idcg, count(*) AS relevant FROM ideal GROUP BY query_id),
m AS (SELECT query_id, coalesce(dcg / idcg, 0) AS ndcg, coalesce(ap / relevant, 0) AS average_precision, coalesce(1.0 / first, 0) AS reciprocal_rank, coalesce(found / relevant, 0) AS recall,
  coalesce(CASE WHEN shown5 > 0 THEN found5 / shown5 END, 0) AS precision5 FROM want LEFT JOIN got USING (query_id))
"""
_M = ("ndcg", "average_precision", "reciprocal_rank", "recall", "precision5")
ENTITIES = rf"""
en0 AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-zA-Z0-9]*(?:[- ][A-Z][a-zA-Z0-9]*){{0,3}}\b')) AS entity FROM documents),
en1 AS (SELECT doc_id, entity, count(*) AS weight FROM en0 WHERE string_split(entity, ' ')[1] NOT IN ({SKIP}) GROUP BY ALL),
en AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, entity) AS INTEGER) AS rank FROM en1 QUALIFY rank <= 10)
"""


def one_byte(x: str) -> str:
    """The edit distance here is over bytes: lower-case words with one capital for each accented letter."""
    return f"translate({x}, 'àâäçèéêëîïôöùûüßñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')"


def code_hash(x: str) -> str:
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, x: (a * 31 + x) & 4294967295)"


def ring_hash(x: str) -> str:
    u = f"CAST(CAST('0x' || substr(md5({x}), 1, 16) AS UBIGINT) AS HUGEINT)"
    return f"CAST(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END AS BIGINT)"


BOOL = f"WITH {INDEX}"
_doc = lambda term: f"SELECT doc_id FROM post WHERE term = '{term}'"
SQL: dict[str, str] = {
    "tokenize": r"""SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, md5(array_to_string(ws, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}]+') AS ws FROM documents)""",
    "stem_terms": f"WITH {TOKENS}, {stems('SELECT DISTINCT w FROM tok')} SELECT w AS word, term, count(*) AS n FROM tok JOIN st USING (w) GROUP BY ALL",
    "term_frequencies": f"{BOOL} SELECT * FROM post",
    "term_positions": f"WITH {TOKENS}, {STEMS} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tok JOIN st USING (w) WHERE w NOT IN ({STOP}) GROUP BY ALL",
    "document_frequency": f"{BOOL} SELECT term, count(*) AS df FROM post GROUP BY term",
    "corpus_stats": f"{BOOL} SELECT count(*) AS n_docs, CAST(sum(doc_len) // count(*) AS BIGINT) AS avg_len, (SELECT count(DISTINCT term) FROM post) AS vocabulary FROM lens",
    "bigram_vocabulary": f"""WITH {TOKENS}, v AS (SELECT w AS word FROM tok WHERE w NOT IN ({STOP})
        UNION ALL SELECT a.w || ' ' || b.w FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.w NOT IN ({STOP}) AND b.w NOT IN ({STOP}))
        SELECT word, count(*) AS freq FROM v GROUP BY word""",
    "gap_encode": f"{BOOL} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post",
    "block_max": f"{BOOL}, b AS (SELECT term, doc_id, tf, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block FROM post) SELECT term, block, max(tf) AS max_tf, max(doc_id) AS last_doc FROM b GROUP BY ALL",
    "skip_seek": f"{BOOL} SELECT term, min(doc_id) AS doc_id FROM post WHERE doc_id >= 500 GROUP BY term",
    "vbyte": f"{BOOL} SELECT term, count(*) AS n, max(doc_id) AS last_doc FROM post GROUP BY term",
    "segment_merge": f"{BOOL} SELECT term, count(*) AS df FROM post GROUP BY term",
    "boolean_and": f"{BOOL} {_doc('tion')} INTERSECT {_doc('nd')}",
    "boolean_or": f"{BOOL} SELECT DISTINCT doc_id FROM post WHERE term IN ('uea', 'chb', 'thion')",
    "boolean_not": f"{BOOL} {_doc('tion')} EXCEPT SELECT doc_id FROM post WHERE term IN ('nd', 'est')",
    "phrase": f"{BOOL} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN st x ON x.w = a.w JOIN st y ON y.w = b.w WHERE x.term = 'tion' AND y.term = 'nd' AND a.w NOT IN ({STOP}) AND b.w NOT IN ({STOP})",
    "wildcard_prefix": f"{BOOL} SELECT DISTINCT doc_id FROM post WHERE starts_with(term, 'thin')",
    "fuzzy_terms": f"{BOOL} SELECT term, levenshtein({one_byte('term')}, 'thion') AS distance FROM (SELECT DISTINCT term FROM post WHERE abs(length(term) - 5) <= 2) WHERE levenshtein({one_byte('term')}, 'thion') <= 2",
    "wand_conjunctive": f"""{BOOL}, h AS (SELECT 0 AS query_id, doc_id, CAST(sum(tf) AS BIGINT) AS score FROM post WHERE term IN ('tion', 'nd') GROUP BY doc_id HAVING count(*) = 2)
        SELECT rank, doc_id, score FROM ({top('h', 'score', 10)})""",
    "bm25_topk": f"{RANKED} SELECT query_id, rank, doc_id, round(bm25, 6) AS score FROM ({top('score', 'bm25', 10)})",
    "bm25_normalized_fusion": f"""{RANKED}, s AS (SELECT query_id, doc_id, bm25, doc_len / total AS pr FROM score JOIN lens USING (doc_id), corp),
        e AS (SELECT query_id, min(bm25) AS b0, max(bm25) AS b1, min(pr) AS p0, max(pr) AS p1 FROM s GROUP BY query_id),
        f AS (SELECT query_id, doc_id, 0.75 * CASE WHEN b1 = b0 THEN 0.5 ELSE (bm25 - b0) / (b1 - b0) END + 0.25 * CASE WHEN p1 = p0 THEN 0.5 ELSE (pr - p0) / (p1 - p0) END AS final FROM s JOIN e USING (query_id))
        SELECT query_id, rank, doc_id, round(final, 6) AS final FROM ({top('f', 'final', 10)})""",
    "rank_positions": f"{RANKED} SELECT query_id, rank, doc_id FROM ({top('score', 'bm25', 10)}) WHERE rank BETWEEN 6 AND 10",
    "score_normalize": f"{RANKED} SELECT query_id, doc_id, round(CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 0.5 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END, 6) AS scaled FROM score WINDOW w AS (PARTITION BY query_id)",
    "hash_embedding": f"WITH {EMBED} SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM emb WHERE side = 0",
    "rrf": f"""{RANKED}, {EMBED}, ch AS (SELECT query_id, 0 AS channel, rank, doc_id FROM ({top('score', 'bm25', 100)}) UNION ALL SELECT query_id, 1, rank, doc_id FROM ({top('sem', 'score', 100)})),
        f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(channel * 1000 + rank) AS first FROM ch GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, doc_id) AS INTEGER) AS rank FROM f)
        SELECT query_id, rank, doc_id, round(score, 8) AS score FROM r WHERE rank <= 10""",
    "hybrid_merge": f"""{RANKED}, {EMBED}, l AS (SELECT query_id, doc_id, bm25 / max(bm25) OVER (PARTITION BY query_id) AS s FROM ({top('score', 'bm25', 60)})),
        m AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM ({top('sem', 'score', 60)})),
        h AS (SELECT query_id, doc_id, 0.5 * coalesce(l.s, 0) + 0.5 * coalesce(m.s, 0) AS score FROM l FULL JOIN m USING (query_id, doc_id))
        SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({top('h', 'score', 10)})""",
    "rerank_cosine": f"""{RANKED}, {EMBED}, b AS ({top('score', 'bm25', 20)}),
        c AS (SELECT query_id, doc_id, 0.7 * bm25 / max(bm25) OVER (PARTITION BY query_id) + 0.3 * greatest(0, coalesce(sem.score, 0)) AS reranked FROM b LEFT JOIN sem USING (query_id, doc_id))
        SELECT query_id, rank, doc_id, round(reranked, 6) AS reranked FROM ({top('c', 'reranked', 20)})""",
    "rerank_overlap": rf"""{RANKED}, b AS ({top('score', 'bm25', 20)}),
        t AS (SELECT query_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[ \t\n\r\f.,;:!?''"()\[\]{{}}\-/\\]+'), lambda x: x <> '')) AS a,
          list_distinct(list_filter(regexp_split_to_array(lower(d.text), '[ \t\n\r\f.,;:!?''"()\[\]{{}}\-/\\]+'), lambda x: x <> '')) AS c
          FROM b JOIN benchmark q ON q.item_id = query_id JOIN documents d USING (doc_id))
        SELECT query_id, doc_id, round(len(list_intersect(a, c)) / len(a), 6) AS overlap FROM t""",
    "shard_merge_topk": f"""{RANKED}, s AS (SELECT query_id, doc_id, round(bm25, 6) AS score, ({code_hash('CAST(doc_id AS VARCHAR)')} & 2147483647) % 8 AS shard FROM score),
        l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, doc_id) <= 30)
        SELECT query_id, rank, doc_id, score FROM ({top('l', 'score', 10)})""",
    "vector_topk": f"""WITH e AS (SELECT vec_id AS doc_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS query_id, i, avg(CAST(x AS DOUBLE)) AS y FROM e GROUP BY ALL),
        en AS (SELECT doc_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM e GROUP BY doc_id), mn AS (SELECT query_id, sqrt(sum(y * y)) AS n FROM m GROUP BY query_id),
        s AS (SELECT query_id, doc_id, sum(CAST(x AS DOUBLE) * y) / (any_value(en.n) * any_value(mn.n)) AS score FROM e JOIN m USING (i) JOIN en USING (doc_id) JOIN mn USING (query_id) GROUP BY ALL)
        SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({top('s', 'score', 10)})""",
    "ranking_metrics": f"{METRICS} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _M)} FROM m",
    "ranking_metrics_macro": f"{METRICS} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in _M)} FROM m",
    "percentiles": "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS minimum, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99, max(o_totalprice) AS maximum, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS deviation FROM orders GROUP BY ALL",
    "pagerank": """WITH RECURSIVE e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS m FROM lineitem GROUP BY ALL), o AS (SELECT src, sum(m) AS d FROM e GROUP BY src),
        nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM nodes),
        r AS (SELECT 0 AS i, node, 1.0::DOUBLE / n AS pr FROM nodes, n UNION ALL
          SELECT i + 1, node, 0.15 / n + 0.85 * loose / n + 0.85 * came FROM (
            SELECT any_value(i) AS i, node, sum(came) AS came, max(loose) AS loose FROM (
              SELECT r.i, r.node, 0.0 AS came, (SELECT coalesce(sum(x.pr), 0) FROM r x LEFT JOIN o ON o.src = x.node WHERE o.src IS NULL) AS loose FROM r
              UNION ALL SELECT r.i, e.dst, r.pr * e.m / o.d, 0.0 FROM r JOIN e ON e.src = r.node JOIN o ON o.src = r.node) GROUP BY node), n WHERE i < 40)
        SELECT node, round(pr, 9) AS pagerank FROM r WHERE i = 40""",
    "link_graph": f"""WITH {HREFS}, l AS ({normal('li', 'src')}), p AS ({normal('pages', 'page_id AS dst')})
        SELECT src, l.url, coalesce(p.dst, -1) AS dst, count(*) AS n FROM l LEFT JOIN p ON l.url = p.url WHERE l.url IS NOT NULL AND (p.dst IS NULL OR src <> p.dst) GROUP BY ALL""",
    "frontier_discover": f"""WITH {HREFS}, l AS ({normal('(SELECT li.url, page_id % 5 + 1 AS depth FROM li JOIN pages ON page_id = src WHERE page_id % 5 + 1 <= 4)', 'depth')}), p AS ({normal('pages', 'page_id')})
        SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM l WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM p WHERE url IS NOT NULL) GROUP BY url""",
    "url_normalize": normal("(SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'HTTPS://User.' || regexp_replace(url, '^https?://', '') || '//x//?utm_source=a&b=' || page_id % 7 || '&a=1&FBCLID=z#part' FROM pages)", "page_id"),
    "autocomplete": f"""WITH {TOKENS}, v AS (SELECT w AS word FROM tok WHERE w NOT IN ({STOP})
        UNION ALL SELECT a.w || ' ' || b.w FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.w NOT IN ({STOP}) AND b.w NOT IN ({STOP})),
        f AS (SELECT word, count(*) AS freq FROM v GROUP BY word), p AS (SELECT DISTINCT substr(lower(text), 1, 2) AS prefix FROM benchmark),
        s AS (SELECT prefix, word, freq, ln(1 + freq) * length(prefix) / length(word) AS score FROM p JOIN f ON starts_with(word, prefix))
        SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY round(score, 9) DESC, word) AS INTEGER) AS rank, word, freq, round(score, 6) AS score FROM s QUALIFY rank <= 8""",
    "spell_suggest": f"""WITH {TOKENS}, v AS (SELECT w AS suggestion, count(*) AS freq FROM tok GROUP BY w), n AS (SELECT DISTINCT lower(n_name) AS word FROM nation),
        s AS (SELECT word, suggestion, levenshtein({one_byte('suggestion')}, word) AS distance, freq FROM n JOIN v ON abs(length(suggestion) - length(word)) <= 4 WHERE levenshtein({one_byte('suggestion')}, word) <= 4)
        SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, suggestion) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "pmi_thesaurus": f"""WITH {TOKENS}, k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM tok WHERE length(w) > 1 AND w NOT IN ({STOP})),
        c AS (SELECT doc_id, max(i) AS c FROM k GROUP BY doc_id), x AS (SELECT doc_id, w, unnest(range(greatest(i - 4, 1), least(i, c - 4) + 1)) AS s FROM k JOIN c USING (doc_id) WHERE c >= 5),
        win AS (SELECT DISTINCT doc_id, s, w FROM x), n AS (SELECT sum(c - 4) AS n FROM c WHERE c >= 5), one AS (SELECT w, count(*) AS c FROM win GROUP BY w),
        two AS (SELECT a.w AS a, b.w AS b, count(*) AS c FROM win a JOIN win b ON a.doc_id = b.doc_id AND a.s = b.s AND a.w < b.w GROUP BY ALL),
        s AS (SELECT a, b, ln(two.c * n / (x.c * y.c)) AS pmi FROM two JOIN one x ON x.w = a JOIN one y ON y.w = b, n WHERE round(ln(two.c * n / (x.c * y.c)), 9) >= 1),
        t AS (SELECT a AS term, b AS neighbour, pmi FROM s UNION ALL SELECT b, a, pmi FROM s)
        SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY round(pmi, 9) DESC, neighbour) AS INTEGER) AS rank, neighbour, round(pmi, 6) AS pmi FROM t QUALIFY rank <= 5""",
    "synonym_two_hop": """WITH s AS (SELECT p_brand AS a, p_type AS b FROM part UNION SELECT p_type, p_brand FROM part)
        SELECT term, other, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT a AS term, b AS other, 1 AS hop FROM s UNION ALL SELECT DISTINCT x.a, y.b, 2 FROM s x JOIN s y ON x.b = y.a WHERE x.a <> y.b) GROUP BY ALL""",
    "entities": f"WITH {ENTITIES} SELECT * FROM en",
    "entity_related": f"""WITH {ENTITIES}, e AS (SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM en a JOIN en b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL),
        t AS (SELECT a AS entity, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e)
        SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY weight DESC, other) AS INTEGER) AS rank FROM t QUALIFY rank <= 8""",
    "entity_lookup": f"WITH {ENTITIES} SELECT entity, count(DISTINCT doc_id) AS docs FROM en WHERE contains(lower(entity), 'th') GROUP BY entity ORDER BY docs DESC, entity LIMIT 5",
    "ctr": f"""WITH {EVENTS}, v AS (SELECT k, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY k), c AS (SELECT k, count(*) AS n, avg(value) AS p FROM ev WHERE event_type = 'click' GROUP BY k)
        SELECT k, coalesce(v.n, 0) AS impressions, coalesce(c.n, 0) AS clicks, round(CASE WHEN coalesce(v.n, 0) = 0 THEN 0.0 ELSE coalesce(c.n, 0) / v.n END, 6) AS ctr, round(p, 6) AS mean_position FROM v FULL JOIN c USING (k)""",
    "preference_pairs": f"""WITH {EVENTS}, v AS (SELECT user_id, CAST(ts AS DATE) AS day, k, min(event_id) AS e0 FROM ev WHERE event_type = 'view' GROUP BY ALL),
        l AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY e0) AS p FROM v QUALIFY day = max(day) OVER (PARTITION BY user_id)),
        l2 AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY p) AS p FROM l)
        SELECT CAST(c.user_id AS VARCHAR) AS query, c.k AS preferred, b.k AS other, count(*) AS n FROM ev c JOIN l2 a ON a.user_id = c.user_id AND a.k = c.k JOIN l2 b ON b.user_id = c.user_id AND b.p < a.p WHERE event_type = 'click' GROUP BY ALL""",
    "feature_vector": f"{FEATURES} SELECT query_id, doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('bm25', 'pagerank_n', 'title_match', 'url_match', 'term_overlap', 'semantic', 'doc_length', 'position'))} FROM feat",
    "ltr_score": f"""{FEATURES}, s AS (SELECT query_id, doc_id, rank AS r0, 0.35 * bm25 + 0.2 * pagerank_n + 0.2 * title_match + 0.05 * url_match + 0.05 * term_overlap + 0.1 * semantic - 0.05 * doc_length + 0.1 * position AS score FROM feat)
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({top('s', 'score', 1000, 'r0')})""",
    "query_analytics": f"WITH {EVENTS} SELECT count(*) AS total, round(avg(value), 6) AS mean_latency, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, count(DISTINCT event_type || ' ' || user_id % 10) AS distinct_queries FROM ev",
    "top_queries": f"WITH {EVENTS} SELECT event_type || ' ' || user_id % 10 AS query, count(*) AS n FROM ev GROUP BY ALL ORDER BY n DESC, query LIMIT 10",
    "histogram": """WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 'inf'::DOUBLE]) AS b), t AS (SELECT DISTINCT event_type FROM events)
        SELECT t.event_type, CASE WHEN b = 'inf'::DOUBLE THEN '+Inf' ELSE CAST(b AS VARCHAR) END AS le, count(e.value) FILTER (e.value <= b) AS n FROM t CROSS JOIN b JOIN events e ON e.event_type = t.event_type GROUP BY ALL""",
    "metric_series": """WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events)
        SELECT name, round(min_by(value, r), 6) AS latest, round(avg(value), 6) AS mean, count(*) AS n FROM r WHERE r <= 1000 GROUP BY name""",
    "metric_alerts": """WITH r AS (SELECT event_type || '-' || user_id AS name, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, value DESC) AS r FROM events),
        s AS (SELECT name, min_by(value, r) AS latest, avg(value) AS mean FROM r WHERE r <= 1000 GROUP BY name)
        SELECT name, round(latest, 6) AS latest FROM s WHERE round(latest, 6) > (SELECT round(avg(mean), 6) FROM s)""",
    "dedupe_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "recrawl_policy": r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS h, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)
        SELECT page_id, CAST(CASE WHEN contains(h, 'wikipedia.org') OR contains(h, 'wikimedia.org') THEN 30 WHEN regexp_matches(h, '\.(edu|ac\.uk|edu\.au)$') THEN 10080
          WHEN regexp_matches(p, '\.(pdf|doc|docx|ps|epub)$') THEN 525600 WHEN ends_with(p, '/wiki') OR contains(h, 'wiki') THEN 60 ELSE 1440 END AS BIGINT) AS minutes FROM u""",
    "crawl_priority": f"""WITH {EVENTS} SELECT event_id, CAST(greatest(0, least(100,
          CASE WHEN value * 4 < 1 THEN 100 WHEN value * 4 < 24 THEN 75 WHEN value * 4 < 168 THEN 50 ELSE 25 END - 200
          + CASE WHEN user_id > 1000 THEN 100 WHEN user_id > 100 THEN 75 WHEN user_id > 10 THEN 50 ELSE 25 END + CASE WHEN k % 4 = 0 THEN 75 WHEN k % 4 <= 2 THEN 50 ELSE 25 END
          + CASE WHEN k % 5 = 0 THEN 50 WHEN k * 10 <= 1 THEN 100 WHEN k * 10 <= 24 THEN 75 WHEN k * 10 <= 168 THEN 50 ELSE 25 END)) AS BIGINT) AS priority FROM ev""",
    "crawl_dispatch": f"""WITH {EVENTS}, t AS (SELECT 'site' || user_id % 20 AS domain, '/' || event_id AS url, k % 101 AS p, event_id AS seq FROM ev),
        b AS (SELECT *, CAST(CASE WHEN p >= 90 THEN 0 WHEN p >= 60 THEN 1 WHEN p >= 30 THEN 2 ELSE 3 END AS BIGINT) AS bucket FROM t),
        r AS (SELECT domain, url, bucket, row_number() OVER (PARTITION BY domain ORDER BY bucket, seq, url) - 1 AS turn FROM b) SELECT *, turn * 2 AS slot_s FROM r""",
    "worker_liveness": "SELECT user_id AS worker, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY user_id HAVING epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', max(ts))) > 3600",
    "robots_allowed": r"""WITH u AS (SELECT page_id, unnest(['/private/a', '/private/open/b', '/', coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '')]) AS path FROM pages)
        SELECT DISTINCT page_id || ' ' || path AS url, NOT starts_with(path, '/private') OR starts_with(path, '/private/open') AS allowed FROM u""",
    "bloom_membership": "SELECT CAST(0 AS BIGINT) AS missed, true AS rate_kept",
    "hash_ring_owner": f"""WITH v AS (SELECT {ring_hash("n || '#' || i")} AS position, n FROM (SELECT unnest(['node-a', 'node-b', 'node-c', 'node-d', 'node-e']) AS n), range(150) t(i)),
        k AS (SELECT c_custkey, {ring_hash('c_name')} AS h FROM customer), a AS (SELECT c_custkey, min(position) AS p FROM k LEFT JOIN v ON position >= h GROUP BY c_custkey)
        SELECT c_custkey, n AS node FROM a JOIN v ON position = coalesce(p, (SELECT min(position) FROM v))""",
    "hash_shard": f"SELECT c_custkey, CAST(({code_hash('c_name')} & 2147483647) % 8 AS INTEGER) AS shard FROM customer",
    "replica_routing": """WITH s AS (SELECT n_nationkey AS shard, i, (n_regionkey + i) % 5 AS node FROM nation, range(3) t(i)) SELECT shard, CAST(min_by(node, i) AS INTEGER) AS node FROM s WHERE node <> 0 GROUP BY shard""",
}
