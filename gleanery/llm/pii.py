"""Personal data: base patterns, and information-theoretic sanitisation of what reveals it; DataFrame functions only.

Base spans come from four patterns, each leftmost and without overlaps, with start and end in code points.
They are found by cutting the text at the pattern: the lengths of what lies between and of the matches add up to
the offsets, by prefix sums in log n steps over arrays, so the work is linear but for that. The patterns are possessive: Java's
engine takes linear time and no deep stack on any text.

Protected entities are the values found (an address in lower case, a number without separators) and, above them, the
kinds themselves. C-sanitisation: a term t tells of an entity c their pointwise mutual information, log2(p(c, t) / (p(c) p(t))) of the
-log2 p(c) bits that there are to tell. Probabilities are shares of all documents, counted over whole texts: a term is a
word of three letters or more, in lower case, outside of addresses (other spans hold no letters). Three conditions make a term disclosing:

* p(c | t), estimated as n(c, t) / (n(t) + 1) against the bias of rare terms, is REMOVE or more (the term is removed; 0.6 bits
  are left to tell) or GENERALISE or more (it becomes a general word; 0.8 bits). A term of one document never gets there.
* By that estimate it tells at least SHARE of what there is to tell; where most documents hold c, no term does.
* It stands with c between two different pairs of neighbouring words at least, so that copies of one passage aren't evidence.

Every occurrence of a disclosing term is sanitised, wherever it stands: a text that names it without the entity discloses most.

Scale: entities in one document only can have no disclosing term and go first. What is shuffled is a row for each
(entity, term), combined on the map side, and one for each candidate term; entities and terms are 64-bit hashes there.
Hot entities and terms are only ever keys of sums. Candidate and disclosing terms and the keys of documents that hold them are
broadcast if they are few (BROADCAST at most, counted first); beyond that both sides are shuffled, with the same result.

Cases: a null text is empty and has no spans; rows repeated count as documents and get the same spans each; a null doc_id is
kept; extra columns are ignored by ``find`` and kept by ``sanitise``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, let, running

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
REMOVE, GENERALISE, SHARE, BROADCAST = 0.66, 0.59, 0.8, 200_000
_SPAN = "struct<s:int,k:int,e:int,m:string>"
_PLAIN = "array<struct<s:int,k:int,e:int>>"
#: A match may begin where the one before ended (\G) or where no part of it can precede.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9\x20-]{14,}"  # once every separator that isn't between two digits is masked, runs are chains
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def _valid_ip(m: Column) -> Column:
    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return (F.length(digits) <= 3) & (F.substr(digits, F.lit(1), F.lit(3)).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), part)


def _valid_card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _valid_phone(m: Column) -> Column:
    return F.length(F.translate(m, "+ ().-", "")).between(10, 15)


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order: (e, m), the end in code points and the match."""

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(running(lengths, lambda a, b: a + b), found, lambda e, m: F.struct(e.alias("e"), m.alias("m")))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _spans(text: Column, pattern: str, kind: int, valid) -> Column:
    """Valid matches of a pattern as an array of spans."""
    good = F.filter(_matches(text, pattern), lambda x: valid(x["m"]))
    return F.transform(good, lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind: (s, k, e, m)."""
    none = F.array().cast(f"array<{_SPAN}>")
    chains = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\n")
    digits = text.rlike(r"[0-9]")
    return F.sort_array(F.concat(
        F.when(text.contains("@"), _spans(text, EMAIL, 0, lambda m: F.lit(True))).otherwise(none),
        F.when(digits & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans(text, IP, 1, _valid_ip)).otherwise(none),
        F.when(digits & text.rlike(r"[0-9][0-9\x20-]{12,}[0-9]"), _spans(chains, CARD, 2, _valid_card)).otherwise(none),
        F.when(text.contains("+"), _spans(text, PHONE, 3, _valid_phone)).otherwise(none),
    ))


def _entities(spans: Column) -> Column:
    """The distinct entities of base spans, as hashes: each value, and each kind."""
    value = lambda x: F.xxhash64(x["k"], F.when(x["k"] < 2, F.lower(x["m"])).otherwise(F.regexp_replace(x["m"], r"[\x20().-]", "")))
    return F.array_distinct(F.concat(F.transform(spans, value), F.transform(spans, lambda x: F.xxhash64(x["k"]))))


def _masked(text: Column) -> Column:
    """The text with every character of an address as a line end, so that other words keep their places."""
    parts = F.zip_with(F.split(text, EMAIL, -1), F.regexp_extract_all(text, F.lit(EMAIL), 0), lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit("\n"), F.length(m)), F.lit(""))))
    return F.when(text.contains("@"), F.array_join(parts, "")).otherwise(text)


def _words(masked: Column) -> Column:
    return F.transform(F.regexp_extract_all(masked, F.lit(TERM), 0), F.lower)


def _key() -> list[Column]:
    """Rows of one id and text have the same spans, so that is what they are looked up by."""
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(_text()).alias("th")]


def _few(rows: DataFrame) -> DataFrame:
    """Rows to be broadcast if a count says that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def analyse(docs: DataFrame) -> DataFrame:
    """doc_id, th, base (spans) of every row and, where there are any, entities and the masked text, with the lineage cut."""
    rows = docs.select(*_key(), _text().alias("text")).withColumn("base", base_spans(F.col("text")))
    plain = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    private = F.size("base") > 0
    return cut(rows.select("doc_id", "th", plain.alias("base"), F.when(private, _entities(F.col("base"))).alias("entities"), F.when(private, _masked(F.col("text"))).alias("masked")))


def _term_hashes(docs: DataFrame) -> DataFrame:
    """t, the distinct terms of every document as hashes, beside doc_id and th."""
    return docs.select(*_key(), F.explode(F.array_distinct(F.transform(_words(_masked(_text())), lambda w: F.xxhash64(w)))).alias("t"))


def disclosing(docs: DataFrame, analysed: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, share: float = SHARE) -> DataFrame:
    """t (hash) and k (kind) of the terms that disclose an entity, with the lineage cut."""
    private = analysed.where("entities is not null")
    n_c = private.select(F.explode("entities").alias("c")).groupBy("c").agg(F.count("*").alias("n_c")).where("n_c > 1")
    said = private.select("entities", _words(F.col("masked")).alias("ws"))
    hashed = F.transform("ws", lambda w, i: F.struct(F.xxhash64(w).alias("t"), F.xxhash64(F.coalesce(F.get("ws", i - 1), F.lit("")), F.coalesce(F.get("ws", i + 1), F.lit(""))).alias("at")))
    # One row for a document's term, and one for every place of it: a pair's count and whether its places differ are one sum.
    once = F.transform(F.array_distinct(F.transform("ws", lambda w: F.xxhash64(w))), lambda t: F.struct(t.alias("t"), F.lit(None).cast("bigint").alias("at")))
    rows = said.select("entities", F.explode(F.concat(once, hashed)).alias("x")).select(F.explode("entities").alias("c"), "x.t", "x.at")
    rows = rows.join(_few(cut(n_c)), "c")
    pairs = rows.groupBy("c", "t").agg(F.first("n_c").alias("n_c"), F.count_if(F.col("at").isNull()).alias("n_ct"), F.min("at").alias("low"), F.max("at").alias("high"))
    candidates = cut(pairs.where("n_ct > 1 and low <> high").select("c", "t", "n_c", "n_ct"))

    terms = candidates.select("t").distinct()
    words = _term_hashes(docs).select("t")
    if terms.count() <= BROADCAST:
        words = words.join(F.broadcast(terms), "t", "left_semi")
    n_t = words.groupBy("t").agg(F.count("*").alias("n_t"))
    n = analysed.count()
    sure = F.col("n_ct").cast("double") / (F.col("n_t") + 1)
    # To tell ``share`` of -log2 p(c) is that p(c | t) ** (1 / (1 - share)) isn't below p(c).
    power = round(1 / (1 - share))
    told = sure
    for _ in range(power - 1):
        told = told * sure
    over = candidates.join(n_t, "t").where((sure >= generalise) & (told * F.lit(float(n)) >= F.col("n_c")))
    return cut(over.groupBy("t").agg(F.min(F.when(sure >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise"))).alias("k")))


def extra_spans(docs: DataFrame, analysed: DataFrame, **options) -> DataFrame:
    """doc_id, th, extra: for every document with disclosing terms their spans (s, k, e), with the lineage cut."""
    over = _few(disclosing(docs, analysed, **options))
    holding = cut(_term_hashes(docs).join(over, "t", "left_semi").select("doc_id", "th").distinct())
    held = docs.select(*_key(), _text().alias("text")).join(_few(holding.toDF("_gl_id2", "_gl_th2")), F.col("doc_id").eqNullSafe(F.col("_gl_id2")) & (F.col("th") == F.col("_gl_th2")), "left_semi")
    placed = F.transform(_matches(_masked(F.col("text")), TERM), lambda x: F.struct(F.xxhash64(F.lower(x["m"])).alias("t"), (x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e")))
    hit = held.select("doc_id", "th", F.explode(placed).alias("x")).select("doc_id", "th", "x.*").join(over, "t")
    # Rows repeated find the same spans again.
    return cut(hit.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("s", "k", "e"))).alias("extra")))


def _joined(rows: DataFrame, extra: DataFrame) -> DataFrame:
    extra = _few(extra.select(F.col("doc_id").alias("_gl_id2"), F.col("th").alias("_gl_th2"), F.col("extra").alias("_gl_extra")))
    return rows.join(extra, F.col("_gl_id").eqNullSafe(F.col("_gl_id2")) & (F.col("_gl_th") == F.col("_gl_th2")), "left").drop("_gl_id2", "_gl_th2")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans, arrays of (s, k, e) with k in KINDS, for every row of ``docs`` (doc_id, text)."""
    analysed = analyse(docs)
    rows = _joined(analysed.select("doc_id", F.col("doc_id").alias("_gl_id"), F.col("th").alias("_gl_th"), "base"), extra_spans(docs, analysed, **options))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("_gl_extra", F.array().cast(_PLAIN)))).alias("spans"))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def find_digest(docs: DataFrame) -> DataFrame:
    rows = find(docs)
    # A lambda's second argument would be the index, so k stays free: each is evaluated in its own turn of the loop.
    n = [F.size(F.array_remove(F.transform("base", lambda x: F.when(x["k"] == F.lit(k), 1).otherwise(0)), 0)).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *n, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced: by its kind in brackets, by [TERM] if generalised, by nothing if removed; what overlaps an earlier span goes with it."""
    marks = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[TERM]")])
    reach = running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))

    def whole(v: Column) -> Column:
        # In UTF-32 a stretch of the text is found without counting from its start.
        stretch = lambda low, high: F.decode(F.substr(v["wide"], low * 4 + 1, (high - low) * 4), "UTF-32")
        before = lambda i: F.coalesce(F.get(v["reach"], i - 1), F.lit(0))
        pieces = F.transform(v["spans"], lambda x, i: F.when(x["s"] >= before(i), F.concat(stretch(before(i), x["s"]), F.get(v["marks"], x["k"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), stretch(F.array_max(v["reach"]), v["length"]))

    return let(F.struct(F.encode(text, "UTF-32").alias("wide"), reach.alias("reach"), spans.alias("spans"), marks.alias("marks"), F.length(text).alias("length")), whole)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data and what discloses it replaced in ``text``; other columns, and rows without spans, as they are.

    Base spans are found again in the pass that writes, so that only the spans of disclosing terms have to meet the texts.
    """
    extra = extra_spans(docs, analyse(docs), **options)
    rows = docs.withColumns({"_gl_id": F.col("doc_id").cast("bigint"), "_gl_th": F.xxhash64(_text()), "_gl_base": base_spans(_text())})
    base = F.transform("_gl_base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = _joined(rows, extra).withColumn("_gl_all", F.sort_array(F.concat(base, F.coalesce("_gl_extra", F.array().cast(_PLAIN)))))
    done = F.when(F.size("_gl_all") > 0, replaced(_text(), F.col("_gl_all"))).otherwise(F.col("text"))
    return rows.select(*[done.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def find_sql() -> str:
    """The same result in DuckDB's SQL, from the patterns as they are stated, and with windows for what is summed here."""
    names = "['email', 'ip', 'card', 'phone', 'remove', 'generalise']"
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def cuts(text: str, pattern: str) -> str:
        return f"unnest(regexp_split_to_array({text}, '{pattern}')) AS g, unnest(list_append(regexp_extract_all({text}, '{pattern}'), NULL)) AS m, unnest(range(len(regexp_extract_all({text}, '{pattern}')) + 1)) AS i"

    found = " UNION ALL ".join(f"SELECT r, {k} AS k, {cuts('text', p)} FROM d" for k, p in enumerate(kinds))
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda j: CASE WHEN (length({digits}) - j) % 2 = 1 THEN CAST({digits}[j + 1] AS INTEGER) WHEN CAST({digits}[j + 1] AS INTEGER) > 4 THEN CAST({digits}[j + 1] AS INTEGER) * 2 - 9 ELSE CAST({digits}[j + 1] AS INTEGER) * 2 END)) % 10 = 0"
    valid = f"""CASE k WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
      WHEN 2 THEN length({digits}) BETWEEN 14 AND 19 AND {luhn} ELSE length({digits}) BETWEEN 10 AND 15 END"""
    said = f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e), '')"
    term = "\\p{L}{3,}"
    mail = kinds[0]
    told = " * ".join(["sure"] * round(1 / (1 - SHARE)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
c AS ({found}),
p AS (SELECT r, k, m, CAST(sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM c),
b AS (SELECT r, k, m, e - length(m) AS s, e FROM p WHERE m IS NOT NULL AND {valid}),
x AS (SELECT DISTINCT r, unnest([k || ':' || CASE WHEN k < 2 THEN lower(m) ELSE regexp_replace(m, '[ ().-]', '', 'g') END, k || '']) AS entity FROM b),
ent AS (SELECT entity, count(*) AS n_c FROM x GROUP BY entity),
masked AS (SELECT r, array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{mail}'), regexp_extract_all(text, '{mail}')), lambda y: y[1] || coalesce(repeat(chr(10), length(y[2])), '')), '') AS text FROM d),
t0 AS (SELECT r, {cuts('text', term)} FROM masked),
t1 AS (SELECT r, i, lower(m) AS term, m, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i) AS e FROM t0),
t AS (SELECT r, term, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, struct_pack(a := lag(term) OVER w, b := lead(term) OVER w) AS beside FROM t1 WHERE m IS NOT NULL WINDOW w AS (PARTITION BY r ORDER BY i)),
pair AS (SELECT entity, term, count(DISTINCT r) AS n_ct FROM t JOIN x USING (r) GROUP BY ALL HAVING count(DISTINCT beside) > 1),
freq AS (SELECT term, count(DISTINCT r) AS n_t FROM t GROUP BY term),
over AS (SELECT term, min(CASE WHEN sure >= {REMOVE} THEN 4 ELSE 5 END) AS k FROM (
  SELECT term, n_c, CAST(n_ct AS DOUBLE) / (n_t + 1) AS sure FROM pair JOIN ent USING (entity) JOIN freq USING (term))
  WHERE sure >= {GENERALISE} AND {told} * CAST((SELECT count(*) FROM d) AS DOUBLE) >= n_c GROUP BY term),
extra AS (SELECT r, k, s, e FROM t JOIN over USING (term)),
base AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, {said} AS said FROM b GROUP BY r),
allof AS (SELECT r, {said} AS spans FROM (SELECT r, k, s, e FROM b UNION ALL SELECT r, k, s, e FROM extra) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN allof USING (r)
"""
