"""Suggestions, spelling, co-occurrence synonyms, entities."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import cut, ship

WINDOW, PMI, NEIGHBOURS, PER_DOC, RELATED, SALT = 5, 1.0, 5, 10, 8, 16
#: Words, and their bytes, that are numbered on the driver and broadcast; of more words pairs travel as names.
NUMBERED, NUMBERED_BYTES = 1 << 25, 1 << 28
#: Words whose pairs a worker sorts at once (or those of one Arrow batch), and rows of pairs that a bucket gets on average at most.
STRETCH, BUCKET = 1 << 20, 1 << 23
#: By how much a PMI must be smaller to be surely smaller when rounded to nine places.
SLACK = 1e-8


def autocomplete(vocabulary: DataFrame, prefixes: DataFrame, k: int = 8) -> DataFrame:
    """prefix, word, freq, score, rank: words (word, freq) that begin with each prefix, by ln(1 + freq) and the share of the word that is typed.

    Words meet prefixes by equality on as many leading letters as the shortest prefix has, so both sides can be hashed.
    """
    p = prefixes.select(F.lower("prefix").alias("prefix")).distinct()
    shortest = p.where("prefix <> ''").agg(F.min(F.length("prefix"))).first()[0] or 1
    head = lambda c: F.substring(c, 1, shortest)
    pairs = vocabulary.withColumn("head", head(F.col("word"))).join(p.withColumn("head", head(F.col("prefix"))), "head").where(F.col("word").startswith(F.col("prefix")))
    score = F.log1p("freq") * F.length("prefix") / F.length("word")
    w = Window.partitionBy("prefix").orderBy(F.desc(F.round("score", 9)), "word")
    return pairs.select("prefix", "word", "freq", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spell(vocabulary: DataFrame, words: DataFrame, radius: int = 2, k: int = 5) -> DataFrame:
    """word, suggestion, distance, freq, rank: vocabulary entries within an edit distance; nearest, most frequent, first by name.

    Lengths that differ by more than the radius are never compared: each word is given every length that it may meet, so
    the two sides join by equality, spread over SALT parts of the vocabulary where Spark doesn't broadcast the words.
    """
    salt = F.pmod(F.xxhash64("suggestion"), F.lit(SALT))
    w = words.select("word").distinct()
    w = w.select("word", F.explode(F.sequence(F.greatest(F.length("word") - radius, F.lit(0)), F.length("word") + radius)).alias("_n"))
    w = w.select("word", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("_s"))
    rows = vocabulary.select(F.col("word").alias("suggestion"), "freq").select("suggestion", "freq", F.length("suggestion").alias("_n"), salt.alias("_s"))
    pairs = rows.join(w, ["_n", "_s"])
    near = pairs.withColumn("distance", F.levenshtein("suggestion", "word", radius).cast("bigint")).where("distance >= 0")
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "suggestion")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("word", "suggestion", "distance", "freq", "rank")


def pmi(docs: DataFrame, window: int = WINDOW, threshold: float = PMI, neighbours: int = NEIGHBOURS, of: DataFrame | None = None) -> DataFrame:
    """term, neighbour, pmi, rank: terms that share windows of successive words more than by chance, the best few of each. ``of`` (word): of these terms only, with the same rows.

    Windows are counted for pairs of places, not made (``_spans``), hence at most ``window`` rows a word, summed before the only shuffle of them.
    The words are counted first and numbered by name, so pairs travel as sorted, packed numbers (``_numbered``). With ``of`` only pairs with an asked
    word are sent, by name and to the asked one.
    """
    if of is not None:
        return _named(docs, window, threshold, neighbours, [r[0] for r in of.select("word").distinct().collect()])  # a stated set of queries
    words = cut(_words(docs, window).groupBy("a").agg(F.sum("c").alias("c")))
    size = words.agg(F.count("a").alias("words"), F.sum(F.octet_length("a")).alias("bytes"), F.sum(F.when(F.col("a").isNull(), F.col("c"))).alias("n")).first()
    if size["words"] > NUMBERED or (size["bytes"] or 0) > NUMBERED_BYTES or window >> 11:  # two words and a count must fit 63 bits
        return _named(docs, window, threshold, neighbours, None)
    return _numbered(docs, words, size["n"] or 0, window, threshold, neighbours)


def _named(docs: DataFrame, window: int, threshold: float, neighbours: int, asked: list[str] | None) -> DataFrame:
    """``pmi`` with pairs by name. Sums lie by their first term, so what that term counts alone is beside them; with ``asked`` it is the asked term."""
    counted = _windows(docs, window, asked).repartition("a").groupBy("a", "b").agg(F.sum("c").alias("c"))
    counted = cut(counted)
    n = counted.where("a is null").select(F.col("c").cast("double").alias("n"))
    single = counted.where("a = b").select("a", "c")
    pairs = counted.where("a <> b").select("a", "b", F.col("c").alias("c_ab"))
    scored = pairs.join(single.withColumnRenamed("c", "c_a"), "a").join(single.toDF("b", "c_b"), "b").crossJoin(F.broadcast(n))  # one row
    scored = scored.withColumn("pmi", F.log(F.col("c_ab") * F.col("n") / (F.col("c_a") * F.col("c_b")))).where(F.round("pmi", 9) >= threshold)
    if asked is None:
        both = scored.select(F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("term"), F.col("a").alias("neighbour")))).alias("x"), "pmi").select("x.*", "pmi")
    else:
        both = scored.select(F.col("a").alias("term"), F.col("b").alias("neighbour"), "pmi")
    w = Window.partitionBy("term").orderBy(F.desc(F.round("pmi", 9)), "neighbour")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= neighbours)


def _numbered(docs: DataFrame, words: DataFrame, n: int, window: int, threshold: float, neighbours: int) -> DataFrame:
    """``pmi`` with pairs as numbers; words (a, c) with the windows that hold each, n: all windows.

    A pair lies with its rarer word, which bounds what the pairs of one word come to: a frequent word's distinct pairs are with the few that are more frequent.
    There it is summed and scored, and goes on to both its words only if it can be among the best of each.
    The buckets are as many as the windows need. Scores are rounded and ranked by Spark, from a list for each term that holds all that may tie.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    table = words.where("a is not null").orderBy("a").toArrow()
    names, counts = table["a"].cast(pa.large_string()).combine_chunks(), table["c"].to_numpy()
    del table
    buckets = max(sc.defaultParallelism, -(-n * (window - 1) // BUCKET))
    known, ids, seed = _by_hash(names)
    # Three, since a worker holds only what its task names.
    numbers, often, texts = sc.broadcast((known, ids, seed)), sc.broadcast(counts.astype(np.min_scalar_type(counts.max(initial=0)))), sc.broadcast(names)
    blobs = "bucket int, pairs binary"
    lines = docs.select(T.folded_line(F.col("text")).alias("line"))
    pairs = lines.mapInArrow(_pack_pairs(numbers, often, window, buckets), blobs).repartitionById(buckets, "bucket")
    near = pairs.mapInArrow(_pack_near(often, n, threshold, neighbours, buckets), blobs).repartitionById(buckets, "bucket")
    lists = near.mapInArrow(_list_near(often, texts, n, neighbours, buckets), "term string, near array<struct<neighbour:string,x:double>>")
    ranked = F.array_sort(F.transform("near", lambda s: F.struct((-F.round(F.log(s["x"]), 9)).alias("order"), s["neighbour"].alias("neighbour"), F.log(s["x"]).alias("pmi"))))
    ranked = F.slice(F.filter(ranked, lambda s: -s["order"] >= threshold), 1, neighbours)
    return lists.select("term", F.posexplode(ranked).alias("rank", "x")).select("term", "x.neighbour", "x.pmi", (F.col("rank") + 1).alias("rank"))


def _hashes(names: pa.Array, seed: int) -> np.ndarray:
    """64 bits of each name, none of which is empty: the sum of its bytes, each times a random number of its place."""
    names = names.cast(pa.large_string())
    edges = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)[edges[0] : edges[-1]].astype(np.uint64)
    edges = edges - edges[0]
    at = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
    factors = np.random.default_rng(seed).integers(0, 1 << 64, at.max() + 1, np.uint64)
    return np.add.reduceat((data + np.uint64(1)) * factors[at], edges[:-1])


def _by_hash(names: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The names' hashes in order, the number of the name of each, and the first seed with which no two names share a hash."""
    step = 1 << 18
    hashes = np.concatenate([np.empty(0, np.uint64), *(_hashes(names[i : i + step], seed) for i in range(0, len(names), step))])
    ids = np.argsort(hashes)
    hashes = hashes[ids]
    return (hashes, ids.astype(np.int32), seed) if (hashes[1:] != hashes[:-1]).all() else _by_hash(names, seed + 1)


def _pack(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and their counts, compressed byte by byte of the gaps."""
    head, planes = [len(pairs)], []
    for x in (np.diff(pairs, prepend=0), counts.astype(np.int64)):
        wide = max(1, (int(x.max()).bit_length() + 7) // 8)
        head.append(wide)
        planes.append(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())
    return np.array(head, "<i8").tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, *wides = np.frombuffer(blob, "<i8", 3).tolist()
    raw = np.frombuffer(pa.decompress(memoryview(blob)[24:], n * sum(wides), "zstd", asbytes=True), np.uint8)
    columns, at = [], 0
    for wide in wides:
        x = np.zeros((n, 8), np.uint8)
        x[:, :wide] = raw[at : at + n * wide].reshape(wide, n).T
        columns.append(x.view("<i8").ravel())
        at += n * wide
    return np.cumsum(columns[0]), columns[1]


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the sum of the counts of each. Counts are sorted within the pairs' numbers where they have room."""
    room = 63 - int(pairs.max()).bit_length()
    if int(counts.max()) >> room:
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
    else:
        both = pairs << room
        both |= counts
        both.sort()
        counts = both & ((1 << room) - 1)
        both >>= room
        pairs = both
    heads = _heads(pairs)
    return pairs[heads], np.add.reduceat(counts, heads)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


class _Places:
    """A pair as one number: the place of its first word, which is in order of buckets, before the number of the second."""

    def __init__(self, words: int, buckets: int):
        self.buckets, self.each, self.bits = buckets, max(1, -(-words // buckets)), max(1, (words - 1).bit_length())

    def of(self, ids):
        return ids % self.buckets * self.each + ids // self.buckets

    def split(self, pairs):
        place, second = pairs >> self.bits, pairs & ((1 << self.bits) - 1)
        return place % self.each * self.buckets + place // self.each, second

    def blobs(self, pairs, counts):
        """Of sorted pairs a row for each bucket."""
        edges = np.searchsorted(pairs, np.arange(self.buckets + 1) * self.each << self.bits)
        some = np.flatnonzero(np.diff(edges))
        packed = [_pack(pairs[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]]) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "pairs"])


def _pack_pairs(numbers, often, window: int, buckets: int):
    def run(batches):
        known, ids, seed = numbers.value
        counts = often.value
        places, bits = _Places(len(ids), buckets), window.bit_length()
        docs, words, held, seen = [], [], 0, 0

        def flush():
            doc, word = np.concatenate(docs), np.concatenate(words)
            docs.clear()
            words.clear()
            at, until, since = _spans(doc, word, window)
            n, own = counts[word], places.of(word)
            found = []
            for d in range(1, window):
                p, q = at[: len(at) - d], at[d:]
                c = np.minimum(until[: len(at) - d], until[d:]) - since[d:]
                p = np.flatnonzero((c > 0) & (doc[p] == doc[q]) & (word[p] != word[q]))
                q, c = p + d, c[p]
                first = (n[p] < n[q]) | ((n[p] == n[q]) & (word[p] < word[q]))
                found.append(((np.where(first, own[p], own[q]) << places.bits | np.where(first, word[q], word[p])) << bits) | c)
            del doc, word, at, until, since, n, own
            if sum(map(len, found)):
                pairs, found = np.concatenate(found), None
                pairs.sort()
                c = pairs & ((1 << bits) - 1)
                pairs >>= bits
                heads = _heads(pairs)
                yield places.blobs(pairs[heads], np.add.reduceat(c, heads))

        for batch in batches:
            doc, codes, names, _ = _kept_words(batch, window)
            if held and held + len(codes) > STRETCH:
                yield from flush()
                held = 0
            if not len(codes):
                continue
            used = np.unique(codes)  # others may not be numbered
            number = np.zeros(len(names), np.int64)
            number[used] = ids[np.searchsorted(known, _hashes(names.take(pa.array(used)), seed))]
            docs.append(doc + seen)
            words.append(number[codes])
            seen, held = seen + batch.num_rows, held + len(codes)
            del doc, codes, names
        if held:
            yield from flush()

    return run


def _merged(batches) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a bucket, summed; more than BUCKET rows are summed as they come."""
    pairs, counts, held, limit = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, BUCKET

    def joined():
        p, c = np.concatenate(pairs), np.concatenate(counts)
        pairs.clear()
        counts.clear()
        return _summed(p, c) if len(p) else (p, c)

    for batch in batches:
        for blob in batch.column(1):
            p, c = _unpack(blob.as_py())
            pairs.append(p)
            counts.append(c)
            held += len(p)
            if held > limit:
                p, c = joined()
                pairs.append(p)
                counts.append(c)
                held, limit = len(p), max(BUCKET, 2 * len(p))
    return joined()


def _scores(counts, a, b, c, n):
    """What the PMI is the logarithm of, as Spark computes it."""
    return c * float(n) / (counts[a].astype(np.int64) * counts[b].astype(np.int64))


def _best(term: np.ndarray, other: np.ndarray, x: np.ndarray, most: int, words: int) -> np.ndarray:
    """Which pairs can be among the best few of their term when scores are rounded and ties go by other: of equal scores the first few, of others those not surely too low.

    Terms are at most 2^25 and logarithms within 64 of 0, so that one number holds both and is sorted; pairs by all three keys only where more than the few are left.
    """
    low = ((64 - np.log(x)) * 2.0**31).astype(np.int64)
    both = np.sort(term << 38 | low)
    low >>= 6  # of 32 bits
    t = both >> 38
    heads = _heads(t)
    heads = heads[np.diff(np.append(heads, len(t))) > most]
    worst = np.full(words, (1 << 32) - 1, np.uint32)
    worst[t[heads]] = ((both[heads + most - 1] & ((1 << 38) - 1)) + int(SLACK * 2**31)) >> 6
    some = np.flatnonzero(low <= worst[term])
    del both, t, low, worst
    t = np.sort(term[some])
    heads = _heads(t)
    many = np.zeros(words, bool)
    many[t[heads[np.diff(np.append(heads, len(t))) > most]]] = True
    many = many[term[some]]
    tied = some[many]
    tied = tied[np.lexsort((other[tied], x[tied], term[tied]))]
    t, v = term[tied], x[tied]
    heads = _heads(t, v)
    return np.sort(np.concatenate((some[~many], tied[np.arange(len(t)) - np.repeat(heads, np.diff(np.append(heads, len(t)))) < most])))


def _pack_near(often, n: int, threshold: float, most: int, buckets: int):
    def run(batches):
        counts = often.value
        places = _Places(len(counts), buckets)
        pairs, c = _merged(batches)
        a, b = places.split(pairs)
        x = _scores(counts, a, b, c, n)
        some = np.flatnonzero(x >= math.exp(threshold) * (1 - SLACK))
        a, b, c, x = a[some], b[some], c[some], x[some]
        keys, sums = [], []
        for term, other in ((a, b), (b, a)):
            some = _best(term, other, x, most, len(counts))
            keys.append(places.of(term[some]) << places.bits | other[some])
            sums.append(c[some])
        if len(a):
            yield places.blobs(*_summed(np.concatenate(keys), np.concatenate(sums)))

    return run


def _list_near(often, texts, n: int, most: int, buckets: int):
    def run(batches):
        counts, names = often.value, texts.value
        pairs, c = _merged(batches)
        term, other = _Places(len(counts), buckets).split(pairs)
        x = _scores(counts, term, other, c, n)
        some = _best(term, other, x, most, len(counts))
        term, other, x = term[some], other[some], x[some]
        heads = _heads(term)
        edges = np.append(heads, len(term))
        for i in range(0, len(heads), 1 << 14):
            e = edges[i : i + (1 << 14) + 1]
            own, part = term[e[:-1]], slice(e[0], e[-1])
            near = pa.StructArray.from_arrays([names.take(pa.array(other[part])).cast(pa.string()), pa.array(x[part])], ["neighbour", "x"])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)).cast(pa.string()), pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), near)], ["term", "near"])

    return run


def _windows(docs: DataFrame, window: int, asked: list[str] | None) -> DataFrame:
    """a, b, c: in how many windows of a text's successive words (longer than 1, no stop words) a and b stand, once for each Arrow batch; a = b for a term alone, (null, null) for all windows.

    a < b without ``asked``; else a is an asked term, and a pair of two asked terms comes both ways.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((window, asked))
    return docs.select(T.folded_line(F.col("text")).alias("line")).mapInArrow(_count_windows(shared), "c bigint, a string, b string")


def _words(docs: DataFrame, window: int) -> DataFrame:
    """a, c: in how many windows each term stands, and of a null how many there are, once for each Arrow batch."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            doc, codes, names, n = _kept_words(batch, window)
            if not len(codes):
                continue
            _, until, since = _spans(doc, codes, window)
            sums = np.bincount(codes, np.maximum(until - since, 0), len(names)).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.nulls(1, pa.string())], ["c", "a"])
            for i in range(0, len(some), 1 << 16):
                k = some[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(sums[k]), names.take(pa.array(k)).cast(pa.string())], ["c", "a"])

    return docs.select(T.folded_line(F.col("text")).alias("line")).mapInArrow(run, "c bigint, a string")


def _kept_words(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """Of a batch's texts that fill a window the words that count: their rows, codes and names by code; and the number of windows."""
    doc, codes, names = T.coded_words(batch.column(0))
    kept = ~pc.is_in(names, pa.array(["", *T.STOP_WORDS])).to_numpy(zero_copy_only=False) & (pc.utf8_length(names).to_numpy(zero_copy_only=False) > 1)
    some = kept[codes]
    doc, codes = doc[some], codes[some]
    n = np.bincount(doc, minlength=batch.num_rows)
    some = n[doc] >= window
    return doc[some], codes[some], names, int((n[n >= window] - window + 1).sum())


def _spans(doc: np.ndarray, codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every place of words in order: its number, and the windows that it counts for, by their last place: since, until.

    A window belongs to the last place of a term in it. So places p <= q of two terms share the windows that end at q or later and before
    either term comes again, and none is counted twice.
    """
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    edges = np.concatenate((first, [len(doc)]))
    begins, ends = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
    at = np.arange(len(codes))
    again = at + window  # where the term comes again, or out of reach
    for d in range(window - 1, 0, -1):
        same = np.flatnonzero((codes[d:] == codes[:-d]) & (doc[d:] == doc[:-d]))
        again[same] = same + d
    return at, np.minimum(np.minimum(at + window, ends), again), np.maximum(at, begins + window - 1)  # a window that ends at until or later lacks this place as the last of its term


def _count_windows(shared):
    def run(batches):
        window, asked = shared.value
        for batch in batches:
            doc, codes, names, n = _kept_words(batch, window)
            if not len(codes):
                continue
            by = pc.array_sort_indices(names).to_numpy()
            place = np.empty(len(names), np.int64)
            place[by] = np.arange(len(names))
            names, codes = names.take(pa.array(by)), place[codes]
            at, until, since = _spans(doc, codes, window)
            want = None if asked is None else pc.is_in(names, pa.array(asked, pa.string())).to_numpy(zero_copy_only=False)
            keys, counts = [], []
            for d in range(window):
                p = at[: len(at) - d]
                q = p + d
                c = np.minimum(until[p], until[q]) - since[q]
                good = (c > 0) & (doc[p] == doc[q])
                if d:
                    good &= codes[p] != codes[q]
                p, q, c = codes[p[good]], codes[q[good]], c[good]
                ways = [(p, q, c)] if not d else [(np.minimum(p, q), np.maximum(p, q), c)] if want is None else [(x[want[x]], y[want[x]], c[want[x]]) for x, y in ((p, q), (q, p))]
                for x, y, z in ways:
                    keys.append(x * len(names) + y)
                    counts.append(z)
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sums, keys = np.add.reduceat(counts, heads), keys[heads]
            total = pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string())], ["c", "a", "b"])
            yield total
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(sums[i : i + (1 << 16)], pa.int64()), names.take(pa.array(k // len(names))), names.take(pa.array(k % len(names)))], ["c", "a", "b"])

    return run


def expand_terms(queries: DataFrame, thesaurus: DataFrame, most: int = 4) -> DataFrame:
    """query_id, word, expansion, place: every word of a query (query_id, text) at place 0 and its first ``most`` synonyms of a thesaurus (term, neighbour, rank).

    The plan for a table of queries of what ``language.expand`` does to one tree; stop words aren't expanded.
    """
    words = query_words(queries)
    near = thesaurus.where((F.col("rank") <= most) & (F.col("term") != F.col("neighbour"))).select(F.col("term").alias("word"), F.col("neighbour").alias("expansion"), F.col("rank").alias("place"))
    return words.select("query_id", "word", F.col("word").alias("expansion"), F.lit(0).alias("place")).union(words.join(near, "word").select("query_id", "word", "expansion", "place"))


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, word: the folded words of each query (query_id, text), once each, without stop words."""
    return queries.select("query_id", F.explode(F.array_distinct(F.transform(T.tokens(F.col("text")), T.fold))).alias("word")).where(~T.is_stop_word(F.col("word")))


def two_hop(synonyms: DataFrame) -> DataFrame:
    """term, other, hop: what an undirected synonym list (a, b) reaches in one or two steps, at its least distance."""
    s = synonyms.select("a", "b").union(synonyms.select("b", "a")).toDF("a", "b").where("a <> b").distinct()
    far = s.alias("x").join(s.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    return s.withColumn("hop", F.lit(1)).union(far.where("a <> b").distinct().withColumn("hop", F.lit(2))).groupBy(F.col("a").alias("term"), F.col("b").alias("other")).agg(F.min("hop").alias("hop"))


def entities(docs: DataFrame, most: int = PER_DOC) -> DataFrame:
    """doc_id, entity, weight, rank: capitalised phrases; a title counts 3, the text 1; the heaviest few of each document, ties by name."""
    title = T.entities(F.col("title")) if "title" in docs.columns else F.array().cast("array<string>")
    rows = docs.select("doc_id", F.explode(F.concat(F.transform(title, lambda e: F.struct(e.alias("entity"), F.lit(3).alias("n"))), F.transform(T.entities(F.col("text")), lambda e: F.struct(e.alias("entity"), F.lit(1).alias("n"))))).alias("x"))
    sums = rows.groupBy("doc_id", "x.entity").agg(F.sum("x.n").alias("weight"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "entity")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def entity_counts(found: DataFrame) -> DataFrame:
    """entity, docs."""
    return found.groupBy("entity").agg(F.count_distinct("doc_id").alias("docs"))


def entity_edges(found: DataFrame) -> DataFrame:
    """a, b, weight with a < b: documents that hold both; at most PER_DOC entities of a document pair up."""
    sets = found.groupBy("doc_id").agg(F.collect_set("entity").alias("es"))
    return sets.select(F.explode("es").alias("a"), "es").select("a", F.explode("es").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def related(edges: DataFrame, most: int = RELATED) -> DataFrame:
    """entity, other, weight, rank: the heaviest neighbours of each entity, ties by name."""
    both = edges.select(F.col("a").alias("entity"), F.col("b").alias("other"), "weight").union(edges.select("b", "a", "weight"))
    w = Window.partitionBy("entity").orderBy(F.desc("weight"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def find_entities(counts: DataFrame, query: str | None) -> DataFrame:
    """entity, docs: without a query the 20 most frequent, else the 5 most frequent whose name holds it, whatever the case."""
    rows = counts if not query else counts.where(F.lower("entity").contains(query.lower()))
    return rows.orderBy(F.desc("docs"), "entity").limit(5 if query else 20)
