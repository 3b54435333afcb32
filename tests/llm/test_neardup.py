"""The pipeline's near-duplicate stage against brute-force Jaccard over five-word shingles."""

import random

import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"


def brute_kept(rows):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def edited():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    licence, out = " ".join(word() for _ in range(40)), []
    for _ in range(60):
        base = [word() for _ in range(rnd.randint(30, 300))]
        out.append(" ".join([licence, *base]))
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join([licence, *copy]))
    out += [out[0], out[0].upper(), None, "", " \t", "a b", "A  B", "a b c d e", "a b c d f"]
    return list(enumerate(out))


@pytest.mark.parametrize("made", [True, False])
def test_near_duplicate_stage_is_brute_force_jaccard(spark, made):
    df = spark.createDataFrame(edited(), "doc_id long, text string") if made else spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, SMALL)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows)


def test_families_that_share_half_a_text(spark):
    """Copies of two texts that share enough for their leaders to be met, chains between them, and many copies of one."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    one = [word() for _ in range(120)]
    two = one[:80] + [word() for _ in range(40)]
    rows = []
    for share in range(0, 41, 2):  # a chain from one family to the other
        rows.append(one[:80] + two[80 : 80 + share] + one[80 + share :])
    for family in (one, two):
        for _ in range(60):
            copy = list(family)
            copy[rnd.randrange(120)] = word()
            rows.append(copy)
    other = [word() for _ in range(60)]
    rows += [one[:60] + other, one[:55] + [word() for _ in range(5)] + other]
    rnd.shuffle(rows)
    for kept in (rows, [r for r in rows if r[80:100] == one[80:100] or r[100:] == two[100:]]):
        df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(kept)], "doc_id long, text string")
        got = corpus_pipeline.STAGES[1][1](spark, df, SMALL)
        assert sorted(r["doc_id"] for r in got.collect()) == brute_kept([(i, " ".join(r)) for i, r in enumerate(kept)])
