"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are the runs of 3 and 4 bytes of the lower-cased text, with everything ASCII that isn't a letter
as a space, so that word ends are part of them. Each hashes into one of 2**14 rows of an embedding; a text is the mean
of its subwords' rows, and a linear softmax over the learned languages reads it. Embedding and softmax
are trained together by stochastic gradient descent in numpy, on at most ``per_language`` texts of each
language (a documented bound: hash sampling at a rate from the exact counts). A quarter of them
is kept from training and sets the temperature of the scores and the score under which a text is rejected.

To predict, embedding and softmax are multiplied out into one table: one narrow pass, no shuffle.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; a null language teaches
nothing; where nothing can be learned every text is ``und``; rows repeated stay repeated; a null doc_id
counts as held out; extra columns are ignored by ``predict`` and kept by ``keep_identified``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import held_out, map_batches, release, ship, text_of

BITS, DIM, PER_LANGUAGE, EPOCHS, STEPS, RATE, SEED = 14, 16, 1000, 6, 600, 20.0, 42
CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Rows of the embedding that a text's subwords hash into, for a stretch of the text at a time."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" "
    x = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(x) - 3), CHUNK):
        part = x[at : at + CHUNK + 3].astype(np.uint32)
        three = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        four = (three[:-1] << 8) | part[3:]
        if at + CHUNK + 3 < len(x):  # the next stretch begins with the 3-byte run that ends here
            three = three[:-1]
        both = np.concatenate((three, four ^ np.uint32(0x5BD1E995)))
        yield (both * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def counts(text: str) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for rows in subwords(text):
        total += np.bincount(rows, minlength=1 << BITS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # 2**BITS x languages: embedding times softmax, at the calibrated temperature
    bias: np.ndarray
    reject_below: float

    def score(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        if len(text) < 2000:
            rows = np.concatenate(list(subwords(text)))
            z = self.table[rows].mean(axis=0) + self.bias
        else:
            c = counts(text)
            z = c @ self.table / c.sum() + self.bias
        z = np.exp(z - z.max())
        best = int(z.argmax())
        return self.languages[best], float(z[best] / z.sum())


def fit(languages: list[str], labels: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on (rows, weights) of each text, weights summing to 1; every fourth text calibrates."""
    n, c = len(labels), len(languages)
    if not n:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, c)), np.zeros(c)
    out += rng.normal(0, 0.1, out.shape)
    order = rng.permutation(n)
    keep, test = (order[n // 4 :], order[: n // 4]) if n >= 8 else (order, order)

    def forward(which: np.ndarray):
        rows = np.concatenate([features[i][0] for i in which])
        weights = np.concatenate([features[i][1] for i in which])
        starts = np.cumsum([0, *(len(features[i][0]) for i in which[:-1])])
        hidden = np.add.reduceat(emb[rows] * weights[:, None], starts, axis=0)
        z = hidden @ out + bias
        return rows, weights, hidden, z

    steps, size = 0, 32
    epochs = max(epochs, -(-STEPS // -(-len(keep) // size)))  # few texts are gone over more often
    total = epochs * -(-len(keep) // size)
    for _ in range(epochs):
        for at in range(0, len(keep), size):
            which = keep[at : at + size]
            rows, weights, hidden, z = forward(which)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(which)), labels[which]] -= 1
            p /= len(which)
            rate = RATE * (1 - steps / total)
            back = np.repeat(p @ out.T, [len(features[i][0]) for i in which], axis=0) * weights[:, None]
            out -= rate * hidden.T @ p
            bias -= 0.1 * rate * p.sum(axis=0)
            used, inverse = np.unique(rows, return_inverse=True)
            change = np.stack([np.bincount(inverse, back[:, d], len(used)) for d in range(DIM)], axis=1)
            emb[used] -= rate * change
            steps += 1
        keep = rng.permutation(keep)
    z = np.concatenate([forward(test[i : i + 256])[3] for i in range(0, len(test), 256)])

    def loss(t: float) -> float:
        y = z * t
        y = y - y.max(axis=1, keepdims=True)
        return float((np.log(np.exp(y).sum(axis=1)) - y[np.arange(len(test)), labels[test]]).mean())

    t = min(np.geomspace(0.05, 20, 61), key=loss)
    y = np.exp((z - z.max(axis=1, keepdims=True)) * t)
    top = (y / y.sum(axis=1, keepdims=True)).max(axis=1)
    right = z.argmax(axis=1) == labels[test]
    # Reject what scores below nearly every text that is read rightly, but nothing above the middle of pure chance and an even
    # chance: texts of two or three languages are kept.
    below = min((1 / c + 0.5) / 2, float(np.quantile(top[right], 0.001))) if right.any() else 0.0
    return Model(languages, (emb @ out * t).astype(np.float32), bias * t, below)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, **options) -> Model:
    """Learn from the texts with a language whose id isn't held out, at most about ``per_language`` of each language."""
    ship(docs.sparkSession)
    learn = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    found = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(found)
    if not languages:
        return fit([], np.zeros(0, int), [])
    rate = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, per_language / n))])
    u = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / (1 << 30)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, weights = [], []
        for t in batch.column(1).to_pylist():
            c = counts(t)
            at = np.flatnonzero(c)
            rows.append(at.astype(np.int32))
            weights.append((c[at] / max(1, c.sum())).astype(np.float32))
        return pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["lang", "rows", "weights"])

    sample = map_batches(learn.where(u < rate[F.col("lang")]).where(F.length(F.trim("text")) > 0).select("lang", "text"), run, "lang string, rows array<int>, weights array<float>")
    got = sorted(((r["lang"], np.array(r["rows"], np.int64), np.array(r["weights"], np.float64)) for r in sample.toLocalIterator()), key=lambda r: (r[0], len(r[1]), r[1].tobytes()[:256]))
    at = {x: i for i, x in enumerate(languages)}
    return fit(languages, np.array([at[r[0]] for r in got], dtype=np.int64), [r[1:] for r in got], **options)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every text of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.score(t) for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == "und" or f[1] < model.reject_below for f in found], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text")), run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected. Texts make one trip through a worker, with a flag beside them; no join."""
    names = docs.columns
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                keep = [lang != "und" and s >= model.reject_below for lang, s in (model.score(t or "") for t in batch.column(at).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
