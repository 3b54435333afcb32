"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of a text: shares of kinds of characters, lengths and repetition of words and lines. Trees are
grown on 64-bin histograms of a bounded sample of labelled texts (``SAMPLE`` at most, about, by hash at a rate from
the exact count), level by level, by the second-order gain of the logistic loss. A forest is kept as flat arrays
of complete binary trees: node i's children are 2i + 1 and 2i + 2, so a batch of texts walks all trees
at once, a level per numpy operation. Scoring is one narrow pass, no shuffle.

Cases: a null or empty text has all statistics 0 and gets the score of those; labels that are null or not 0
or 1 teach nothing, a text labelled both ways counts as both; without labels every score is 0.5; rows
repeated stay repeated; a null doc_id counts as held out and never teaches; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import held_out, map_batches, text_of

SAMPLE, TREES, DEPTH, BINS, RATE, SEED, CUT = 20_000, 60, 4, 64, 0.15, 42, 0.3

_KINDS = np.full(256, 5)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-")):
    _KINDS[list(_set)] = _i
_KINDS[128:] = 6
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "stop", "symbol", "high", "log_words", "word_length", "long_words", "distinct_words", "top_word", "upper_words", "same_next",
    "alpha_words", "no_letter_words", "distinct_three", "log_lines", "distinct_lines", "line_length", "end_marked", "capital_words", "exclaimed", "distinct_bytes",
)


def statistics(text: str) -> list[float]:
    """The features of a text, all of it, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, per_byte, 7) / len(raw)
    words = text.split()
    n = len(words) or 1
    many = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(lines) or 1
    threes = set(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else ()
    return [
        np.log1p(len(raw)), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], np.log1p(len(words)), (len(text) - kinds[3] * len(raw)) / n, sum([len(w) > 14 for w in many]) / max(1, len(many)),
        len(many) / n, max(many.values(), default=0) / n, sum(c for w, c in many.items() if len(w) > 1 and w.isupper()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(c for w, c in many.items() if w.isalpha()) / n, sum(c for w, c in many.items() if w.lower() == w.upper()) / n, len(threes) / max(1, n - 2), np.log1p(len(lines)), len(set(lines)) / m, sum(map(len, lines)) / m / 100, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / m,
        sum(c for w, c in many.items() if w[0].isupper()) / n, text.count("!") / n, float((per_byte > 0).sum()) / 256,
    ]


@dataclass
class Forest:
    """Complete trees as arrays (trees x nodes); a leaf before the last level passes everything left (threshold infinity)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        tree = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH if len(self.feature) else 0):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        inner = (1 << DEPTH) - 1
        return self.base + (self.value[tree, at - inner].sum(axis=1) if len(self.feature) else np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, least: int = 8, ridge: float = 1.0) -> Forest:
    """Boost complete trees of DEPTH levels on histograms; ties take the first feature and the lowest threshold."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, f = x.shape
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(f) * BINS
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            low, width = (1 << level) - 1, 1 << level
            key = ((node - low)[:, None] * (f * BINS) + flat).ravel()
            shape = (width, f, BINS)
            gs, hs, cs = (np.bincount(key, np.repeat(v, f), width * f * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n)))
            gt, ht, ct = gs[..., -1:], hs[..., -1:], cs[..., -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain = np.where((cs >= least) & (ct - cs >= least), gain, -1.0)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1.0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                if gain.reshape(width, -1)[k, best[k]] > 1e-6:
                    feature[low + k] = best[k] // BINS
                    threshold[low + k] = edges[best[k] // BINS][best[k] % BINS]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(values))


def describe(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and ``stats`` (array<double>, FEATURES) of every text of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns[:-1], pa.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))], names=[*keep, "stats"])

    rows = docs.select(*keep, text_of().alias("_gl_text"))
    return map_batches(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", stats array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Learn ``quality`` from labelled texts whose id isn't held out, about ``sample`` of them at most."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("bigint").alias("_gl_id"), F.col("quality").cast("int").alias("quality"))
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "_gl_id"), F.lit(1 << 30)) / (1 << 30) < min(1.0, sample / max(1, n)))
    # The chosen labels are bounded by the sample; texts that aren't chosen are never described.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_gl_id"), "text").join(F.broadcast(chosen), "_gl_id")
    got = [(r["quality"], r["stats"]) for r in describe(texts, "quality").toLocalIterator()]
    got.sort()
    return grow(np.array([s for _, s in got]), np.array([q for q, _ in got], dtype=float))


def score(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every text of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = forest.score(np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES)))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text")), run, "doc_id bigint, held_out boolean, score double, predicted int")
