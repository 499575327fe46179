"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches. The trees are fitted on the driver on a bounded sample of
labelled rows, flattened into arrays (feature, cut, left child, value), and walked by whole batches at once: each step
of the walk moves every document one level down.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most, the smallest by hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Boosting: rounds, leaves' depth, learning rate, bins of a feature, least rows of a leaf, damping of leaf values.
ROUNDS, DEPTH, RATE, BINS, LEAST, DAMP = 80, 4, 0.15, 64, 20, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "distinct_pairs", "top_word", "top_pair", "same_neighbour",
    "upper", "digit", "space", "symbol", "pipe", "exclaim", "beyond_ascii", "sentence_end", "upper_words", "symbol_words", "end_symbol_words",
    "log_lines", "line_length", "distinct_lines", "distinct_chars", "entropy", "worst_block_distinct", "worst_block_upper", "worst_block_symbol",
]
#: Words of a block, of which the worst counts: a bad part of a long document stands out.
BLOCK = 100

_CLASS = np.zeros(256, np.int64)
for _name, _chars in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\n\r\x0b\x0c"), (4, b"#$%&*@^~<>{}[]\\_=+/`|"), (5, bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _name
_SYMBOL = re.compile(rb"[#$%&*@^~<>{}\[\]\\_=+/`|!]")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; a null text is an empty one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=6) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = raw.split(b"\n")
    p = counts[counts > 0] / len(raw)
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in words), bool, len(words))
    odd = np.fromiter((_SYMBOL.search(w) is not None for w in words), bool, len(words))
    blocks = [slice(at, at + BLOCK) for at in range(0, len(words), BLOCK) if at == 0 or len(words) - at >= BLOCK // 2]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), len(tally) / n, len(pairs) / n,
        max(tally.values(), default=0) / n, max(pairs.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        share[1], share[2], share[3], share[4], counts[124] / len(raw), counts[33] / len(raw), share[5], (counts[46] + counts[63]) / n,
        upper.sum() / n, odd.sum() / n, sum(1 for w in words if w[-1] in b"#$%&*!|") / n,
        np.log1p(len(lines)), np.log1p(len(raw) / len(lines)), len(set(lines)) / len(lines), (counts > 0).sum(), -(p * np.log2(p)).sum(),
        min((len(set(words[b])) / len(words[b]) for b in blocks), default=0.0), max((upper[b].mean() for b in blocks), default=0.0), max((odd[b].mean() for b in blocks), default=0.0),
    ]


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf is its own child. ``left`` holds the left child, the right one is next to it."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.roots):
            return total
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            inner = self.left[at] != at
            at = np.where(inner, self.left[at] + (x[rows, self.feature[at]] > self.cut[at]), at)
        return total + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Boost trees for the logistic loss; each split is the best over the histograms of all features.

    No rows give a score of 0.5; labels of one class give a constant score near that class.
    """
    y = np.asarray(y, np.float64)
    rate = (y.sum() + 1) / (len(y) + 2)
    roots, feature, cut, left, value = [], [], [], [], []
    base = float(np.log(rate / (1 - rate)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # x > cut[b] where bin > b
        offset = binned + np.arange(x.shape[1]) * BINS
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            roots.append(len(feature))
            left.append(roots[-1])
            feature.append(0)
            cut.append(0.0)
            value.append(0.0)
            level = [(roots[-1], np.arange(len(y)))]
            for depth in range(DEPTH + 1):
                below = []
                for node, rows in level:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    best = None
                    if depth < DEPTH and len(rows) >= 2 * LEAST:
                        flat = offset[rows].ravel()
                        size = x.shape[1] * BINS
                        sums = [np.bincount(flat, np.repeat(w[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1) for w in (g, h)]
                        many = np.bincount(flat, minlength=size).reshape(-1, BINS).cumsum(axis=1)
                        gain = sums[0] ** 2 / (sums[1] + DAMP) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + DAMP) - total_g**2 / (total_h + DAMP)
                        gain[(many < LEAST) | (len(rows) - many < LEAST)] = 0
                        f, b = np.unravel_index(gain.argmax(), gain.shape)
                        best = (int(f), int(b)) if gain[f, b] > 1e-6 and b < len(cuts[f]) else None
                    if best is None:
                        value[node] = RATE * total_g / (total_h + DAMP)
                        margin[rows] += value[node]
                        continue
                    f, b = best
                    feature[node], cut[node], left[node] = f, float(cuts[f][b]), len(feature)
                    for side in (False, True):
                        below.append((len(feature), rows[(binned[rows, f] > b) == side]))
                        left.append(len(feature))
                        feature.append(0)
                        cut.append(0.0)
                        value.append(0.0)
                level = below
    return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), base, DEPTH)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``sample_rows`` of them (the smallest hashes).

    Rows with a null id or label are no examples. The sample's ids, bounded by the parameter, are broadcast; texts stay
    where they are and only their statistics reach the driver.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = texts.select("doc_id", "text", "label").mapInArrow(each, "doc_id long, label int, x array<double>").orderBy("doc_id", "x").limit(sample_rows).toPandas()
    return fit(np.array(rows.x.tolist(), np.float64).reshape(-1, len(FEATURES)), rows.label.to_numpy(np.int64))


def score(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``; only the text counts. Null and empty texts are scored like any other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                x = np.array([statistics(t.as_py()) for t in part.column(1)], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, "doc_id long, score double")


def keep(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they were."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def scored(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(trees.score(x))

    return docs.where(scored(F.col(text).cast("string")) >= threshold)
