"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are cut into bins; one lookup table per feature is learned by cyclic boosting of
shallow trees (three leaves over one feature), then the pairs of features that explain most of what
is left get a table over two coarser binnings each. A score is the logistic of the summed entries, so
scoring is a few vectorised gathers per slice of texts.

The model is fitted on the driver, on at most ``sample`` labelled rows (a parameter; 40,000 unless
set): the first by a hash of their ids, labels and texts, however often an id or a label is repeated. All texts are scored.

Defined results: null and empty texts have all features 0 and get the score of that; rows without
labels or with a null doc_id teach nothing; labels other than 0 and 1 are ignored, repeated
labels of an id count each; without any labels, or with labels of one kind, all scores are the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import bucketed, table
from .text import Words, shingle_hashes, slices

SLICE = 1 << 20
SAMPLE = 40_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"*$&#%^~@=+<>{}[]\\_`")] = True
_KINDS = {
    "symbols": _SYMBOLS,
    "shouts": np.isin(np.arange(256), list(b"!?")),
    "bars": np.isin(np.arange(256), list(b"|")),
    "digits": np.isin(np.arange(256), list(b"0123456789")),
    "points": np.isin(np.arange(256), list(b".,;:")),
    "capitals": np.isin(np.arange(256), np.arange(65, 91)),
    "beyond ascii": np.arange(256) >= 128,
}
FEATURES = [
    "words", "word bytes", "longest word", "distinct words", "same as word before", "distinct shingles", "short words", "lines", "line bytes", *_KINDS,
]


def features(column: pa.Array, cased: Words | None = None) -> np.ndarray:
    """One row of FEATURES (float32) per text; ``cased`` are its words as they stand, if known already."""
    cased = Words(column, lower=False) if cased is None else cased
    raw, offsets, of = cased.data, cased.offsets, cased.of
    size = np.diff(offsets).astype(float)
    hashes = cased.hashes()
    n = np.diff(of).astype(float)
    some = np.maximum(n, 1)
    length = (cased.end - cased.start).astype(float)

    def total(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        summed = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        return summed[cuts[1:]] - summed[cuts[:-1]]

    def distinct(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        found = np.zeros(len(cuts) - 1)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                part = np.sort(values[a:b])
                found[k] = 1 + np.count_nonzero(part[1:] != part[:-1])
        return found

    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[of[:-1][of[:-1] < len(hashes)]] = False
    shingles, shingle_of = shingle_hashes(hashes, of, 4)
    longest = np.array([length[a:b].max() if b > a else 0 for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)])
    lines = total(raw == 10, offsets) + (size > 0)
    rows = [
        np.log1p(n), total(length, of) / some, np.log1p(longest), distinct(hashes, of) / some, total(same, of) / some,
        distinct(shingles, shingle_of) / np.maximum(np.diff(shingle_of), 1), total(length < 4, of) / some, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)),
    ]
    rows += [total(kind[raw], offsets) / np.maximum(size, 1) for kind in _KINDS.values()]
    return np.stack(rows, axis=1).astype(np.float32)


class AdditiveModel:
    """Tables over bins of single features and of pairs, summed into log odds."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, smooth: float = 8.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.smooth = bins, coarse, rounds, pair_rounds, pairs, rate, smooth
        self.intercept = 0.0
        self.edges: list[np.ndarray] = []
        self.coarse_edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    @staticmethod
    def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]

    def _leaves(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of up to three leaves over ordered bins with gradients g and curvatures h."""

        def best(lo: int, hi: int) -> tuple[float, int]:
            if hi - lo < 2:
                return 0.0, lo
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
            k = int(gain.argmax())
            return float(gain[k]), lo + k + 1

        _, first = best(0, len(g))
        cuts = [0, first, len(g)] if 0 < first < len(g) else [0, len(g)]
        options = [best(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        gain, second = max(options)
        if gain > 0:
            cuts = sorted({*cuts, second})
        out = np.zeros(len(g))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.smooth)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [self._cuts(x[:, k], self.bins) for k in range(x.shape[1])]
        self.coarse_edges = [self._cuts(x[:, k], self.coarse) for k in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        fine, rough = self._binned(x, self.edges), self._binned(x, self.coarse_edges)
        odds = np.full(len(y), self.intercept)
        slope = lambda: 1 / (1 + np.exp(-odds))
        for _ in range(self.rounds):
            for k, b in enumerate(fine):
                p = slope()
                m = len(self.tables[k])
                step = self.rate * self._leaves(np.bincount(b, y - p, m), np.bincount(b, p * (1 - p), m))
                self.tables[k] += step
                odds += step[b]
        p = slope()
        gains = []
        for i in range(len(rough)):
            for j in range(i):
                a, c = len(self.coarse_edges[i]) + 1, len(self.coarse_edges[j]) + 1
                cell = rough[i] * c + rough[j]
                g, h = np.bincount(cell, y - p, a * c), np.bincount(cell, p * (1 - p), a * c)
                gains.append((float((g**2 / (h + self.smooth)).sum()), i, j))
        chosen = [(i, j, np.zeros((len(self.coarse_edges[i]) + 1, len(self.coarse_edges[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, values in chosen:
                p = slope()
                a, c = values.shape
                cell = rough[i] * c + rough[j]
                g, h = np.bincount(cell, y - p, a * c).reshape(a, c), np.bincount(cell, p * (1 - p), a * c).reshape(a, c)
                step = self._quarters(g, h) * self.rate
                values += step
                odds += step.reshape(-1)[cell]
        self.pairs = chosen
        return self

    def _quarters(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of four leaves: the best cut of each of the two features, crossed."""

        def corner(m: np.ndarray) -> np.ndarray:
            return np.cumsum(np.cumsum(m, 0), 1)

        cg, ch = corner(g), corner(h)
        a, c = g.shape
        if a < 2 or c < 2:
            return np.zeros_like(g)
        ul, uh = cg[:-1, :-1], ch[:-1, :-1]
        tg, th = cg[:-1, -1:], ch[:-1, -1:]
        lg, lh = cg[-1:, :-1], ch[-1:, :-1]
        parts = [(ul, uh), (tg - ul, th - uh), (lg - ul, lh - uh), (cg[-1, -1] - tg - lg + ul, ch[-1, -1] - th - lh + uh)]
        gain = sum(p**2 / (q + self.smooth) for p, q in parts)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        leaf = [p[i, j] / (q[i, j] + self.smooth) for p, q in parts]
        out = np.empty_like(g)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.intercept)
        if self.tables:
            for values, b in zip(self.tables, self._binned(x, self.edges), strict=True):
                odds += values[b]
            rough = self._binned(x, self.coarse_edges)
            for i, j, values in self.pairs:
                odds += values[rough[i], rough[j]]
        return 1 / (1 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """A model of label 1 from documents and rows (doc_id, label), on ``sample`` of these at most.

    The sampled labels, bounded by the parameter, are broadcast; only their texts are read for features.
    """
    usable = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("double").alias("label"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                x = features(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2), part.column(3)], ["doc_id", "features", "label", "h"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(usable), "doc_id").select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    # documents that repeat an id add rows again, so the bound is drawn once more
    found = rows.mapInArrow(run, "doc_id long, features array<float>, label double, h long").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "h").limit(sample).toArrow()
    x = np.array(found.column("features").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = found.column("label").to_numpy()
    order = np.lexsort((found.column("h").to_numpy(), y, found.column("doc_id").to_numpy()))  # whatever order the tasks came in
    return AdditiveModel().fit(x[order], y[order])


def scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(part.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_scored(docs: DataFrame, model: AdditiveModel, threshold: float) -> DataFrame:
    """The documents with a score of at least ``threshold``; same columns, one pass, no join."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield part.filter(pa.array(model.score(features(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, label) that may be learned from."""
    return (
        table(spark, sf_dir, "labels")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
        .where(~bucketed(F.col("doc_id"), 5, 0))
    )


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(spark, sf_dir))
    return scores(docs, model).select(
        "doc_id", bucketed(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
