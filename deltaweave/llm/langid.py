"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to ``longest`` characters, A-Z and other capitals folded by a table) of every
training text into ``buckets`` per language; tasks add up dense rows, which are summed by language
and stripe of buckets. The matrix of log probabilities (languages x buckets, a fixed size per language)
goes to the tasks, and a slice of texts is scored by one gather and one segmented sum.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text where
nothing was learned; ties go to the language first in order; rows with a null doc_id or lang teach
nothing; repeated rows teach as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import bucketed, table
from .text import code_points, mix64, slices

BUCKETS, LONGEST, STRIPE = 1 << 15, 3, 1 << 12
SLICE = 1 << 20
_tables: list[np.ndarray] = []


def _folds() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point (where that is one), and whether it is a letter."""
    if not _tables:
        n = 0x110000
        lower, letter = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
        for p in range(n):
            c = chr(p)
            if c.isalpha():
                letter[p] = True
                small = c.lower()
                if len(small) == 1:
                    lower[p] = ord(small)
        _tables.extend((lower, letter))
    return _tables[0], _tables[1]


def ngrams(column: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram, offsets by text, and whether a text has a letter.

    Everything that is no letter is one symbol, and runs of it count once.
    """
    lower, letter = _folds()
    points, offsets = code_points(column)
    is_letter = letter[points]
    symbols = np.where(is_letter, lower[points], np.uint32(32)).astype(np.uint64)
    first = np.zeros(len(points), bool)
    first[offsets[:-1][offsets[:-1] < len(points)]] = True
    keep = is_letter | first
    keep[1:] |= is_letter[:-1]
    kept = np.concatenate(([0], np.cumsum(keep)))
    symbols, of = symbols[keep], kept[offsets]
    letters = np.concatenate(([0], np.cumsum(is_letter)))
    values = mix64(symbols + np.uint64(77))
    last = np.repeat(of[1:], np.diff(of))  # the end of its text, for each symbol
    here = np.arange(len(values))
    grams = np.zeros((len(values), longest), np.int64)
    rolled = values
    for size in range(1, longest + 1):
        if size > 1:
            rolled = mix64(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[size - 1 :])
        bucket = (rolled >> np.uint64(20)) % np.uint64(buckets)
        grams[: len(bucket), size - 1] = bucket.astype(np.int64) + 1
        grams[here + size > last, size - 1] = 0  # would reach into the next text
    flat = grams.reshape(-1)
    return flat, of * longest, letters[offsets[1:]] > letters[offsets[:-1]]


def learn(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """Languages and a matrix ((buckets + 1) x languages) from rows (text, lang): row 0 has the log
    priors, the others the log probabilities of the buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                grams, of, _ = ngrams(part.column(0), buckets, longest)
                langs = np.array(part.column(1).to_pylist(), object)
                per_gram = np.repeat(np.arange(part.num_rows), np.diff(of))
                for lang in dict.fromkeys(langs.tolist()):
                    own = langs == lang
                    row = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    row += np.bincount(grams[own[per_gram]], minlength=buckets + 1)
                    docs_of[lang] = docs_of.get(lang, 0) + int(own.sum())
        for lang, row in total.items():
            row[0] = docs_of[lang]  # bucket 0 stands for no n-gram; it carries the number of texts
            for at in range(0, buckets + 1, STRIPE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([at], pa.int32()), pa.array([row[at : at + STRIPE].astype("<i8").tobytes()], pa.binary())],
                    ["lang", "stripe", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, stripe, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(counts, "<i8")
                total[lang, stripe] = total[lang, stripe] + more if (lang, stripe) in total else more
        for (lang, stripe), counts in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([stripe], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["lang", "stripe", "counts"]
            )

    layout = "lang string, stripe int, counts binary"
    rows = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(count, layout)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: dict[str, np.ndarray] = {}
    for r in rows.repartition(n, "lang", "stripe").mapInArrow(add, layout).toLocalIterator():
        found.setdefault(r.lang, np.zeros(buckets + 1, np.int64))[r.stripe : r.stripe + STRIPE] = np.frombuffer(r.counts, "<i8")
    langs = sorted(found)
    matrix = np.zeros((buckets + 1, len(langs)), np.float64)
    for k, lang in enumerate(langs):
        row = found[lang].astype(float)
        texts, row[0] = row[0], 0
        matrix[1:, k] = np.log((row[1:] + 0.5) / (row.sum() + 0.5 * buckets))
        matrix[0, k] = np.log(texts)  # the prior, up to a constant
    return langs, matrix


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """All columns of ``docs`` given as doc_id, text, held_out -> doc_id, held_out, lang_pred, score."""
    buckets = len(matrix) - 1
    prior = matrix[0] if len(langs) else np.zeros(0)
    weights = matrix.astype(np.float32)
    weights[0] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                grams, of, has_letter = ngrams(part.column(1), buckets, longest)
                n = part.num_rows
                if langs:
                    logs = np.zeros((n, len(langs)))
                    for k in range(len(langs)):
                        total = np.concatenate(([0.0], np.cumsum(weights[grams, k], dtype=np.float64)))
                        logs[:, k] = total[of[1:]] - total[of[:-1]]
                    logs += prior
                    best = logs.argmax(axis=1)
                    score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    best, score, has_letter = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                best = np.where(has_letter, best, len(langs))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(has_letter, score, 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", bucketed(F.col("doc_id"), 4, 2).alias("held_out")
    )
    langs, matrix = learn(docs.where("not held_out and doc_id is not null"))
    return predict(docs, langs, matrix)
