"""Document fingerprints by consistent weighted sampling.

A text is a bag of words (A-Z lower-cased) weighted by their counts. For every word and sample k,
r and c are drawn from Gamma(2, 1) and b from [0, 1) by hashing; with weight w,
``t = floor(ln w / r + b)`` and ``a = c / exp(r * (t - b) + r)``; the word with the smallest a gives
the sample (word, t). Two texts agree in a sample with a probability that equals their generalised
Jaccard similarity, sum of least by sum of largest weights. A fingerprint holds 16 bits per sample.

All texts of a slice are sampled together: draws are made once per distinct word, and each sample
is one gather and one segmented minimum.

Neighbours by doc_id: rows are dealt by one range exchange on doc_id (then a hash of the text, then the place read, so
null ids and repeats of one id spread over several tasks), and walked in order. A task settles all pairs within it and leaves its
first and its last document; these are matched afterwards by the number of the task, so every text is moved once, and
what is ordered in one place is one integer per task.

Defined results: null and empty texts have the fingerprint of no words, all zeros; null ids come first
in order; rows of the same id are ordered by a hash of the text; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plan import cut, partitions, table
from .text import Words, mix64, slices

SAMPLES = 128
SLICE_CHARS = 1_500_000


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper 23 of 32 bits: more would round to 1."""
    return ((bits >> np.uint32(9)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


def _pairs(words: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(words ^ np.uint64(salt))
    return (x >> np.uint64(32)).astype(np.uint32), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _salts(samples: int) -> np.ndarray:
    return np.random.default_rng(65537).integers(1, 1 << 63, (samples, 3), dtype=np.uint64)


def sample_words(words: np.ndarray, of: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Signatures (texts x samples, uint16) of bags: hashes of words and their weights, ragged by ``of``."""
    n = len(of) - 1
    out = np.zeros((n, samples), np.uint16)
    full = np.flatnonzero(np.diff(of) > 0)
    if not len(full):
        return out
    # each pair of a word and a weight once, each word once
    _, first, place = np.unique(mix64(words + weights.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True)
    pair_words = words[first]
    distinct, word_of = np.unique(pair_words, return_inverse=True)
    log_weight = np.log(weights[first].astype(np.float32))
    starts = of[:-1][full]
    for k, salt in enumerate(_salts(samples).tolist()):
        u1, u2 = _pairs(distinct, salt[0])
        u3, u4 = _pairs(distinct, salt[1])
        u5, _ = _pairs(distinct, salt[2])
        r = -np.log(_uniform(u1) * _uniform(u2))
        log_c = np.log(-np.log(_uniform(u3) * _uniform(u4)))
        r, log_c, b = r[word_of], log_c[word_of], _uniform(u5)[word_of]
        t = np.floor(log_weight / r + b)
        a = (log_c - r * (t - b) - r).astype(np.float32).view(np.uint32)
        a = np.where(a >> np.uint32(31), ~a, a | np.uint32(0x80000000))  # ordered as the floats are
        code = mix64(pair_words + (t.astype(np.int64).view(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        key = (a.astype(np.uint64) << np.uint64(32)) | code
        least = np.minimum.reduceat(key[place], starts)
        out[full, k] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def fingerprints(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text."""
    words = Words(pa.array(texts, pa.large_string()))
    hashes = words.hashes()
    parts, counts, of = [], [], [0]
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
        found, n = np.unique(hashes[a:b], return_counts=True)
        parts.append(found)
        counts.append(n)
        of.append(of[-1] + len(found))
    return sample_words(np.concatenate(parts), np.array(of), np.concatenate(counts), samples) if texts else np.zeros((0, samples), np.uint16)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    layout = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def settled(ids: list, own: list[str], after: list[str], prints_of: list[str], at_own: slice, at_after: slice) -> list[pa.Array]:
        changed = [edited(a, b) for a, b in zip(own, after, strict=True)]
        prints = fingerprints([*prints_of, *changed], samples)
        mine, following, of_changed = prints[at_own], prints[at_after], prints[len(prints_of) :]
        columns = [
            ids,
            [len(x) for x in own],
            [hashlib.sha256(x.encode()).hexdigest() for x in changed],
            [x.astype(">u2").tobytes() for x in mine],
            [x.astype(">u2").tobytes() for x in of_changed],
            (mine == of_changed).mean(axis=1),
            (mine == following).mean(axis=1),
        ]
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents in order: results of all but the last (kind 0), and the first (1) and last (2) themselves."""
        task = TaskContext.get().partitionId()

        def rows(kind: int, columns: list[pa.Array], texts: list[str] | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            columns = columns + [pa.nulls(n, k) for k in kinds[len(columns) :]]
            ends = [pa.array([kind] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *ends], [*names, "kind", "task", "text"])

        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch, limit=SLICE_CHARS):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                if not held:
                    yield rows(1, [pa.array(ids[:1], pa.int64())], texts[:1])
                else:
                    ids, texts = [held[0][0], *ids], [held[0][1], *texts]
                held = [(ids[-1], texts[-1])]
                if len(texts) > 1:
                    yield rows(0, settled(ids[:-1], texts[:-1], texts[1:], texts, slice(0, len(texts) - 1), slice(1, len(texts))))
        if held:
            yield rows(2, [pa.array([held[0][0]], pa.int64())], [held[0][1]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_CHARS):
                ids, own, after = (part.column(k).to_pylist() for k in range(3))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(settled(ids, own, after, [*own, *after], slice(0, n), slice(n, 2 * n)), names)

    n = partitions(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("_h"),
        F.monotonically_increasing_id().alias("_nth"),
    )
    order = ["doc_id", "_h", "_nth"]
    walked = cut(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(walk, f"{layout}, kind int, task int, text string")
    )
    firsts = walked.where("kind = 1").select(F.col("task").alias("next"), F.col("text").alias("after"))
    lasts = walked.where("kind = 2").select("task", "doc_id", "text")
    by_task, everything = Window.orderBy("task"), Window.partitionBy()
    following = (
        lasts.select("task").withColumn("next", F.coalesce(F.lead("task").over(by_task), F.min("task").over(everything)))  # one integer per task
    )
    last = lasts.join(following, "task").join(firsts, "next").select("doc_id", "text", "after").mapInArrow(pairs, layout)
    hexed = [F.lower(F.hex(c)).alias(c) if c.endswith("fingerprint") else F.col(c) for c in names]
    return walked.where("kind = 0").select(*names).unionByName(last).select(*hexed)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
