"""Language-model scores by the likelihood of a subword lattice.

A token is a word or the end of a text. A document's probability is the sum over all segmentations of its
lattice, found by a forward recursion in log space; words begin pieces, so it is a product over tokens. The edges are

* the pieces of an existing vocabulary, weighed by its own scores, which are not fitted to the corpus (characters
  without a piece are spelt by byte pieces). All segmentations of a word w into pieces weigh L(w) together; over all words
  and the end, L sums to 1;
* one edge over each token that the training texts hold, weighed by its count c + 1: all that is learned.

With N training tokens, V of them distinct, the edges of known tokens share N + V of N + V + 1 parts, and the
pieces spell with the last part, that of the unknown: ``P(w) = ((c + 1 if c else 0) + L(w)) / (N + V + 1)``. So P sums to 1, and no known
token is less likely than by the add-one base, which gives the last part to each unknown token whole, however many
there are. ``lattice_score`` is the document's probability by the vocabulary alone.

1. Blocks of texts list their distinct words with counts; these are summed to one corpus table.
2. Every block asks for the counts of its distinct words by their hashes, gets them in one join,
   and scores its texts.

Defined results: null and empty texts are one end token; rows with a null ``doc_id`` are not learned
from; repeated rows count as often as they stand; without training texts N and V are 0; a word of any length is scored whole, in
memory of a few bytes a character.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .pieces import MODEL, vocabulary_of
from .plan import block_of, bucketed, cut, dealt_blocks, partitions, table
from .text import Words, code_points, slices, span_hashes, utf8

SLICE = 4 << 20
#: Share of ends among the draws of the vocabulary alone.
END = 1e-3


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with their counts; the empty word stands for the end of a text.

    Lists of one slice of texts each, to be summed by the caller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words = Words(part.column(0))
                _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                strings = [w.decode("utf-8", "replace") for w in words.strings(first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*strings, ""], pa.string()), pa.array([*n.tolist(), part.num_rows], pa.int64())], ["word", "n"]
                )

    return docs.select("text").mapInArrow(run, "word string, n long")


def _lattice_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points, offsets = lattice.marked(*code_points(column))
    return points, offsets[:-1], offsets[1:]


def lattice_model(model: str = MODEL) -> tuple[lattice.Vocabulary, float]:
    """The vocabulary with room for ends among its draws, and the log probability of an end as a token."""
    v = vocabulary_of(model, ranks=True)
    v = v.with_scores(v.scores + math.log1p(-END))
    opens = np.array([s.startswith(b" ") for s in v.spelled])
    # a word goes on until a piece opens the next or the text ends
    return v, math.log(END / (END + np.exp(v.scores[opens]).sum()))


def word_logs(words: list[bytes], v: lattice.Vocabulary) -> np.ndarray:
    """Natural log of L of each word."""
    column = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
    return lattice.marginals(*_lattice_words(column), v)


def lm_scores(docs: DataFrame, held_out, model: str = MODEL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every document.

    ``held_out``: a boolean column; the model learns from the rows where it is false and doc_id is set.
    """
    blocks = partitions(docs)
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), "text", held_out.alias("held_out"))
    learned = rows.where("not held_out and doc_id is not null")
    counts = cut(word_counts(learned).groupBy("word").agg(F.sum("n").alias("c")))
    n_all, n_distinct, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    n_all, ends = n_all or 0, ends or 0
    v, end_lattice = lattice_model(model)

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", SLICE):
                data, offsets = utf8(part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)), part.column(1)], ["h", "c"]
                )

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in np.unique(batch.column(0).to_numpy()).tolist():
                of_block = batch.filter(pa.compute.equal(batch.column(0), block))
                for part in slices(of_block, limit=SLICE):
                    found = np.unique(Words(part.column(2)).hashes())
                    own[block] = np.union1d(own[block], found) if block in own else found
        for block, found in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int32)), pa.array(found.view(np.int64))], ["block", "h"])

    dealt = dealt_blocks(rows, blocks, block_of(F.xxhash64("doc_id", "text"), blocks)).select("_block", "doc_id", "text", "held_out")
    by_hash = counts.where("word <> ''").mapInArrow(hash_words, "h long, c long")
    asked = dealt.mapInArrow(list_words, "block int, h long").join(by_hash, "h").select("block", "h", "c")
    parts = n_all + n_distinct + 1
    end_log = math.log10((ends + 1 if ends else 0) + math.exp(end_lattice)) - math.log10(parts)
    end_base = math.log10(ends + 1) - math.log10(parts)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        h, c = right.column("h").to_numpy().view(np.uint64), right.column("c").to_numpy()
        order = np.argsort(h)
        h, c = np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(c[order], 0)
        seen, logs = np.zeros(0, np.uint64), np.zeros(0)
        out = []
        for whole in left.to_batches():
            for part in slices(whole, limit=SLICE):
                words = Words(part.column(2))
                hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
                at = np.searchsorted(h, hashes)
                c_of = np.where(h[at] == hashes, c[at], 0)
                fresh = np.flatnonzero(~np.isin(hashes, seen, assume_unique=True))
                if len(fresh):
                    seen, logs = np.append(seen, hashes[fresh]), np.append(logs, word_logs(words.strings(first[fresh]), v))
                    by = np.argsort(seen)
                    seen, logs = seen[by], logs[by]
                by_lattice = logs[np.searchsorted(seen, hashes)] if len(seen) else np.zeros(0)
                with np.errstate(divide="ignore"):
                    by_all = np.logaddexp(np.log(np.where(c_of > 0, c_of + 1.0, 0.0)), by_lattice)
                total = [np.concatenate(([0], np.cumsum(x[inverse]))) for x in (
                    np.log10(c_of + 1.0) - math.log10(parts), by_all / math.log(10) - math.log10(parts), by_lattice / math.log(10), (c_of > 0).astype(np.int64)
                )]
                base, whole, alone, known = (t[words.of[1:]] - t[words.of[:-1]] for t in total)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            part.column(1),
                            part.column(3),
                            pa.array(words.counts() + 1, pa.int64()),
                            pa.array(known + (ends > 0), pa.int64()),
                            pa.array(np.full(part.num_rows, n_all), pa.int64()),
                            pa.array(base + end_base),
                            pa.array(whole + end_log),
                            pa.array(alone + end_lattice / math.log(10)),
                        ],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"],
                    )
                )
        return pa.Table.from_batches(out)

    return (
        dealt.groupBy("_block")
        .cogroup(asked.groupBy("block"))
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")
    )


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), bucketed(F.col("doc_id"), 7, 2))
