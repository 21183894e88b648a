"""SentencePiece encoding and decoding by a batched Viterbi search.

`encode` gives each text the piece sequence with the highest summed score. The vocabulary is read
from a model file on the driver and travels to the tasks as arrays of a fixed size. Distinct chunks
of a batch are segmented once (see `lattice`), then laid out along the texts. `decode` joins the
bytes of the pieces; byte pieces spell what no piece holds, so every text comes back exactly.

The search is that of unigram models. For a model whose scores are merge ranks (BPE), `ranks=True`
turns the ranks into log probabilities by Zipf's law; the library's own merges may cut differently.

Defined results: null and empty texts have no pieces and decode to an empty text; a literal U+2581
is spelt by byte pieces; null ids, repeated rows and ties change nothing (ties of the search go to the
longer last piece); only the named columns are read. A run of any length without a space is searched whole, in windows: memory
grows by a few ten bytes a character of the longest text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .plan import table
from .text import code_points, slices

#: Where the vocabulary lies unless a caller says otherwise: a file, named by this variable of the driver's environment or the usual place.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20


def encode_column(column: pa.Array, v: lattice.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of all texts of a column, and offsets by text."""
    points, offsets = lattice.marked(*code_points(column))
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    starts = lattice.chunk_starts(points, offsets, v)
    ends = np.append(starts[1:], len(points))
    _, first, of = np.unique(lattice.chunk_hashes(points, starts, ends), return_index=True, return_inverse=True)
    flat, cuts = lattice.spell(*lattice.viterbi(points, starts[first], ends[first], v), v)
    ids, at = lattice.expand(flat, cuts, of)
    return ids, at[np.searchsorted(starts, offsets)]


class Decoder:
    """Bytes of all pieces in one array; texts are gathers over it."""

    def __init__(self, v: lattice.Vocabulary):
        self.data = np.frombuffer(b"".join(v.spelled), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in v.spelled])))

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        data, cuts = lattice.expand(self.data, self.offsets, ids)
        data = data.tobytes()
        at = cuts[offsets].tolist()
        return [data[a:b][1:] for a, b in zip(at[:-1], at[1:], strict=True)]  # without the mark in front


def vocabulary_of(model: str, ranks: bool) -> lattice.Vocabulary:
    """Read on the driver; ``ranks``: the file's scores are merge ranks, to be made log probabilities."""
    if not os.path.isfile(model):
        raise FileNotFoundError(f"no vocabulary file {model}: give its path as `model`, or in the environment as PIECE_MODEL")
    v = lattice.from_model(model)
    return lattice.zipf_scores(v) if ranks else v


def encode(docs: DataFrame, model: str = MODEL, ranks: bool = True) -> DataFrame:
    """doc_id and pieces (array of piece ids) of every text."""
    v = vocabulary_of(model, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, offsets = encode_column(part.column(1), v)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pieces array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, pieces); null pieces give an empty text."""
    v = vocabulary_of(model, ranks=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.array(x or (), np.int32) for x in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                texts = decoder.texts(np.concatenate(lists), offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"]
                )

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, model: str = MODEL, ranks: bool = True) -> DataFrame:
    """Per document: doc_id, n_pieces, digests of its pieces (little-endian int32) and of the decoded
    text, and whether that equals the text."""
    v = vocabulary_of(model, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, offsets = encode_column(part.column(1), v)
                raw, cuts = ids.astype("<i4").tobytes(), (offsets * 4).tolist()
                decoded = decoder.texts(ids, offsets)
                same = [(t or "").encode() == d for t, d in zip(part.column(1).to_pylist(), decoded, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                        pa.array(same),
                    ],
                    ["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean"
    )


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))
