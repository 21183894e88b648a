"""Exact line dedup with levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased. A key of at
least ``least`` code points that stands in two documents or more stays only in the smallest doc_id.

1. Texts are dealt into blocks by a hash of doc_id. Each block lists its distinct keys (128-bit
   hashes), each once, with the smallest doc_id that has it there: a key's rows are at most as many
   as there are blocks, however common it is.
2. The lists are dealt by key and sorted by doc_id. A task walks them batch by batch: a batch is
   merge-anti-joined with the levelled runs (`Runs`) of all earlier keys, and what is new becomes a
   run itself; full levels are compacted into the next. A key that the runs hold already belongs to an
   earlier document, and its block is told so.
3. Blocks meet the keys they do not own and drop their lines, and later repeats within the block.

Defined results: a null or empty text is one empty line; a row with a null ``doc_id`` neither owns
nor loses lines; rows with the same doc_id count as one document; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import block_of, dealt_blocks, partitions, table
from .text import Lines, slices

KEY = np.dtype([("hi", np.uint64), ("lo", np.uint64)])
#: Lines that a block gathers before it drops its repeats.
GATHERED = 1 << 20


class Runs:
    """Sorted runs of keys in levels; ``fanout`` runs of a level are compacted into one of the next.

    Keys are pairs of uint64; each run is kept sorted by (hi, lo).
    """

    def __init__(self, fanout: int = 8):
        self.fanout = fanout
        self.levels: list[list[np.ndarray]] = []

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted ``keys`` stand in some run."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            for run in level:
                todo = np.flatnonzero(~found)
                if not len(todo):
                    return found
                found[todo] = _member(run, keys[todo])
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add a sorted run of keys that no run holds."""
        if not len(keys):
            return
        at = 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(keys)
            if len(self.levels[at]) < self.fanout:
                return
            keys = np.concatenate(self.levels[at])
            keys = keys[np.lexsort((keys["lo"], keys["hi"]))]
            self.levels[at] = []
            at += 1


def _member(run: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Merge step: for sorted ``keys``, whether each stands in the sorted ``run``."""
    hi, lo = run["hi"], run["lo"]
    begin = np.searchsorted(hi, keys["hi"], side="left")
    end = np.searchsorted(hi, keys["hi"], side="right")
    found = np.zeros(len(keys), bool)
    for at in np.flatnonzero(end > begin).tolist():  # nearly always one candidate
        found[at] = bool((lo[begin[at] : end[at]] == keys["lo"][at]).any())
    return found


def _keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = np.empty(len(hi), KEY)
    out["hi"], out["lo"] = hi.view(np.uint64), lo.view(np.uint64)
    return out


def _groups(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by key and doc, and where in it each key begins."""
    order = np.lexsort((docs, keys["lo"], keys["hi"]))
    ordered = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, new


def _keyed_lines(part: pa.RecordBatch, text: int, doc: int, least: int) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a slice; the index, key and document of those that have a key and a document."""
    lines = Lines(part.column(text), least)
    column = part.column(doc)
    of_line = np.repeat(np.arange(part.num_rows), np.diff(lines.of))[lines.keyed]
    known = np.array(column.is_valid())[of_line]
    docs = np.array(column.fill_null(0), np.int64)[of_line[known]]
    return lines, lines.keyed[known], _keys(lines.hi[known], lines.lo[known]), docs


def _list_keys(least: int):
    """Per block, each key with the smallest doc_id that has it there."""

    def once(keys: list[np.ndarray], docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        k, d = np.concatenate(keys), np.concatenate(docs)
        order, new = _groups(k, d)
        return [k[order[new]]], [d[order[new]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[list[np.ndarray], list[np.ndarray], list[int]]] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks).tolist():
                for part in slices(batch.filter(pa.array(blocks == block)), "_text"):
                    _, _, keys, docs = _keyed_lines(part, 2, 1, least)
                    gathered = own.setdefault(block, ([np.zeros(0, KEY)], [np.zeros(0, np.int64)], [GATHERED]))
                    gathered[0].append(keys)
                    gathered[1].append(docs)
                    if sum(map(len, gathered[1])) > gathered[2][0]:
                        k, d = once(*gathered[:2])
                        own[block] = (k, d, [2 * len(d[0]) + GATHERED])
        for block, gathered in own.items():
            (keys,), (docs,) = once(*gathered[:2])
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), block, np.int32)), pa.array(k["hi"].view(np.int64)), pa.array(k["lo"].view(np.int64)), pa.array(docs[at : at + 100_000])],
                    ["block", "hi", "lo", "doc_id"],
                )

    return run


def _walk(fanout: int):
    """Rows (block, hi, lo, doc_id) sorted by doc_id -> (block, hi, lo) where an earlier document owns the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(fanout)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            order, new = _groups(keys, np.arange(len(keys)))  # within a key as they came: by doc_id
            heads = keys[order[new]]
            known = runs.known(heads)
            runs.add(heads[~known])
            later = ~new | known[np.cumsum(new) - 1]
            hit = pa.array(np.sort(order[later]))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(hit) for k in range(3)], ["block", "hi", "lo"])

    return run


def _rewrite(least: int):
    """One block's texts and the keys that it does not own -> each text without its lost lines."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        foreign = _keys(*(right.column(c).to_numpy() for c in ("hi", "lo")))
        foreign = foreign[np.lexsort((foreign["lo"], foreign["hi"]))]
        parts, lines, index, keys, docs = [], [], [], [np.zeros(0, KEY)], [np.zeros(0, np.int64)]
        for whole in left.to_batches():
            for part in slices(whole, "_text"):
                of_part = _keyed_lines(part, 2, 1, least)
                parts.append(part)
                for gathered, x in zip((lines, index, keys, docs), of_part, strict=True):
                    gathered.append(x)
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order, new = _groups(keys, docs)
        group = np.cumsum(new) - 1
        lost = np.zeros(len(keys), bool)
        lost[order] = _member(foreign, keys[order[new]])[group] | (docs[order] != docs[order[new]][group])
        out, at = [], 0
        for part, own, keyed in zip(parts, lines, index, strict=True):
            gone = np.zeros(len(own.begin), bool)
            gone[keyed] = lost[at : at + len(keyed)]
            at += len(keyed)
            before = np.concatenate(([0], np.cumsum(gone)))
            n_lost = before[own.of[1:]] - before[own.of[:-1]]
            data, cuts = own.data.tobytes(), own.offsets.tolist()
            kept = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for k in np.flatnonzero(n_lost).tolist():
                stay = own.of[k] + np.flatnonzero(~gone[own.of[k] : own.of[k + 1]])
                kept[k] = b"\n".join([data[a:b] for a, b in zip(own.begin[stay].tolist(), own.end[stay].tolist(), strict=True)])
            out.append(
                pa.table(
                    {
                        "_row": part.column(3),
                        "n_lines": pa.array(np.diff(own.of), pa.int64()),
                        "n_dropped": pa.array(n_lost, pa.int64()),
                        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                    }
                )
            )
        if not out:
            out.append(pa.table({"_row": left.column("_row"), "n_lines": pa.array([], pa.int64()), "n_dropped": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())}))
        return pa.concat_tables(out)

    return run


def dedup_lines(docs: DataFrame, least: int = 10, fanout: int = 8) -> DataFrame:
    """``row`` (a struct of all columns but text), n_lines, n_dropped and kept_text per document."""
    blocks = partitions(docs)
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("_doc"), F.col("text").alias("_text"), row.alias("_row"))
    dealt = dealt_blocks(rows, blocks, block_of(F.coalesce("_doc", F.xxhash64("_text")), blocks)).select("_block", "_doc", "_text", "_row")
    keys = dealt.mapInArrow(_list_keys(least), "block int, hi long, lo long, doc_id long")  # all columns go in: both uses share one exchange
    foreign = (
        keys.repartition(blocks, "hi", "lo").sortWithinPartitions("doc_id").mapInArrow(_walk(fanout), "block int, hi long, lo long")
    )
    out = f"_row {docs.select(row.alias('r')).schema['r'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string"
    return dealt.groupBy("_block").cogroup(foreign.groupBy("block")).applyInArrow(_rewrite(least), out)


def without_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """The documents with their texts rewritten (and n_chars, where there is one); same columns."""
    done = dedup_lines(docs, least)
    new = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return done.select(*[new.get(c, F.col("_row").getField(c).alias(c)) for c in docs.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
