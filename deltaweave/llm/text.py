"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on one slice of an Arrow batch at a time: the UTF-8 bytes of all its texts
in one ``uint8`` array plus offsets. White space and A-Z are single bytes in UTF-8, so words can be
cut and lower-cased without decoding. Slices are bounded by bytes, so memory is bounded by the
slice size (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes that are hashed at a time.
WINDOW = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False

_BASE = 0x9E3779B97F4A7C15  # odd, 5 mod 8: of full multiplicative order modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE, _BYTE_TOO = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240607, 20240611))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the length of a window."""

    def series(base: int) -> np.ndarray:
        out = np.full(WINDOW + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return series(_BASE), series(_BASE_INVERSE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    begin, rows = 0, batch.num_rows
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(rows, max(begin + 1, end), begin + 20_000)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice, A-Z lower-cased.

    ``data``: lower-cased bytes; ``start``, ``end``: byte positions of each word;
    ``of``: offsets into the words, one more than there are texts.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        raw, offsets = utf8(column)
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        solid = _SOLID[raw]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[(offsets - 1)[offsets > 0]] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over byte values, mixed."""
        return span_hashes(self.data, self.start, self.end)

    def strings(self, index: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.start[index].tolist(), self.end[index].tolist(), strict=True)]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of byte spans, in order and apart, equal for equal bytes wherever they stand.

    Spans go through windows, and a longer one through several, so memory does not grow with a text.
    """
    up, down = _powers()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i, int(np.searchsorted(end, base + WINDOW, side="right")))
        if j > i:
            piece = data[base : int(end[j - 1])]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values[piece] * up[: len(piece)], out=total[1:])
            out[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base]
            i = j
        else:
            whole, shift = 0, 1
            for at in range(base, int(end[i]), WINDOW):
                piece = data[at : min(at + WINDOW, int(end[i]))]
                whole += int((values[piece] * up[: len(piece)]).sum()) * shift
                shift = shift * int(up[WINDOW]) & 0xFFFFFFFFFFFFFFFF
            out[i] = whole & 0xFFFFFFFFFFFFFFFF
            i += 1
    out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out)


def shingle_hashes(words: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words inside a text, and offsets by text.

    A text of fewer words gives one hash of its whole sequence; a text without words none.
    """
    counts = np.diff(of)
    n = len(words)
    mul = np.uint64(0xC2B2AE3D27D4EB4F)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * mul + words[k : k + len(rolled)]
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    offsets = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    full = counts >= width
    at = np.repeat(of[:-1] - offsets[:-1], many) + np.arange(offsets[-1])
    long = np.repeat(full, many)
    out[long] = rolled[at[long]]
    for t in np.flatnonzero(~full & (counts > 0)):
        value = int(counts[t]) * 0x9E3779B1
        for w in words[of[t] : of[t + 1]].tolist():
            value = (value * int(mul) + w) & 0xFFFFFFFFFFFFFFFF
        out[offsets[t]] = value
    return mix64(out), offsets


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(column)
    hashes, offsets = shingle_hashes(words.hashes(), words.of, width)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = np.sort(hashes[a:b])
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part)
    return out


class Lines:
    """The lines of a slice of texts, split at newlines; a null or empty text is one empty line.

    ``begin``, ``end``: byte positions of each line; ``of``: offsets into the lines by text; ``keyed``: lines that have
    a key, which is the line without blanks at both ends and with A-Z lower-cased, of ``least`` code points or more;
    ``hi``, ``lo``: a 128-bit hash of the key of each of these.
    """

    def __init__(self, column: pa.Array, least: int):
        self.data, self.offsets = utf8(column)
        raw = self.data
        newlines = np.flatnonzero(raw == 10)
        self.begin = np.sort(np.concatenate((self.offsets[:-1], newlines + 1)), kind="stable")
        self.end = np.sort(np.concatenate((newlines, self.offsets[1:])), kind="stable")
        self.of = np.arange(len(self.offsets)) + np.searchsorted(newlines, self.offsets)
        start, stop = _stripped(raw, self.begin, self.end)
        size = stop - start
        enough = size >= 4 * least  # a code point has four bytes at most
        unsure = np.flatnonzero((size >= least) & ~enough)
        if len(unsure) and not (raw >= 0x80).any():
            enough[unsure] = True
        elif len(unsure):
            reach = np.arange(4 * least)
            at = np.minimum(start[unsure][:, None] + reach, len(raw) - 1)
            enough[unsure] = (((raw[at] & 0xC0) != 0x80) & (reach < size[unsure][:, None])).sum(axis=1) >= least
        self.keyed = np.flatnonzero(enough & (size > 0))
        small = _LOWER[raw]
        start, stop = start[self.keyed], stop[self.keyed]
        self.hi, self.lo = span_hashes(small, start, stop), span_hashes(small, start, stop, _BYTE_TOO)


def _stripped(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without blanks at both ends."""
    start, stop = begin.copy(), end.copy()
    for at, other, shift, step in ((start, stop, 0, 1), (stop, start, -1, -1)):
        live = np.flatnonzero(start < stop)
        for _ in range(64):
            live = live[~_SOLID[raw[at[live] + shift]]]
            if not len(live):
                break
            at[live] += step
            live = live[start[live] < stop[live]]
        for k in live.tolist():  # very long runs of blanks
            line = raw[start[k] : stop[k]].tobytes()
            at[k] += step * (len(line) - len(line.lstrip(b" \t\n\x0b\x0c\r") if step > 0 else line.rstrip(b" \t\n\x0b\x0c\r")))
    return start, stop


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points (uint32) of a slice and offsets by text; null texts count as empty."""
    data, offsets = utf8(column)
    if not (data >= 0x80).any():
        return data.astype(np.uint32), offsets
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return points, before[offsets]
