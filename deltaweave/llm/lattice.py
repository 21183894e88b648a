"""Segmentation lattices over a subword vocabulary, for many words at once.

A text is a sequence of code points: a word-start mark (U+2581) stands in front and for every
space. It falls into chunks that no piece crosses; equal chunks are solved once, and chunks of
equal length advance together: for every length the hashes of all substrings are probed in the
sorted keys of the pieces, and one recursion over positions serves the whole group.

Long chunks go through windows of positions: of what lies behind only the last scores stay, and one backpointer a
position (the length of its best last piece). A chunk that is alone in its group steps through the pieces found one by
one, without arrays of one row.

A character that is no piece of its own is spelt by byte pieces, as is a literal U+2581, so
decoding gives every text back.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .text import mix64

MARK, LITERAL_MARK, NEWLINE = 0x2581, 0x110001, 10
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BITS = np.uint64(44)
#: Cells (words x positions) that are solved at a time: a group of words, or a window of one long word.
CELLS = 1 << 17
#: Chunks of more code points are not compared with others.
LONG = 4096
#: Code points that are hashed at a time, no fewer than those of a chunk that is compared.
HASHED = 1 << 16


def _values(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(0x51ED270B))


@dataclass
class Vocabulary:
    """Pieces sorted by the hash of their code points, with a score (a log weight) each."""

    keys: np.ndarray  # sorted uint64
    ids: np.ndarray  # piece id of each key
    scores: np.ndarray  # float64 by piece id; -inf for pieces that no text can use
    longest: int
    byte_ids: np.ndarray  # piece id of each byte value
    spelled: list[bytes]  # UTF-8 by piece id, marks as spaces; a byte piece is its byte
    unknown_score: float
    crosses: bool  # whether a piece has a mark behind another character
    newline_alone: bool  # whether no piece holds a newline

    def __post_init__(self):
        self.present = np.zeros(1 << 20, bool)
        self.present[self.keys >> _BITS] = True

    def with_scores(self, scores: np.ndarray, unknown_score: float | None = None) -> Vocabulary:
        u = self.unknown_score if unknown_score is None else unknown_score
        return Vocabulary(self.keys, self.ids, scores, self.longest, self.byte_ids, self.spelled, u, self.crosses, self.newline_alone)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat positions in ``hashes`` that are pieces, and their ids."""
        flat = hashes.reshape(-1)
        maybe = np.flatnonzero(self.present[flat >> _BITS])
        wanted = flat[maybe]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == wanted
        return maybe[hit], self.ids[at[hit]]


def vocabulary(pieces: list[str], scores: list[float], byte_ids: np.ndarray, usable: list[bool]) -> Vocabulary:
    """From piece texts and scores; ``usable`` leaves out control, unknown and byte pieces."""
    keys, ids, longest, crosses, newline_alone = [], [], 1, False, True
    for i, (piece, ok) in enumerate(zip(pieces, usable, strict=True)):
        if not ok or not piece:
            continue
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for v in _values(np.array([ord(c) for c in piece], np.uint32)):
                h = h * _BASE + v
        keys.append(h)
        ids.append(i)
        longest = max(longest, len(piece))
        crosses |= "▁" in piece.lstrip("▁")
        newline_alone &= "\n" not in piece
    keys = np.array(keys, np.uint64)
    order = np.argsort(keys, kind="stable")
    spelled = [p.replace("▁", " ").encode() for p in pieces]
    for value, i in enumerate(byte_ids.tolist()):
        spelled[i] = bytes([value])
    weights = np.array(scores, np.float64)
    least = min(weights[i] for i in ids)
    return Vocabulary(keys[order], np.array(ids, np.int32)[order], weights, longest, byte_ids, spelled, least - 10.0, crosses, newline_alone)


def from_model(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    return vocabulary([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], byte_ids, usable)


def zipf_scores(v: Vocabulary) -> Vocabulary:
    """Scores that are ranks (of merges: 0, -1, -2, ...) made log probabilities, by Zipf's law.

    Vocabularies whose scores are log probabilities already need no such step.
    """
    ranks = -v.scores[v.ids]
    logs = np.full(len(v.scores), -np.inf)
    weights = -np.log(ranks - ranks.min() + 2.7)
    weights -= np.log(np.exp(weights).sum() + 256 * np.exp(weights.min() - 2.0))
    logs[v.ids] = weights
    logs[v.byte_ids] = weights.min() - 2.0
    return v.with_scores(logs, float(weights.min() - 10.0))


def marked(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a mark in front of each non-empty text and for each space; new offsets."""
    full = np.diff(offsets) > 0
    inner = points.copy()
    inner[points == MARK] = LITERAL_MARK
    inner[points == 0x20] = MARK
    return np.insert(inner, offsets[:-1][full], np.uint32(MARK)), offsets + np.concatenate(([0], np.cumsum(full)))


def chunk_starts(points: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Where chunks begin: pieces never cross these places."""
    begin = np.zeros(len(points), bool)
    begin[offsets[:-1][offsets[:-1] < len(points)]] = True
    if not v.crosses:
        mark = points == MARK
        begin[1:] |= mark[1:] & ~mark[:-1]
    if v.newline_alone:
        line = np.flatnonzero(points == NEWLINE)
        begin[line] = True
        begin[line[line + 1 < len(points)] + 1] = True
    return np.flatnonzero(begin)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the length of a window of hashes."""
    up = np.full(HASHED, _BASE, np.uint64)
    down = np.full(HASHED, pow(int(_BASE), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def chunk_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per chunk (chunks follow each other without gaps); chunks above ``LONG`` get a number each."""
    lengths = ends - starts
    long = lengths > LONG
    if long.any():
        out = mix64(np.arange(len(starts), dtype=np.uint64) + np.uint64(1 << 62))
        begin = np.concatenate(([0], np.cumsum(lengths[~long])))
        out[~long] = chunk_hashes(points[np.repeat(~long, lengths)], begin[:-1], begin[1:])
        return out
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # windows of whole chunks, so memory does not grow with the slice
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + HASHED, side="right"))
        piece = points[base : int(ends[j - 1])]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_values(piece) * up[: len(piece)], out=total[1:])
        out[i:j] = (total[ends[i:j] - base] - total[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return mix64(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _edges(matrix: np.ndarray, v: Vocabulary, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: score and id of the piece of length l (axis 0, l-1) that ends at position
    e (axis 2, e-begin-1, for begin < e <= end) in each word (axis 1). Ids below zero stand for characters that bytes must spell."""
    low = max(0, begin + 1 - v.longest)
    part = matrix[:, low:end]
    longest = min(end, v.longest)
    score = np.full((longest, len(matrix), end - begin), -np.inf)
    piece = np.zeros((longest, len(matrix), end - begin), np.int32)
    values = _values(part)
    rolled = values
    for size in range(1, longest + 1):
        if size > 1:
            rolled = rolled[:, :-1] * _BASE + values[:, size - 1 :]
        skip = max(0, begin + 1 - low - size)
        at, ids = v.probe(rolled[:, skip:])
        row, col = np.divmod(at, rolled.shape[1] - skip)
        col += low + skip + size - begin - 1
        score[size - 1, row, col] = v.scores[ids]
        piece[size - 1, row, col] = ids
    row, col = np.nonzero(np.isneginf(score[0]))
    score[0, row, col] = v.unknown_score
    piece[0, row, col] = -1 - matrix[row, begin + col].astype(np.int32)
    return score, piece


def _windows(n: int, length: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // n)
    for begin in range(0, length, step):
        yield begin, min(length, begin + step)


def _ids_of(matrix: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Piece ids of spans that are known to be pieces or single characters."""
    out = -1 - matrix[row, begin].astype(np.int32)
    for n in np.unique(size).tolist():
        same = np.flatnonzero(size == n)
        for own in np.split(same, range(CELLS, len(same), CELLS)):
            hashes = np.zeros(len(own), np.uint64)
            for k in range(n):
                hashes = hashes * _BASE + _values(matrix[row[own], begin[own] + k])
            at, ids = v.probe(hashes)
            out[own[at]] = ids
    return out


def _groups(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Indices of chunks of one length with the matrix of their code points, in bounded groups."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        length = int(lengths[same[0]])
        if length:
            step = max(1, CELLS // length)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                if len(part) == 1:
                    yield part, points[None, starts[part[0]] : ends[part[0]]]
                else:
                    yield part, points[starts[part][:, None] + np.arange(length)]


def _best(matrix: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray | None]:
    """Backpointers (length of the best last piece by position) and, of words within one window, all piece ids."""
    n, length = matrix.shape
    keep = v.longest
    back = np.zeros((n, length + 1), np.uint8 if keep < 256 else np.int32)
    best = np.full((n, keep), -np.inf)  # of the last positions before the window
    best[:, -1] = 0
    rows = np.arange(n)
    for begin, end in _windows(n, length):
        score, piece = _edges(matrix, v, begin, end)
        longest = len(score)
        if n == 1:
            values = best[0].tolist() + [-np.inf] * (end - begin)
            ends, sizes = np.nonzero(score[:, 0].T > -np.inf)  # by position, and there from short to long
            behind = [0] * (end - begin)
            for e, size, x in zip(ends.tolist(), (sizes + 1).tolist(), score[sizes, 0, ends].tolist(), strict=True):
                x += values[keep + e - size]
                if x >= values[keep + e]:
                    values[keep + e], behind[e] = x, size
            back[0, begin + 1 : end + 1] = behind
            best = np.array([values[-keep:]])
            continue
        wide = np.concatenate((best, np.empty((n, end - begin))), axis=1)
        for e in range(end - begin):
            k = min(begin + e + 1, longest)
            options = wide[:, keep + e - k : keep + e].T + score[k - 1 :: -1, :, e] if k < longest else wide[:, keep + e - k : keep + e].T + score[::-1, :, e]
            choice = options.argmax(axis=0)  # longest piece first
            wide[:, keep + e] = options[choice, rows]
            back[:, begin + e + 1] = k - choice
        best = wide[:, -keep:]
    return back, piece if length and end == length and begin == 0 else None


def viterbi(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of every chunk: flat piece ids and offsets by chunk.

    Ties go to the longer last piece. Ids below zero stand for single characters (see `spell`).
    """
    counts = np.zeros(len(starts), np.int64)
    found = []
    for part, matrix in _groups(points, starts, ends):
        n, length = matrix.shape
        back, piece = _best(matrix, v)
        if n == 1:
            at, cuts, steps_back = length, array("q"), memoryview(back[0])
            while at:
                cuts.append(at)
                at -= steps_back[at]
            at = np.frombuffer(cuts, np.int64)[::-1]
            size = back[0, at].astype(np.int64)
            row = np.zeros(len(at), np.int8)
        else:
            at = np.full(n, length)
            live = np.arange(n)
            steps = []
            while len(live):
                size = back[live, at[live]].astype(np.int64)
                steps.append((live, at[live], size))
                at[live] -= size
                live = live[at[live] > 0]
            turn = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
            row, at, size = (np.concatenate(x) for x in zip(*steps, strict=True))
            order = np.lexsort((-turn, row))
            row, at, size = row[order], at[order], size[order]
        ids = piece[size - 1, row, at - 1] if piece is not None else _ids_of(matrix, row, at - size, size, v)
        counts[part] = np.bincount(row, minlength=n)
        found.append((part, ids))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    flat = np.zeros(offsets[-1], np.int32)
    for part, ids in found:
        many = counts[part]
        flat[np.repeat(offsets[part] - np.cumsum(many) + many, many) + np.arange(len(ids))] = ids
    return flat, offsets


def spell(flat: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Put byte pieces in place of ids below zero."""
    odd = np.flatnonzero(flat < 0)
    if not len(odd):
        return flat, offsets
    spelled = [
        v.byte_ids[list((chr(MARK) if p == LITERAL_MARK else chr(p)).encode("utf-8", "surrogatepass"))] for p in (-1 - flat[odd]).tolist()
    ]
    grow = np.zeros(len(flat) + 1, np.int64)
    grow[odd + 1] = [len(s) - 1 for s in spelled]
    moved = np.arange(len(flat) + 1) + np.cumsum(grow)
    out = np.zeros(moved[-1], np.int32)
    out[moved[:-1]] = flat
    lengths = np.array([len(s) for s in spelled])
    out[np.repeat(moved[odd] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = np.concatenate(spelled)
    return out, moved[offsets]


def _log_sum(options: np.ndarray) -> np.ndarray:
    top = options.max(axis=0)
    return top + np.log(np.exp(options - top).sum(axis=0))


def _byte_cost(matrix_piece: np.ndarray, v: Vocabulary, score: np.ndarray) -> None:
    """Characters spelt by bytes weigh as much as their byte pieces together."""
    row, col = np.nonzero(matrix_piece[0] < 0)
    if len(row):
        points, inverse = np.unique(-1 - matrix_piece[0, row, col], return_inverse=True)
        cost = [
            v.scores[v.byte_ids[list((chr(MARK) if p == LITERAL_MARK else chr(p)).encode("utf-8", "surrogatepass"))]].sum() for p in points.tolist()
        ]
        score[0, row, col] = np.array(cost)[inverse]


def marginals(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Natural log of the summed weight of all segmentations of each chunk (forward recursion in log space)."""
    out = np.zeros(len(starts))
    for part, matrix in _groups(points, starts, ends):
        n, length = matrix.shape
        keep = v.longest
        forward = np.full((n, keep), -np.inf)  # of the last positions before the window
        forward[:, -1] = 0
        for begin, end in _windows(n, length):
            score, piece = _edges(matrix, v, begin, end)
            _byte_cost(piece, v, score)
            longest = len(score)
            if n == 1:
                values = forward[0].tolist() + [-math.inf] * (end - begin)
                ends_, sizes = np.nonzero(score[:, 0].T > -np.inf)
                for e, size, x in zip((ends_ + keep).tolist(), (sizes + 1).tolist(), score[sizes, 0, ends_].tolist(), strict=True):
                    x, y = x + values[e - size], values[e]
                    if x < y:
                        x, y = y, x
                    if x > -math.inf:
                        values[e] = x + math.log1p(math.exp(y - x))
                forward = np.array([values[-keep:]])
                continue
            wide = np.concatenate((forward, np.empty((n, end - begin))), axis=1)
            for e in range(end - begin):
                k = min(begin + e + 1, longest)
                wide[:, keep + e] = _log_sum(wide[:, keep + e - k : keep + e].T[::-1] + score[:k, :, e])
            forward = wide[:, -keep:]
        out[part] = forward[:, -1]
    return out


def expand(flat: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``of`` (with repeats) of a ragged array, as a ragged array."""
    many = (offsets[1:] - offsets[:-1])[of]
    end = np.cumsum(many)
    total = int(end[-1]) if len(end) else 0
    at = np.repeat(offsets[:-1][of] - end + many, many) + np.arange(total)
    return flat[at], np.concatenate(([0], end))
