import itertools
import math
import os
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from deltaweave.llm import lattice, pieces

from .helpers import table

PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "abb", "▁▁", "bb", "c"]


def toy():
    names = [f"<0x{k:02X}>" for k in range(256)] + PIECES
    rng = random.Random(4)
    return lattice.vocabulary(names, [0.0] * 256 + [-rng.uniform(1, 6) for _ in PIECES], np.arange(256, dtype=np.int32), [False] * 256 + [True] * len(PIECES))


def splits(s):
    for cuts in itertools.product([0, 1], repeat=max(0, len(s) - 1)):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(s)]
        yield [s[a:b] for a, b in zip(at, at[1:])]


def test_best_and_summed_segmentations():
    v, rng = toy(), random.Random(6)
    ids = {p: 256 + k for k, p in enumerate(PIECES)}
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    flat, offsets = pieces.encode_column(pa.array(texts), v)
    points, at = lattice.marked(*__import__("deltaweave.llm.text", fromlist=["code_points"]).code_points(pa.array(texts)))
    logs = lattice.marginals(points, at[:-1], at[1:], v)
    for k, t in enumerate(texts):
        scores = [sum(v.scores[ids[p]] for p in s) for s in splits("▁" + t.replace(" ", "▁")) if all(p in ids for p in s)]
        got = flat[offsets[k] : offsets[k + 1]]
        assert math.isclose(v.scores[got].sum(), max(scores))
        assert math.isclose(logs[k], math.log(sum(map(math.exp, scores))), abs_tol=1e-9)


def test_windows_change_nothing(monkeypatch):
    """One word alone, many words, and words cut into windows of a few positions have the same results."""
    v, rng = toy(), random.Random(9)
    text_of = __import__("deltaweave.llm.text", fromlist=["code_points"]).code_points
    texts = ["".join(rng.choice("abcé ") for _ in range(40)) for _ in range(30)]
    want = pieces.encode_column(pa.array(texts), v)
    points, at = lattice.marked(*text_of(pa.array(texts)))
    logs = lattice.marginals(points, at[:-1], at[1:], v)
    for cells in (1, 7, 200):
        monkeypatch.setattr(lattice, "CELLS", cells)
        got = pieces.encode_column(pa.array(texts), v)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
        assert np.allclose(lattice.marginals(points, at[:-1], at[1:], v), logs, atol=1e-9)
    monkeypatch.setattr(lattice, "LONG", 3)
    got = pieces.encode_column(pa.array(texts), v)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_chunks_are_hashed_in_windows(monkeypatch):
    """Two million characters in short words are hashed in less than 16 MB besides; equal words have equal hashes in any window."""
    rng = np.random.default_rng(3)
    cuts = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 450_000))))
    cuts = cuts[cuts <= 2_000_000]
    points = rng.integers(97, 100, cuts[-1]).astype(np.uint32)
    tracemalloc.start()
    hashes = lattice.chunk_hashes(points, cuts[:-1], cuts[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(points) > 1_900_000 and peak < 16 << 20, peak
    text = points.astype(np.uint8).tobytes()
    words = [text[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist())))
    monkeypatch.setattr(lattice, "HASHED", 11)
    lattice._powers.cache_clear()
    assert np.array_equal(lattice.chunk_hashes(points[: cuts[2000]], cuts[:2000], cuts[1:2001]), hashes[:2000])
    lattice._powers.cache_clear()


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_memory_of_a_long_run():
    """Four million characters without a space: encoded, decoded and scored in less than 400 MB."""
    code = """
import random, resource, pyarrow as pa
from deltaweave.llm import lm, pieces
v = pieces.vocabulary_of(pieces.MODEL, True)
t = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=4_000_000))
ids, of = pieces.encode_column(pa.array([t]), v)
assert pieces.Decoder(v).texts(ids, of)[0].decode() == t
assert lm.word_logs([t.encode()], v)[0] < 0
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert int(out.stdout) < 400, out


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_unigram_file_and_null_ids(spark, tmp_path):
    """A true unigram model (scores that are log probabilities) needs no ranks; the library cuts as we do."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    v = lattice.zipf_scores(lattice.from_model(pieces.MODEL))
    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for k, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = float(v.scores[k])
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rows = [(None, "null ids are texts like others"), (None, None), (1, "the quick brown fox"), (1, "the quick brown fox")]
    got = pieces.encode(table(spark, rows), str(path), ranks=False).collect()
    scores = [library.get_score(i) for i in range(library.get_piece_size())]
    for r in got:
        text = {1: "the quick brown fox"}.get(r.doc_id, "null ids are texts like others" if r.pieces else "")
        assert math.isclose(sum(scores[i] for i in r.pieces), sum(scores[i] for i in library.encode(text)), abs_tol=1e-2)
    assert sorted(map(len, (r.pieces for r in got)))[0] == 0 and len(got) == 4
    with pytest.raises(FileNotFoundError, match="PIECE_MODEL"):
        pieces.encode(table(spark, rows), str(tmp_path / "none.model"))


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_round_trip_and_library(spark):
    texts = ["Hello world", "  two  spaces ", "", None, "a\nb\n\n c", "▁mark ▁", "日本 😀 \u0000 é", "x" * 30_000, "word " * 20_000, "Hello world"]
    df = table(spark, list(enumerate(texts)))
    encoded = pieces.encode(df)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    digest = pieces.encode_digest(df).collect()
    assert all(r.round_trip for r in digest) and {r.doc_id: r.n_pieces for r in digest}[2] == 0
    assert pieces.encode_digest(table(spark, [])).collect() == []
    # the library's own unigram search over the same pieces and scores finds equally good segmentations
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    v = lattice.zipf_scores(lattice.from_model(pieces.MODEL))
    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for k, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = float(v.scores[k])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(8)
    some = ["".join(rng.choice("thequickbrownfoxéü,. ") for _ in range(60)) for _ in range(60)]
    flat, offsets = pieces.encode_column(pa.array(some), v)
    for k, t in enumerate(some):
        mine, other = flat[offsets[k] : offsets[k + 1]], library.encode(t)
        assert abs(v.scores[mine].sum() - v.scores[other].sum()) < 1e-3 * len(other)
