import random

import numpy as np

from pyspark.sql import types as T

from deltaweave.llm import maxscore

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(rows, k, of):
    import math

    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i % of == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, of=5):
    vectors = maxscore.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, maxscore.top_k(vectors, vectors.where(f"vec_id % {of} = 0"), k).collect()))


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_BYTES", 12 * 2 * 40)
    rng = random.Random(1)
    q = lambda x: round(x * 64) / 64  # noqa: E731  exact as a float
    rows = [(i, [q(rng.gauss(0, 0.2)) for _ in range(12)], "x") for i in range(400)]
    rows += [(1000 + i, rows[0][1], "x") for i in range(30)]  # equal scores
    rows += [(2000, None, "x"), (2005, [None] * 12, "x"), (2010, [float("nan")] * 12, "x"), (2015, [float("inf")] * 12, "x"), (None, rows[1][1], "x")]
    rows += [(2020, [0.0] * 12, "x"), (2025, [1.0, -1.0], "x"), (3, rows[3][1], "x")]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], "x")]) == []
    assert run(spark, [(0, [0.5], "x"), (1, [-0.25], "x"), (2, [-0.25], "x")]) == [(0, 1, 1, -8192), (0, 2, 2, -8192)]


def test_conflicting_repeats_and_large_components(spark):
    rows = [(0, [0.5, 0.25], "x"), (0, [-0.5, 0.25], "x"), (1, [300.0, -2.0], "x"), (2, [-200.0, 1.0], "x"), (3, [1e6, 0.0], "x")]
    want = sorted((q, r, i, s) for q, r, i, s in brute([(0, [-0.5, 0.25], "x"), *rows[2:]], 5, 5))
    assert run(spark, rows) == want
    assert run(spark, list(reversed(rows))) == want


def test_shards_prune():
    """Clustered vectors: thresholds and lengths leave few vectors to be probed to the end."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 32))
    vectors = np.floor(64 * (centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.1, (3000, 32)))).astype(np.int16)
    shard = maxscore.Shard(np.arange(3000), vectors)
    for q in range(0, 3000, 100):
        rows, scores = shard.top(q, vectors[q], 5)
        exact = vectors.astype(np.int64) @ vectors[q].astype(np.int64)
        exact[q] = -(1 << 60)
        want = np.lexsort((np.arange(3000), -exact))[:5]
        assert rows.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
        low, _ = shard.top(q, vectors[q], 5, int(scores[-1]))
        assert low.tolist() == rows.tolist()
    assert shard.finished < 0.2 * shard.offered
