import random

import pytest

from deltaweave.functions import kernels as K
from deltaweave.operators import fixpoint as P
from deltaweave.operators import incremental as I
from deltaweave.operators import snapshot as N
from deltaweave.operators import state as S
from deltaweave.sources import text as T
from deltaweave.streaming.changes import EvolvingResult, read_change_stream

from .graphs import dijkstra, frame, ids, labels, pagerank, random_edges, widest

CHANGES = "seq long, type string, src long, dst long, weight double"


def values(df):
    return {r.id: r.value for r in df.collect()}


def batch(edges, seed):
    rng = random.Random(seed)
    out, have = [], {e[:2] for e in edges}
    for a, b, w in edges:
        u = rng.random()
        if u < 0.3:
            out.append((len(out), "RID"[int(u * 10)], a, b, {0: w, 1: w * 2, 2: w / 2}[int(u * 10)]))
    for _ in range(6):
        a, b = rng.choice(ids(edges)), rng.choice(ids(edges))
        if a != b and (a, b) not in have:
            have.add((a, b))
            out.append((len(out), "A", a, b, float(rng.randint(1, 9))))
    now = {e[:2]: e for e in edges}
    for _, t, a, b, w in out:
        if t == "R":
            now.pop((a, b), None)
        else:
            now[a, b] = (a, b, w)
    return out, sorted(now.values())


def kept(old, new, plain, source=None):
    """The plain result on the new graph for all vertices of both."""
    loops = [(k, k, 0.0) for k in ids(old)]
    return plain(new + [x for x in loops]) if source is None else plain(new + loops, source)


@pytest.mark.parametrize("seed", [1])
def test_update_equals_recomputation(spark, seed):
    e = random_edges(seed, 20, 45)
    changes, new = batch(e, seed)
    c = spark.createDataFrame(changes, CHANGES)
    for spec, want in ((K.shortest_path(0), kept(e, new, dijkstra, 0)), (K.max_label(), kept(e, new, labels))):
        prior = P.run(spec, frame(spark, e)).state
        merged, result = I.update(spec, frame(spark, e), c, prior)
        assert sorted(map(tuple, merged.select("src", "dst", "weight").collect())) == new
        assert values(result.state) == want


def test_widest_update(spark):
    e = random_edges(4, 20, 45)
    changes, new = batch(e, 4)
    spec = K.widest_path(0)
    _, result = I.update(spec, frame(spark, e), spark.createDataFrame(changes, CHANGES), P.run(spec, frame(spark, e)).state)
    assert values(result.state) == {k: widest(new + [(0, 0, 0.0)], 0).get(k, 0.0) for k in ids(e + new)}


def test_cycle_that_loses_its_support(spark):
    edges = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)])
    c = spark.createDataFrame([(1, "R", 0, 1, None)], CHANGES)
    for spec in (K.shortest_path(0), K.widest_path(0)):
        _, r = I.update(spec, edges, c, P.run(spec, edges).state)
        assert {k: v for k, v in values(r.state).items() if k} == dict.fromkeys((1, 2), spec.identity)


def test_pagerank_update(spark):
    e = random_edges(6, 15, 40)
    changes, new = batch(e, 6)
    stop = P.Stop("delta", 1e-10)
    prior = P.run(K.pagerank(), frame(spark, e), stop=stop).state
    _, r = I.update(K.pagerank(), frame(spark, e), spark.createDataFrame(changes, CHANGES), prior, stop=stop)
    want = pagerank(new)
    assert values(r.state) == pytest.approx({k: want.get(k, 0.2) for k in ids(e + new)}, abs=1e-6)


def test_change_policies(spark):
    edges = frame(spark, [(0, 1, 1.0)])
    gone = spark.createDataFrame([(1, "R", 5, 6, None)], CHANGES)
    assert I.apply_changes(edges, gone).count() == 1
    with pytest.raises(Exception, match="not there"):
        I.apply_changes(edges, gone, "error").collect()
    with pytest.raises(Exception, match="unknown change"):
        I.apply_changes(edges, spark.createDataFrame([(1, "X", 0, 1, 1.0)], CHANGES)).collect()
    twice = spark.createDataFrame([(1, "R", 0, 1, None), (2, "A", 0, 1, 7.0)], CHANGES)
    assert [tuple(r) for r in I.apply_changes(edges, twice).collect()] == [(0, 1, 7.0)]


def test_state_operators(spark):
    s = spark.createDataFrame([(1, 1.0, 0.0), (2, 5.0, 0.0)], "id long, delta double, value double")
    got = S.upsert(s, spark.createDataFrame([(2, 9.0), (3, 4.0)], "id long, delta double"))
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 1.0, 0.0)", "(2, 9.0, 0.0)", "(3, 4.0, None)"]
    arrivals = spark.createDataFrame([(1, 3.0), (1, 2.0), (7, 1.0)], "id long, v double")
    for combine, want in (("sum", 6.0), ("min", 1.0), ("max", 3.0)):
        assert {r.id: r.delta for r in S.accumulate(s, arrivals, combine).collect()} == {1: want, 2: 5.0}
    c = spark.createDataFrame([(1, 8, 2.0), (1, 4, 2.0), (1, 9, 5.0)], "dst long, src long, contrib double")
    assert [tuple(r) for r in S.best_contributions(c, "min").collect()] == [(1, 2.0, 4)]
    assert [tuple(r) for r in S.best_contributions(c, "max").collect()] == [(1, 5.0, 9)]
    new = S.remember(c, spark.createDataFrame([(1, 4, 1.0)], c.schema), spark.createDataFrame([(1, 9)], "dst long, src long"))
    assert sorted(map(tuple, new.collect())) == [(1, 4, 1.0), (1, 8, 2.0)]


def test_snapshots(spark, tmp_path):
    e = random_edges(8)
    spec, folder = K.shortest_path(0), f"file://{tmp_path}/snap"
    edges = P.prepare_edges(spec, frame(spark, e))
    start = P.initial_state(spec, P.vertices_of(edges))
    N.iterate_with_snapshots(spec, start, edges, folder, every=1, stop=P.Stop(max_rounds=2))
    (tmp_path / "snap/epoch-000009").mkdir()
    assert N.epochs(spark, folder) == [1, 2] and N.remove_unfinished(spark, folder) == 1
    state, epoch = N.restore(spark, folder)
    assert epoch == 2 and values(P.iterate(spec, state, edges).state) == dijkstra(e, 0)
    with pytest.raises(FileNotFoundError):
        N.restore(spark, folder, 7)


def test_snapshots_and_streams_to_the_end(spark, tmp_path):
    chain, spec = frame(spark, [(k, k + 1, 1.0) for k in range(5)]), K.shortest_path(0)
    edges = P.prepare_edges(spec, chain)
    r = N.iterate_with_snapshots(spec, P.initial_state(spec, P.vertices_of(edges)), edges, f"file://{tmp_path}/snap", every=4)
    assert r.settled and values(r.state)[5] == 5.0 and N.epochs(spark, f"file://{tmp_path}/snap") == [1, 2]
    with pytest.raises(RuntimeError, match="not settled"):
        EvolvingResult(spark, f"file://{tmp_path}/versions", spec, stop=P.Stop(max_rounds=2)).start(chain)


def test_stream_of_changes(spark, tmp_path):
    e = random_edges(9, 15, 30)
    first, middle = batch(e, 1)
    second, last = batch(middle, 2)
    for k, c in enumerate((first, second)):
        T.write_changes(spark.createDataFrame(c, CHANGES).coalesce(1), f"file://{tmp_path}/in{k}")
    incoming = tmp_path / "stream"
    incoming.mkdir()
    for k in range(2):
        (part,) = (tmp_path / f"in{k}").glob("part-*.txt")
        part.rename(incoming / f"{k}.txt")
        __import__("os").utime(incoming / f"{k}.txt", (1000 + k, 1000 + k))
    result = EvolvingResult(spark, f"file://{tmp_path}/versions", K.shortest_path(0))
    result.start(frame(spark, e))
    query = result.follow(read_change_stream(spark, f"file://{incoming}"), f"file://{tmp_path}/checkpoint")
    query.awaitTermination(180)
    assert result.version == 1
    assert sorted(map(tuple, result.edges().select("src", "dst", "weight").collect())) == last
    got = {k: v for k, v in values(result.state()).items() if v < float("inf")}
    assert got == {k: v for k, v in dijkstra(last + [(0, 0, 0.0)], 0).items() if v < float("inf")}
