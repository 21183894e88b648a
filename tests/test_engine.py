"""Parts of the engine that small graphs do not reach by themselves: long labels, hubs, cutoffs, provenance, files to files."""

import pytest
from pyspark.sql import functions as F

from deltaweave import programs
from deltaweave.__main__ import parsed
from deltaweave.functions import kernels as K
from deltaweave.operators import fixpoint as P
from deltaweave.operators import incremental as I
from deltaweave.operators import provenance as V
from deltaweave.plans import lineage
from deltaweave.sources import text
from deltaweave.streaming.changes import EvolvingResult
from deltaweave.types import KernelSpec

from .graphs import TRI, dijkstra, frame, pagerank, random_edges


def values(df):
    return {r.id: r.value for r in df.collect()}


def test_labels_beyond_doubles(spark, tmp_path):
    big = 1 << 60
    edges = spark.createDataFrame([(big + 1, big + 3), (big + 3, big + 1), (big + 5, big + 5), (-7, big + 5)], "src long, dst long")
    state = P.run(K.max_label(), edges).state
    assert values(state) == {big + 1: big + 3, big + 3: big + 3, big + 5: big + 5, -7: -7}
    assert values(P.run(K.min_label(), edges).state) == {big + 1: big + 1, big + 3: big + 1, big + 5: -7, -7: -7}
    text.write_result(state, f"file://{tmp_path}/r")
    assert values(text.read_result(spark, f"file://{tmp_path}/r", "long")) == values(state)
    swapped = values(P.neighbour_labels(edges, 1))
    assert swapped == {big + 1: big + 3, big + 3: big + 1, big + 5: -7}


def test_labels_are_updated(spark):
    big = 1 << 60
    e = [(big + 1, big + 3, 1.0), (big + 3, big + 5, 1.0), (big + 5, big + 1, 1.0)]
    edges = frame(spark, e)
    changes = spark.createDataFrame([(1, "R", big + 5, big + 1, None), (2, "A", big + 9, big + 1, 1.0)], "seq long, type string, src long, dst long, weight double")
    _, now = I.update(K.max_label(), edges, changes, P.run(K.max_label(), edges).state)
    assert values(now.state) == {big + 1: big + 9, big + 3: big + 9, big + 5: big + 9, big + 9: big + 9}


def test_hubs_are_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "HUB_EDGES", 10)
    e = [(0, k, float(k)) for k in range(1, 200)] + [(k, 0, 1.0) for k in range(1, 200, 3)] + [(k, k + 1, 2.0) for k in range(1, 199)]
    edges = frame(spark, e)
    held = P.prepare_edges(K.shortest_path(0), edges)
    assert [(r.src, r.salts) for r in held.hubs.collect()] == [(0, 20)]
    most = held.frame.groupBy("src", "salt").count().agg(F.max("count")).first()[0]
    assert most < 40 and held.frame.count() == len(e)
    assert values(P.run(K.shortest_path(0), edges).state) == dijkstra(e, 0)
    assert values(P.run(K.pagerank(), edges, stop=P.Stop("delta", 1e-2)).state) == pytest.approx(pagerank(e), abs=0.06)


@pytest.mark.parametrize("share", [0.001, 0.13, 0.5, 0.99])
def test_cutoff_takes_what_a_sort_takes(spark, share):
    spec = K.pagerank()
    state = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(40)).cast("double")).alias("delta"), F.lit(0.0).alias("value"))
    ids = lambda at_once: {r.id for r in P.top_portion(spec, state, P.Schedule(share), 3000, at_once).collect()}
    assert ids(0) == ids(10_000)


def test_schedule_by_degree(spark):
    e = random_edges(5)
    got = P.run(K.pagerank(), frame(spark, e), schedule=P.Schedule(0.2, "value", 1.0, True), stop=P.Stop("delta", 1e-2)).state
    assert values(got) == pytest.approx(pagerank(e), abs=0.1)


def test_pre_hook(spark):
    """Deltas are halved before they are folded and sent."""
    spec = KernelSpec("Halved", "sum", lambda k: F.lit(8.0), lambda d, w, n: d, 0.0, before=lambda d, v: d / 2)
    got = P.run(spec, frame(spark, [(0, 1, 1.0), (1, 2, 1.0)])).state
    assert values(got) == {0: 4.0, 1: 6.0, 2: 7.0}


def test_stop_rules_of_values(spark):
    edges = frame(spark, random_edges(4))
    squares = P.run(K.pagerank(), edges, stop=P.Stop("squares", 1e-3)).metrics
    assert abs(squares[-1]["squares"] - squares[-2]["squares"]) < 1e-3 <= abs(squares[-2]["squares"] - squares[-3]["squares"])
    by_pairs = P.run(K.shortest_path(0), edges, stop=P.Stop("pairs", 1e-9))
    assert values(by_pairs.state) == dijkstra(random_edges(4), 0)
    assert P.metrics_table(spark, by_pairs).count() == len(by_pairs.metrics)


def test_closure_in_levels(spark, monkeypatch):
    monkeypatch.setattr(I, "FRONTIERS", 3)
    chain = spark.createDataFrame([(k, k + 1) for k in range(14)], "src long, dst long")
    got = [r.id for r in I._closure(spark.createDataFrame([(2,)], "id long"), chain).collect()]
    assert sorted(got) == list(range(2, 15))


def test_values_get_worse_by_what_is_remembered(spark):
    spec, edges = K.shortest_path(0), frame(spark, [*TRI, (0, 3, 9.0), (1, 3, 1.0)])
    before = V.remembered(spec, edges, P.run(spec, edges).state)
    assert {r.id: (r.value, r.best_from) for r in before.state.collect()} == {0: (0.0, None), 1: (2.0, 0), 2: (4.0, 1), 3: (3.0, 1)}
    changes = spark.createDataFrame([(1, "I", 0, 1, 20.0), (2, "R", 1, 3, None), (3, "A", 2, 4, 1.0)], "seq long, type string, src long, dst long, weight double")
    _, now = V.update_remembered(spec, edges, changes, before)
    assert {r.id: (r.value, r.best_from) for r in now.state.collect()} == {0: (0.0, None), 1: (20.0, 0), 2: (5.0, 0), 3: (9.0, 0), 4: (6.0, 2)}
    lost = spark.createDataFrame([(1, "R", 0, 1, None)], "seq long, type string, src long, dst long, weight double")
    loop = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)])
    with pytest.raises(RuntimeError, match="lost its support"):
        V.update_remembered(spec, loop, lost, V.remembered(spec, loop, P.run(spec, loop).state), max_rounds=8)


def test_simrank_over_pairs(spark):
    edges = frame(spark, random_edges(6, 8, 20))
    want = {(r.a, r.b): r.value for r in P.simrank(edges, rounds=3, least=0.0).collect()}
    got = {(r.a, r.b): r.value for r in P.simrank_pairs(P.pair_graph(edges), rounds=3, least=0.0).collect()}
    assert got == pytest.approx(want) and want


@pytest.mark.parametrize("runner", ["Pagerank", "ConComp", "MinSpanTree", "Katz"])
def test_programs_from_files_to_files(spark, tmp_path, runner):
    graph, result, log = (f"file://{tmp_path}/{x}" for x in ("g", "r", "l/run7"))
    weighted = runner in programs.WEIGHTED
    text.write_graph(frame(spark, TRI), None, graph, weighted, parts=3)
    job = parsed(["--runner", runner, "--graph_dir", graph, "--result_dir", result, "--log_dir", log, "--shards", "3", "--katz_beta", "0.01", "--termcheck_threshold", "1e-6"])
    done = programs.execute(spark, job)
    back = text.read_result(spark, result)
    assert values(back) == pytest.approx(values(done.state)) and back.count() == 3
    assert text.routed(spark, result, 3).count() == 3
    (row,) = text.timing_table(spark, f"file://{tmp_path}/l", ["load", "compute", "dump"]).collect()
    assert row.run == "run7" and row.compute >= 0


def test_program_with_changes(spark, tmp_path):
    graph, result, delta = (f"file://{tmp_path}/{x}" for x in ("g", "r", "d"))
    text.write_graph(frame(spark, TRI), None, graph, True)
    (tmp_path / "delta-0").write_text("I 0,1,7\n")
    (tmp_path / "delta-1").write_text("A 2,5,1\n")
    programs.execute(spark, programs.Job("ShortestPath", graph_dir=graph, result_dir=result, delta_prefix=f"file://{tmp_path}/delta-"))
    assert values(text.read_result(spark, result)) == {0: 0.0, 1: 7.0, 2: 5.0, 5: 6.0}
    with pytest.raises(KeyError):
        programs.execute(spark, programs.Job("Nobody"))
    programs.execute(spark, programs.Job("GenGraph", graph_dir=delta, num_nodes=50, shards=4))
    edges, vertices = text.read_graph(spark, delta, True, parts=4)
    assert vertices.count() == 50 and edges.count() > 0


def test_order_of_change_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/delta-10").write_text("I 1,2,30\n")
    (tmp_path / "c/delta-02").write_text("I 1,2,10\nI 1,2,20\n")
    got = [r.weight for r in text.read_changes(spark, f"file://{tmp_path}/c").orderBy("seq").collect()]
    assert got == [10.0, 20.0, 30.0]


def test_lines_in_wrong_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/part0").write_text("0\t1 \n2\t1 \n")
    (tmp_path / "g/part1").write_text("1\t0 \n4\t0 \n")
    with pytest.raises(Exception, match="another part"):
        text.read_graph(spark, f"file://{tmp_path}/g", False, parts=2)[0].collect()
    edges, _ = text.read_graph(spark, f"file://{tmp_path}/g", False, parts=2, misplaced="drop")
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (1, 0), (2, 1)]


def test_triggers(spark, tmp_path):
    seen = []
    r = EvolvingResult(spark, f"file://{tmp_path}/e", K.shortest_path(0))
    r.watch(lambda batch, rows: seen.append((batch, sorted(tuple(x) for x in rows.collect()))))
    r.start(frame(spark, TRI))
    r.apply(spark.createDataFrame([("D", 0, 2, 1.0)], "type string, src long, dst long, weight double"), 0)
    assert seen == [(0, [(2, 1.0, 4.0)])]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://elsewhere:7077", "app"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        lineage.scratch(Session)
    assert lineage.scratch(spark).endswith(spark.sparkContext.applicationId)
