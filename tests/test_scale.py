"""Work that must not grow with the number of reads, rounds or rows of one task."""

import pytest

from deltaweave.functions import kernels as K
from deltaweave.operators import adjacency as A
from deltaweave.operators import fixpoint as P
from deltaweave.plans import graphs as G
from deltaweave.plans import lineage
from deltaweave.sources import generate

from .graphs import frame, labels, random_edges, widest

CHAIN = [(k, k + 1, 1.0) for k in range(40)]


def values(df):
    return {r.id: r.value for r in df.collect()}


def counted(spark, edges):
    """The edges, and how many rows of them were made."""
    made = spark.sparkContext.accumulator(0)
    return frame(spark, edges).rdd.map(lambda r: (made.add(1), tuple(r))[1]).toDF("src long, dst long, weight double"), made


def cuts_of(monkeypatch, module):
    seen, cut = [], module.cut

    def noted(df, **metrics):
        out, found = cut(df, **metrics)
        seen.append(found)
        return out, found

    monkeypatch.setattr(module, "cut", noted)
    return seen


@pytest.mark.parametrize("spec", [K.shortest_path(0), K.pagerank()])
def test_a_run_makes_its_edges_once(spark, spec):
    e = random_edges(5)
    edges, made = counted(spark, e)
    P.run(spec, edges, stop=P.Stop(max_rounds=2))
    assert made.value == len(e)


def test_simrank_makes_its_edges_once(spark):
    e = random_edges(6, 8, 20)
    for work in (lambda x: P.simrank(x, rounds=3).count(), lambda x: P.pair_graph(x).count()):
        edges, made = counted(spark, e)
        work(edges)
        assert made.value == len(e)


def test_rounds_of_few_vertices_share_jobs(spark, monkeypatch):
    seen = cuts_of(monkeypatch, P)
    r = P.run(K.shortest_path(0), frame(spark, CHAIN))
    assert r.rounds == 41 and values(r.state) == {k: float(k) for k in range(41)}
    assert [m["round"] for m in r.metrics] == list(range(42)) and [m["pending"] for m in r.metrics] == [1] * 41 + [0]
    assert len(seen) < 15


def test_rounds_of_few_vertices_write_what_changed(spark, monkeypatch):
    seen = cuts_of(monkeypatch, P)
    P.run(K.shortest_path(0), frame(spark, CHAIN + [(k, 0, 1.0) for k in range(100, 600)]), stop=P.Stop(max_rounds=3))
    assert seen[3]["rows"] == 4  # after the edges, the state and what was pending


@pytest.mark.parametrize("spec, plain", [(K.widest_path(0), lambda e: widest(e, 0)), (K.max_label(), labels)])
@pytest.mark.parametrize("few, share", [(50_000, 0.25), (5, 0.0)])
def test_any_share_of_changed_vertices_gives_the_same(spark, monkeypatch, spec, plain, few, share):
    monkeypatch.setattr(P, "LEAN", few)
    monkeypatch.setattr(P, "LEAN_SHARE", share)
    e = random_edges(8, 12, 24)
    r = P.run(spec, frame(spark, e))
    assert values(r.state) == plain(e)
    monkeypatch.setattr(P, "LEAN", -1)
    monkeypatch.setattr(P, "LEAN_SHARE", -1.0)
    again = P.run(spec, frame(spark, e))
    assert [{k: m[k] for k in again.metrics[0]} for m in r.metrics] == again.metrics and r.rounds == again.rounds


def test_both_directions_are_grouped_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lineage, "PART_ROWS", 10)
    e = random_edges(9)
    both = A.symmetrise(frame(spark, e), len(e))
    assert both.rdd.getNumPartitions() == -(-2 * len(e) // 10)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, A.symmetrise(frame(spark, e)).collect()))
    spark.range(95).selectExpr("id % 7 AS l_suppkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert G.supplies(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_rules_on_the_same_rounds_work_them_once(spark, monkeypatch):
    e, spec = random_edges(7, 10, 30), K.pagerank()
    rules = [P.Stop("diff", 0.5), P.Stop("sum", 4.0), P.Stop("squares", 0.4), P.Stop(max_rounds=3)]
    apart = [P.run(spec, frame(spark, e), stop=rule) for rule in rules]
    held = P.prepare_edges(spec, frame(spark, e))
    seen = cuts_of(monkeypatch, P)
    together = [P.run(spec, held, stop=rule) for rule in rules]
    assert len(seen) == 1 + max(r.rounds for r in apart) < sum(r.rounds for r in apart)
    assert [(r.rounds, r.settled, len(r.metrics)) for r in together] == [(r.rounds, r.settled, len(r.metrics)) for r in apart]
    for one, other in zip(together, apart, strict=True):
        assert values(one.state) == pytest.approx(values(other.state))


def test_repeated_targets_go_without_a_table_of_all_edges(spark):
    made = generate.random_graph(spark, 60, degree="uniform", seed=7, loops=True)
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    rows = [(r.src, r.dst) for r in made.collect()]
    assert len(rows) == len(set(rows)) and all(0 <= x < 60 for r in rows for x in r)
