import pytest
from pyspark.sql import functions as F

from deltaweave.operators import adjacency as A
from deltaweave.sources import generate as G
from deltaweave.sources import text as T

from .graphs import TRI, frame

INF = float("inf")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("weighted", [True, False])
def test_graph_round_trip(spark, tmp_path, weighted):
    edges = frame(spark, [*TRI, (3, 1, 0.5)])
    T.write_graph(edges, spark.createDataFrame([(9,)], "id long"), f"file://{tmp_path}/g", weighted, parts=2)
    back, vertices = T.read_graph(spark, f"file://{tmp_path}/g", weighted)
    want = edges if weighted else edges.withColumn("weight", F.lit(1.0))
    assert rows(back, "src", "dst", "weight") == rows(want, "src", "dst", "weight")
    assert rows(vertices, "id") == [(0,), (1,), (2,), (3,), (9,)]
    for f in (tmp_path / "g").glob("part-0000*"):
        keys = {int(line.split("\t")[0]) % 2 for line in f.read_text().splitlines()}
        assert len(keys) <= 1


def test_result_round_trip(spark, tmp_path):
    state = spark.createDataFrame([(1, 0.5, 2.0), (2, INF, INF), (3, -1.25, -INF)], "id long, delta double, value double")
    T.write_result(state, f"file://{tmp_path}/r")
    assert rows(T.read_result(spark, f"file://{tmp_path}/r"), "id", "delta", "value") == rows(state, "id", "delta", "value")


def test_changes(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/delta-0").write_text("A 1,2,0.5\n\nR\t3,4\nI 1,5,2\n")
    got = T.read_changes(spark, f"file://{tmp_path}/c")
    assert rows(got, "type", "src", "dst", "weight") == [("A", 1, 2, 0.5), ("I", 1, 5, 2.0), ("R", 3, 4, None)]
    T.write_changes(got, f"file://{tmp_path}/d", both_ways=True)
    assert T.read_changes(spark, f"file://{tmp_path}/d").count() == 6
    (tmp_path / "c/delta-1").write_text("X 1,2\n")
    with pytest.raises(Exception, match="not a change"):
        T.read_changes(spark, f"file://{tmp_path}/c").collect()
    assert T.read_changes(spark, f"file://{tmp_path}/c", strict=False).count() == 3


def test_other_formats(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2), (5, 3)], "src long, dst long")
    T.write_critical_edges(pairs, f"file://{tmp_path}/e", parts=2)
    assert rows(T.read_critical_edges(spark, f"file://{tmp_path}/e"), "src", "dst") == [(1, 2), (5, 3)]
    c = spark.createDataFrame([(1, 2, 0.5), (1, 3, 4.0)], "dst long, src long, contrib double")
    T.write_in_neighbours(c, f"file://{tmp_path}/i")
    assert rows(T.read_in_neighbours(spark, f"file://{tmp_path}/i"), "dst", "src", "contrib") == rows(c, "dst", "src", "contrib")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/part0").write_text("1_2\t4 7 8 \t9 \n")
    (r,) = T.read_pairs(spark, f"file://{tmp_path}/p").collect()
    assert tuple(r) == (1, 2, 4, [7, 8], [9])
    T.repartition_lines(spark, f"file://{tmp_path}/e", f"file://{tmp_path}/e2", 3)
    assert rows(T.read_critical_edges(spark, f"file://{tmp_path}/e2"), "src", "dst") == [(1, 2), (5, 3)]


def test_adjacency(spark):
    edges = frame(spark, TRI)
    assert rows(A.edges_of(A.adjacency(edges)), "src", "dst", "weight") == rows(edges, "src", "dst", "weight")
    assert rows(A.out_degree(edges), "id", "degree") == [(0, 2), (1, 1), (2, 1)]
    assert rows(A.invert(A.invert(edges)), "src", "dst", "weight") == rows(edges, "src", "dst", "weight")
    assert {r[0] for r in A.normalise(edges, 0.5).groupBy("src").agg(F.round(F.sum("weight"), 9).alias("s")).select("s").collect()} == {0.5}
    assert A.symmetrise(edges).where("src = 2 and dst = 0").first().weight == 1.0


def test_generated_graphs_are_stable(spark):
    g = G.random_graph(spark, 500, weights=(2.0, 3.0))
    assert rows(g, "src", "dst", "weight") == rows(G.random_graph(spark, 500, weights=(2.0, 3.0)).repartition(7), "src", "dst", "weight")
    assert g.where("src = dst or dst >= 500 or weight < 2 or weight >= 3").count() == 0
    assert g.groupBy("src", "dst").count().where("count > 1").count() == 0 and g.count() > 500
    assert G.log_normal_graph(spark, 300).where("src = dst or weight <= 0").count() == 0
    with pytest.raises(ValueError):
        G.power_law(F.lit(0.5), alpha=1.0)


def test_generated_changes(spark):
    g = G.random_graph(spark, 800, weights=(1.0, 2.0)).persist()
    n = g.count()
    c = G.random_changes(g, 0.3, G.change_rates(0.5, 0.5), 800, seed=4).persist()
    kinds = {r["type"]: r["count"] for r in c.groupBy("type").count().collect()}
    assert all(0.04 * n < kinds[k] < 0.11 * n for k in "ARID")
    assert c.where("type = 'A'").join(g, ["src", "dst"]).count() == 0
    assert c.where("type <> 'A'").join(g, ["src", "dst"], "left_anti").count() == 0
    assert set(r[0] for r in G.random_changes(g, 0.3, G.change_rates(0.5, 0.5), 800, weighted=False).select("type").distinct().collect()) == {"A", "R"}
    critical = g.where("src % 10 = 0").select("src", "dst")
    some = G.critical_changes(g, critical, 800, 0.1, 0.5, 0.4, 0.5)
    on = some.join(critical, ["src", "dst"]).count()
    assert 0.3 * critical.count() < on < 0.7 * critical.count()
    assert some.where("type = 'A'").join(critical, ["src", "dst"]).count() == 0


def test_additions_to_a_dense_graph(spark):
    g = spark.range(40).selectExpr("id AS src").crossJoin(spark.range(20).selectExpr("id AS dst")).where("src <> dst").withColumn("weight", F.lit(1.0))
    c = G.random_changes(g, 0.3, {"A": 1.0, "R": 0.0, "I": 0.0, "D": 0.0}, 40, seed=2)
    drawn = G._drawn(g, {"A": F.lit(0.3), "R": F.lit(0.0), "I": F.lit(0.0), "D": F.lit(0.0)}, 2).count()
    assert c.count() > 0.98 * drawn > 200
    assert c.select("src", "dst").distinct().count() == c.count() and c.where("src = dst").count() == 0
    assert c.join(g, ["src", "dst"], "left_semi").count() == 0
    assert rows(c, "src", "dst", "weight") == rows(G.random_changes(g.repartition(5), 0.3, {"A": 1.0, "R": 0.0, "I": 0.0, "D": 0.0}, 40, seed=2), "src", "dst", "weight")
    whole = spark.range(9).selectExpr("id AS src").crossJoin(spark.range(9).selectExpr("id AS dst")).withColumn("weight", F.lit(1.0))
    assert G.random_changes(whole, 1.0, {"A": 1.0, "R": 0.0, "I": 0.0, "D": 0.0}, 9).count() == 0
