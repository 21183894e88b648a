"""The registered graph queries and, for each, independent DuckDB SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions.priority import priority
from .operators import adjacency as A
from .operators import critical as C
from .operators import fixpoint as P
from .operators import incremental as I
from .operators import provenance as V
from .operators import snapshot as N
from .operators import state as S
from .plans import graphs as G
from .plans.lineage import cut, scratch
from .programs import Job, execute
from .sources import generate, text
from .sql import ORACLES, ROUNDS
from .streaming.changes import EvolvingResult, read_change_stream

__all__ = ["ORACLES", "QUERIES"]

INF = float("inf")
SOURCE = 0


def _rounds(spec, edges: DataFrame, k: int = ROUNDS, vertices: DataFrame | None = None) -> DataFrame:
    return P.run(spec, edges, vertices, stop=P.Stop("delta", 0.0, k)).state


def _rounded(state: DataFrame, with_delta: bool = True) -> DataFrame:
    out = [F.round("value", 6).alias("value")] + ([F.round("delta", 6).alias("delta")] if with_delta else [])
    return state.select("id", *out)


def _finite(state: DataFrame, *others: str) -> DataFrame:
    """All vertices; null where nothing was reached."""
    return state.select("id", *[F.when(F.abs(c) < INF, F.col(c)).alias(c) for c in ("value", *others)])


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def scan_adjacency(spark, d):
    """Lists of a text graph: written, read back, and put together again."""
    path = _folder(spark, "graph")
    edges = G.handoff(spark, d)
    text.write_graph(edges, P.vertices_of(edges), path)
    back, _ = text.read_graph(spark, path, weighted=True)
    lists = A.adjacency(back)
    return lists.select("id", F.size("links").cast("long").alias("n"), F.array_join(F.transform("links", lambda x: x["end"].cast("string")), " ").alias("ends"))


def out_degree(spark, d):
    return A.out_degree(G.handoff(spark, d))


def in_neighbors(spark, d):
    found = A.in_neighbours(G.handoff(spark, d))
    return found.select("id", F.array_join(F.transform("sources", lambda x: x.cast("string")), " ").alias("sources"))


def invert_graph(spark, d):
    return A.invert(G.handoff(spark, d))


def normalize_weights(spark, d):
    return A.normalise(G.trade(spark, d)).select("src", "dst", F.round("weight", 9).alias("weight"))


def symmetrize(spark, d):
    return A.symmetrise(G.handoff(spark, d))


def inject_loops(spark, d):
    edges = G.handoff(spark, d)
    return A.with_loops(A.without_loops(edges), P.vertices_of(edges), 0.0)


def _handoff(spark, d):
    """`handoff`, written once for queries that read it several times."""
    return cut(G.handoff(spark, d))[0]


def _changes(spark, d, edges):
    """Changes of the edges of `_handoff`, written once like these."""
    return cut(G.handoff_changes(spark, d, edges))[0]


def _supplies(spark, d):
    """`supplies` in both directions."""
    edges, facts = cut(G.supplies(spark, d), n=F.count(F.lit(1)))
    return A.symmetrise(edges, facts["n"])


def _sssp(spark, d, edges=None):
    return P.run(K.shortest_path(SOURCE), _handoff(spark, d) if edges is None else edges).state


def sssp(spark, d):
    return _finite(_sssp(spark, d))


def sssp_critical_edges(spark, d):
    edges = _handoff(spark, d)
    return C.shortest_path_edges(edges, _sssp(spark, d, edges))


def sssp_rebuild(spark, d):
    edges = _handoff(spark, d)
    return _finite(C.rebuild_distances(edges, C.shortest_path_edges(edges, _sssp(spark, d, edges)), SOURCE))


def _widest(spark, d, edges=None):
    return P.run(K.widest_path(SOURCE), _handoff(spark, d) if edges is None else edges).state


def widest_path(spark, d):
    """All vertices: the width, 0 where nothing leads to, null for the source."""
    return _finite(_widest(spark, d))


def widest_critical_edges(spark, d):
    edges = _handoff(spark, d)
    return C.widest_path_edges(edges, _widest(spark, d, edges))


def _labels(spec, edges):
    return P.run(spec, edges).state.select("id", F.col("value").cast("long").alias("label"))


def cc_max_label(spark, d):
    return _labels(K.max_label(), G.handoff(spark, d))


def cc_min_label(spark, d):
    return _labels(K.min_label(), G.handoff(spark, d))


def wcc(spark, d):
    return _labels(K.max_label(), _supplies(spark, d))


def min_in_edge(spark, d):
    return _finite(P.min_in_edge(G.handoff(spark, d)))


def pagerank_k(spark, d):
    return _rounded(_rounds(K.pagerank(), G.handoff(spark, d)))


def pagerank_power(spark, d):
    return _rounded(P.power_iteration(G.handoff(spark, d), rounds=ROUNDS), False)


def jacobi_k(spark, d):
    return _rounded(_rounds(K.jacobi(), A.without_loops(A.normalise(G.trade(spark, d), 0.5))))


def markov_k(spark, d):
    return _rounded(_rounds(K.markov_chain(), A.normalise(G.event_types(spark, d))))


def adsorption_k(spark, d):
    return _rounded(_rounds(K.adsorption(starts=8), A.normalise(G.trade(spark, d))))


def katz_k(spark, d):
    edges = _supplies(spark, d)
    return _rounded(_rounds(K.katz(source=1, beta=0.002), edges, 4))


def simrank_k(spark, d):
    return P.simrank(G.busy_trade(spark, d), rounds=4, least=0.0).select("a", "b", F.round("value", 6).alias("value"))


def apply_changes(spark, d):
    return I.apply_changes(G.handoff(spark, d), G.handoff_changes(spark, d))


def split_changes(spark, d):
    good, bad = I.split_changes(G.handoff_changes(spark, d))
    return good.withColumn("side", F.lit("good")).union(bad.withColumn("side", F.lit("bad"))).groupBy("side", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def _updated(spec, spark, d):
    edges = _handoff(spark, d)
    prior = P.run(spec, edges).state
    return I.update(spec, edges, _changes(spark, d, edges), prior)[1].state


def incr_sssp(spark, d):
    return _finite(_updated(K.shortest_path(SOURCE), spark, d))


def incr_widest(spark, d):
    return _finite(_updated(K.widest_path(SOURCE), spark, d))


def incr_cc(spark, d):
    return _updated(K.max_label(), spark, d).select("id", F.col("value").cast("long").alias("label"))


#: Damping of the PageRank that is run to its fixpoint; the earlier result is rough, the update is not.
DAMPING = 0.5


def incr_pagerank(spark, d):
    """To a fixpoint on the changed graph, from a rough one before, per vertex. The error of all values together is below 2e-7."""
    edges = _handoff(spark, d)
    prior = P.run(K.pagerank(DAMPING), edges, stop=P.Stop("delta", 1e-2)).state
    now = I.update(K.pagerank(DAMPING), edges, _changes(spark, d, edges), prior, stop=P.Stop("delta", 1e-7))[1].state
    return now.select("id", F.round("value", 4).alias("value"))


def _first_rounds(spark, d, k=3):
    return P.run(K.shortest_path(SOURCE), G.handoff(spark, d), stop=P.Stop(max_rounds=k)).state


def pending_filter(spark, d):
    spec = K.shortest_path(SOURCE)
    return _first_rounds(spark, d).where(P.pending(spec)).select("id", "delta", F.when(F.col("value") < INF, F.col("value")).alias("value"))


def top_portion(spark, d):
    spec, state = K.pagerank(), _rounds(K.pagerank(), G.handoff(spark, d), 2)
    ranked = state.select("id", F.round("delta", 9).alias("delta"), "value")
    return P.top_portion(spec, ranked, P.Schedule(0.01), ranked.count())


def priority_policies(spark, d):
    """All formulas after three rounds of shortest paths, where finite."""
    spec, edges = K.shortest_path(SOURCE), G.handoff(spark, d)
    state = _first_rounds(spark, d).join(A.out_degree(edges), "id").where(F.col("delta") < INF)
    finite = lambda c: F.when(F.abs(c) < INF, c)
    return state.select(
        "id",
        finite(priority(spec, "value", 2.0)).alias("by_value"),
        finite(priority(spec, "difference")).alias("by_difference"),
        finite(priority(spec, "value", 2.0, F.col("degree"))).alias("by_degree"),
        finite(priority(spec, "eager")).alias("eager"),
    )


def scheduled_sssp(spark, d):
    """Shortest paths a portion at a time: the same fixpoint."""
    return _finite(P.run(K.shortest_path(SOURCE), G.handoff(spark, d), schedule=P.Schedule(0.02, "eager")).state)


def scheduled_by_degree(spark, d):
    """A twentieth at a time, those with many edges sooner: the same fixpoint."""
    return _finite(P.run(K.shortest_path(SOURCE), G.handoff(spark, d), schedule=P.Schedule(0.05, "eager", by_degree=True)).state)


def prepared_deltas(spark, d):
    """PageRank whose vertices halve what they got before they keep and send it."""
    spec = replace(K.pagerank(), before=lambda delta, value: delta * 0.5)
    return _rounded(_rounds(spec, G.handoff(spark, d)))


def term_report(spark, d):
    report = P.term_report(K.shortest_path(SOURCE))
    return _sssp(spark, d).agg(*[report[k].alias(k) for k in ("total", "unknown", "pending", "rows")])


def remembered_best(spark, d):
    """Best contribution and its sender for every reached vertex."""
    spec, edges = K.shortest_path(SOURCE), _handoff(spark, d)
    return S.best_contributions(S.contributions_of(spec, edges, _sssp(spark, d, edges)), "min")


def forget_contributions(spark, d):
    """The best after every third sender was removed."""
    spec, edges = K.shortest_path(SOURCE), _handoff(spark, d)
    all_ = S.contributions_of(spec, edges, _sssp(spark, d, edges))
    return S.best_contributions(S.remember(all_.limit(0), all_, all_.where("src % 3 = 0")), "min")


def upsert_state(spark, d):
    state = G.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("delta"), F.lit(0.0).alias("value"))
    rows = G.table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_acctbal").alias("value"))
    return S.upsert(state, rows)


def accumulate_state(spark, d):
    state = G.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("delta"), F.lit(0.0).alias("value"))
    arrivals = G.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"))
    return S.accumulate(state, arrivals, "max").select("id", "delta")


def get_state(spark, d):
    state = G.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    asked = G.table(spark, d, "supplier").select((F.col("s_suppkey") * 40).alias("id"))
    return S.contains(state, asked).join(S.get(state, asked, "value"), "id", "left")


def compare_results(spark, d):
    edges = _handoff(spark, d)
    return C.compare(_sssp(spark, d, edges), P.run(K.shortest_path(SOURCE), I.apply_changes(edges, _changes(spark, d, edges))).state)


def error_stats(spark, d):
    edges = _handoff(spark, d)
    s = C.error_statistics(_rounds(K.pagerank(), edges, 4), _rounds(K.pagerank(), edges, 6))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def different_neighbors(spark, d):
    edges = G.handoff(spark, d)
    return C.different_neighbours(edges.select("dst", "src"), I.apply_changes(edges, G.handoff_changes(spark, d)).select("dst", "src"))


def weight_histogram(spark, d):
    return C.log_histogram(G.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q")), "q", 2.0)


def partition_contract(spark, d):
    """How many keys each of eight parts holds."""
    ids = P.vertices_of(G.handoff(spark, d))
    return ids.groupBy(F.pmod("id", F.lit(8)).cast("int").alias("part")).agg(F.count("*").alias("n"))


def snapshot_restore(spark, d):
    """Shortest paths stopped after two rounds, restored from the snapshot, and finished."""
    folder = _folder(spark, "snapshots")
    spec, edges = K.shortest_path(SOURCE), P.prepare_edges(K.shortest_path(SOURCE), G.handoff(spark, d))
    N.iterate_with_snapshots(spec, P.initial_state(spec, P.vertices_of(edges)), edges, folder, every=2, stop=P.Stop(max_rounds=2))
    state, _ = N.restore(spark, folder)
    return _finite(P.iterate(spec, state, edges).state)


def scan_unweighted(spark, d):
    """As `scan_adjacency`, without weights."""
    path = _folder(spark, "graph")
    edges = G.handoff(spark, d)
    text.write_graph(edges, P.vertices_of(edges), path, weighted=False)
    back, vertices = text.read_graph(spark, path, weighted=False)
    lists = A.adjacency(back)
    ends = F.array_join(F.transform("links", lambda x: x["end"].cast("string")), " ")
    return vertices.join(lists, "id", "left").select("id", F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n"), F.coalesce(ends, F.lit("")).alias("ends"))


def result_files(spark, d):
    """A result written in parts and read back."""
    path = _folder(spark, "result")
    text.write_result(_sssp(spark, d), path, parts=8)
    return _finite(text.read_result(spark, path), "delta")


def result_summary(spark, d):
    return text.result_summary(K.shortest_path(SOURCE), _sssp(spark, d))


def label_files(spark, d):
    """Labels are whole numbers in files too."""
    path = _folder(spark, "labels")
    text.write_result(P.run(K.max_label(), G.handoff(spark, d)).state, path, parts=4)
    return text.read_result(spark, path, "long").select("id", F.col("value").alias("label"))


def change_files(spark, d):
    """Changes written both ways and read back."""
    path = _folder(spark, "changes")
    text.write_changes(G.handoff_changes(spark, d), path, both_ways=True)
    return text.read_changes(spark, path).select("type", "src", "dst", "weight")


def critical_files(spark, d):
    path = _folder(spark, "critical")
    text.write_critical_edges(sssp_critical_edges(spark, d), path, parts=3)
    return text.read_critical_edges(spark, path)


def neighbor_files(spark, d):
    """What every in-neighbour contributes, written and read back."""
    path = _folder(spark, "neighbours")
    spec, edges = K.shortest_path(SOURCE), _handoff(spark, d)
    text.write_in_neighbours(S.contributions_of(spec, edges, _sssp(spark, d, edges)), path)
    return text.read_in_neighbours(spark, path)


def part_files(spark, d):
    """Keys of each file of a graph in eight parts, dealt anew to five; a line in a wrong file is an error."""
    path, to = _folder(spark, "parts"), _folder(spark, "parts")
    edges = G.handoff(spark, d)
    text.write_graph(edges, P.vertices_of(edges), path, parts=8)
    text.repartition_lines(spark, path, to, 5)
    count = lambda where, n: text.routed(spark, where, n).groupBy("part").agg(F.count("*").alias("n")).withColumn("parts", F.lit(n))
    return count(path, 8).unionByName(count(to, 5))


def routed_scan(spark, d):
    """A reader that holds eight files to the keys of five parts keeps the lines that are in place in both."""
    path = _folder(spark, "parts")
    edges = G.handoff(spark, d)
    text.write_graph(edges, None, path, parts=8)
    back, _ = text.read_graph(spark, path, True, parts=5, misplaced="drop")
    return back


def partition_rules(spark, d):
    """Pairs of ids by their first id, and ids as numbers: keys per part."""
    edges = G.handoff(spark, d).select("src", F.concat_ws("_", "src", "dst").alias("pair"))
    by_pair = edges.groupBy(text.part_of(F.col("pair"), 6, "pair").alias("part")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("pair"))
    return by_pair.unionByName(edges.groupBy(text.part_of(F.col("src"), 6).alias("part")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("mod")))


def accumulate_sum(spark, d):
    state = G.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1.0).alias("delta"), F.lit(0.0).alias("value"))
    arrivals = G.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 13).cast("double").alias("v"))
    return S.accumulate(S.accumulate(state, arrivals, "sum"), arrivals, "sum", "value").select("id", "delta", "value")


def priority_accumulative(spark, d):
    """All formulas after three rounds of Jacobi, whose deltas have both signs."""
    edges = A.without_loops(A.normalise(G.trade(spark, d), 0.5))
    spec, state = K.jacobi(), _rounds(K.jacobi(), edges, 3).join(A.out_degree(edges), "id")
    return state.select(
        "id",
        F.round(priority(spec, "value", 2.0), 6).alias("by_value"),
        F.round(priority(spec, "difference"), 6).alias("by_difference"),
        F.round(priority(spec, "value", 2.0, F.col("degree")), 6).alias("by_degree"),
        F.round(priority(spec, "eager"), 6).alias("eager"),
    )


def stop_rules(spark, d):
    """Rounds and total of PageRank by each rule that looks at values."""
    spec, out = K.pagerank(), None
    edges = P.prepare_edges(spec, _handoff(spark, d))
    for rule, epsilon in (("diff", 50.0), ("sum", 900.0), ("squares", 60.0)):
        result = P.run(spec, edges, stop=P.Stop(rule, epsilon))
        row = result.state.agg(F.lit(rule).alias("rule"), F.lit(result.rounds).alias("rounds"), F.round(F.sum("value"), 4).alias("total"))
        out = row if out is None else out.unionByName(row)
    edges.unpersist()
    return out


def stop_by_pairs(spark, d):
    """Shortest paths until neither the sum nor the number of known distances moves, per round so far."""
    result = P.run(K.shortest_path(SOURCE), G.handoff(spark, d), stop=P.Stop("pairs", 1e-6))
    return _finite(result.state).withColumn("rounds", F.lit(result.rounds))


def superstep_metrics(spark, d):
    """Progress of the first six rounds of shortest paths."""
    result = P.run(K.shortest_path(SOURCE), G.handoff(spark, d), stop=P.Stop(max_rounds=6))
    return P.metrics_table(spark, result).select("round", "pending", "unknown", "rows", "total")


def power_until(spark, d):
    """Power iteration until the sum of ranks moves by 20 at most."""
    return _rounded(P.power_iteration(G.handoff(spark, d), rounds=60, epsilon=20.0), False)


def neighbor_labels(spark, d):
    """Least labels among in-neighbours, own labels not counted, after eight rounds."""
    return P.neighbour_labels(G.handoff(spark, d), ROUNDS).select("id", F.col("value").alias("label"))


def sssp_supplies(spark, d):
    """Shortest paths between suppliers and parts: nearly every vertex is reached."""
    return _finite(P.run(K.shortest_path(1), _supplies(spark, d)).state)


def top_portion_cutoff(spark, d):
    """A tenth of all vertices, found by a cutoff instead of a sort."""
    spec, state = K.pagerank(), _rounds(K.pagerank(), G.handoff(spark, d), 2)
    ranked = state.select("id", F.round("delta", 9).alias("delta"), "value")
    return P.top_portion(spec, ranked, P.Schedule(0.1), ranked.count(), at_once=0)


def remembered_sssp(spark, d):
    """Weights change; values that rested on edges that grew get worse through what is remembered."""
    spec, edges = K.shortest_path(SOURCE), _handoff(spark, d)
    before = V.remembered(spec, edges, _sssp(spark, d, edges))
    changes = _changes(spark, d, edges).where(F.col("type").isin("I", "D"))
    now = V.update_remembered(spec, edges, changes, before)[1].state
    return _finite(now).join(now.select("id", "best_from"), "id")


def simrank_pairs_k(spark, d):
    """SimRank over a pair graph that was written and read back."""
    path = _folder(spark, "pairs")
    text.write_pairs(P.pair_graph(G.busy_trade(spark, d)), path, parts=4)
    return P.simrank_pairs(text.read_pairs(spark, path), rounds=4, least=0.0).select("a", "b", F.round("value", 6).alias("value"))


def streamed_sssp(spark, d):
    """Two batches of changes that arrive as files; the result after the last, and how many rows each batch changed."""
    folder, arrived = _folder(spark, "stream"), _folder(spark, "arrived")
    edges = _handoff(spark, d)
    changes = _changes(spark, d, edges)
    text.write_changes(changes.where("src % 2 = 0").coalesce(1), f"{arrived}/a")
    text.write_changes(changes.where("src % 2 = 1").coalesce(1), f"{arrived}/b")
    stream = EvolvingResult(spark, folder, K.shortest_path(SOURCE))
    stream.start(edges)
    stream.follow(read_change_stream(spark, f"{arrived}/*/*.txt"), f"{folder}/checkpoint").awaitTermination()
    return _finite(stream.state())


def unfinished_snapshots(spark, d):
    """Two snapshots are committed, a third is not: what is removed, and what the last committed one holds."""
    folder = _folder(spark, "snapshots")
    state = G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    N.save(state.where("id % 2 = 0"), folder, 1)
    N.save(state, folder, 2)
    state.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/epoch-000003")
    gone = N.remove_unfinished(spark, folder)
    left, epoch = N.restore(spark, folder)
    return left.withColumns({"epoch": F.lit(epoch), "removed": F.lit(gone)})


def program_files(spark, d):
    """A runner by name, from a graph in files to a result in files, with its log as a timing table."""
    graph, result, log = _folder(spark, "graph"), _folder(spark, "result"), _folder(spark, "log")
    edges = G.handoff(spark, d)
    text.write_graph(edges, P.vertices_of(edges), graph, parts=4)
    execute(spark, Job("ShortestPath", graph_dir=graph, result_dir=result, log_dir=f"{log}/first", shards=4))
    timed = text.timing_table(spark, log, ["load", "compute", "dump"])
    return _finite(text.read_result(spark, result)).crossJoin(F.broadcast(timed.select("run", (F.col("compute") > 0).alias("timed"))))


def generated_graph(spark, d):
    """A power-law graph of as many vertices as there are customers."""
    g = generate.random_graph(spark, G.table(spark, d, "customer").count(), weights=(0.0, 1.0))
    return g.select("src", "dst", F.round("weight", 9).alias("weight"))


def generated_uniform(spark, d):
    """Uniform degrees, over as many vertices as there are suppliers."""
    return generate.random_graph(spark, G.table(spark, d, "supplier").count(), degree="uniform", seed=7, loops=True)


def generated_log_normal(spark, d):
    g = generate.log_normal_graph(spark, G.table(spark, d, "customer").count(), seed=3)
    return g.select("src", "dst", F.round("weight", 6).alias("weight"))


def _rounded_changes(changes: DataFrame) -> DataFrame:
    return changes.select("type", "src", "dst", F.round("weight", 9).alias("weight"))


def generated_changes(spark, d):
    """Changes that touch the edges of shortest paths at a rate of their own."""
    edges, n = _handoff(spark, d), G.table(spark, d, "customer").count()
    return _rounded_changes(generate.critical_changes(edges, C.shortest_path_edges(edges, _sssp(spark, d, edges)), n, 0.05, 0.2, 0.4, 0.2))


def random_changes(spark, d):
    edges, n = G.handoff(spark, d), G.table(spark, d, "customer").count()
    return _rounded_changes(generate.random_changes(edges, 0.1, generate.change_rates(0.4, 0.5), n, seed=2))


def random_unweighted_changes(spark, d):
    edges, n = G.handoff(spark, d), G.table(spark, d, "customer").count()
    return generate.random_changes(edges, 0.1, generate.change_rates(0.4, 0.5), n, seed=2, weighted=False).select("type", "src", "dst", "weight")


QUERIES = {
    f.__name__: f
    for f in (
        sssp, scan_adjacency, out_degree, in_neighbors, invert_graph, normalize_weights, symmetrize, inject_loops, sssp_critical_edges, sssp_rebuild,
        widest_path, widest_critical_edges, cc_max_label, cc_min_label, wcc, min_in_edge, pagerank_k, pagerank_power, jacobi_k, markov_k, adsorption_k, katz_k,
        simrank_k, apply_changes, split_changes, incr_sssp, incr_widest, incr_cc, incr_pagerank, pending_filter, top_portion, priority_policies, scheduled_sssp,
        term_report, remembered_best, forget_contributions, upsert_state, accumulate_state, get_state, compare_results, error_stats, different_neighbors,
        weight_histogram, partition_contract, snapshot_restore, generated_graph, generated_changes, scan_unweighted, result_files, result_summary, label_files,
        change_files, critical_files, neighbor_files, part_files, routed_scan, partition_rules, accumulate_sum, priority_accumulative, stop_rules, stop_by_pairs,
        superstep_metrics, power_until, neighbor_labels, sssp_supplies, top_portion_cutoff, remembered_sssp, simrank_pairs_k, streamed_sssp, unfinished_snapshots,
        program_files, scheduled_by_degree, prepared_deltas, generated_uniform, generated_log_normal, random_changes, random_unweighted_changes,
    )
}
