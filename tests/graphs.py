"""Hand-checked and random graphs, with plain versions of the programs."""

import heapq
import random

TRI = [(0, 1, 2.0), (1, 2, 2.0), (0, 2, 5.0), (2, 0, 1.0)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight double")


def random_edges(seed, n=25, m=70):
    rng = random.Random(seed)
    return sorted({(a, b): (a, b, float(rng.randint(1, 9))) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}.values())


def ids(edges):
    return sorted({x for e in edges for x in e[:2]})


def dijkstra(edges, source):
    out, done = {}, {source: 0.0}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    heap = [(0.0, source)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > done.get(a, float("inf")):
            continue
        for b, w in out.get(a, ()):
            if d + w < done.get(b, float("inf")):
                done[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return {k: done.get(k, float("inf")) for k in ids(edges)}


def relax(edges, value, step, best):
    value, moved = dict(value), True
    while moved:
        moved = False
        for a, b, w in edges:
            new = best(value[b], step(value[a], w))
            if new != value[b]:
                value[b], moved = new, True
    return value


def widest(edges, source):
    return relax(edges, {k: float("inf") if k == source else 0.0 for k in ids(edges)}, min, max)


def labels(edges):
    return relax(edges, {k: float(k) for k in ids(edges)}, lambda v, w: v, max)


def pagerank(edges, rounds=300):
    degree = {}
    for a, _, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    value = dict.fromkeys(ids(edges), 0.2)
    for _ in range(rounds):
        new = dict.fromkeys(value, 0.2)
        for a, b, _ in edges:
            new[b] += 0.8 * value[a] / degree[a]
        value = new
    return value
