import math
import random
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from deltaweave.llm import mixing, quality

from .helpers import docs, save, table, words


def water_fill(sizes, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(limit * sizes[s])
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def hashed(seed, *parts):
    for x in parts:
        if x is not None:
            seed = xxhash.xxh64(x if isinstance(x, bytes) else struct.pack("<q", x), seed=seed).intdigest()
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, weigh=lambda t: 1.0, limit=3):
    """One row at a time: prefixes in the order of keys, and what is left at their ends."""
    size = lambda t: len(words(t))
    by = Counter()
    for _, t, _, s in rows:
        by[s] += size(t)
    targets = water_fill(by)
    out = []
    for s in by:
        keyed = []
        for i, t, _, own in rows:
            if own == s:
                tie = signed(hashed(42, t.encode() if t is not None else None))
                u = ((hashed(42, b"mix", i, tie) >> 11) + 0.5) / 2**53
                keyed.append(((-math.log(u) / round(max(0.05, weigh(t)), 6), (i is not None, i or 0), tie), size(t), i))
        keyed.sort(key=lambda x: x[0])
        epochs = min(limit, math.floor(targets[s] / by[s])) if by[s] else 0
        gap, after, taken = targets[s] - epochs * by[s], None, set()
        for _ in range(mixing.PASSES if gap > 0 else 0):
            upto, stop = 0, None
            for k, (place, n, _) in enumerate(keyed):
                if n == 0 or n > gap or (after is not None and place <= after):
                    continue
                if stop is None and upto + n <= gap:
                    upto += n
                    taken.add(k)
                else:
                    stop = place if stop is None else stop
            gap -= upto
            after = stop if stop is not None else (math.inf, (), 0)
        least = min(((n, place, k) for k, (place, n, _) in enumerate(keyed) if k not in taken and 0 < n < 2 * gap), default=None)
        if least and epochs < limit:
            taken.add(least[2])
        out += [(i, n, by[s], round(targets[s], 4), (epochs + (k in taken)) * n if n else 0) for k, (_, n, i) in enumerate(keyed)]
    return sorted(out, key=str)


def result(df, **k):
    return sorted(map(tuple, mixing.mix(df, **k).selectExpr("doc_id", "size", "source_size", "round(target, 4)", "taken").collect()), key=str)


def sample_rows():
    rng = random.Random(11)
    sources = ["a", "b", "B", None, "ü", "z"]
    rows = [(i, t, "en", rng.choices(sources, [60, 5, 2, 10, 10, 1])[0]) for i, t in enumerate(docs(rng, 400, most=30))]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "empty"), (1002, "$$$ *** x", "en", "b"), (1003, "w " * 4000, "en", "z")]
    rows += [(None, t, "en", "a") for t in docs(rng, 60, least=1, most=9)]
    return rows


def copies_of(df, **k):
    return Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df, **k).collect())


def test_same_as_brute_force(spark):
    rows = sample_rows()
    got = result(table(spark, rows))
    assert got == brute(rows)
    by_source = Counter()
    for _, _, size, target, taken in got:
        by_source[size, target] += taken
    # the longest document of a source is 4,000 words; nothing else keeps a source from its target
    assert all(abs(taken - target) <= 0.02 * target + 1 for (size, target), taken in by_source.items() if size and size < 4000)
    assert sum(copies_of(table(spark, rows)).values()) == sum(r[4] // r[1] for r in got if r[1])
    copies = Counter(r[0] for r in got for _ in range(r[4] // r[1] if r[1] else 0))
    assert Counter(i for (i, _), n in copies_of(table(spark, rows)).items() for _ in range(n)) == copies


def test_quality_weighs(spark):
    """Weights are the classifier's scores; a document of quality is likelier in the part that is not whole."""
    rng = np.random.default_rng(4)
    x = quality.features(pa.array(["plain words here"] * 200 + ["$$ %% &&"] * 200))
    model = quality.AdditiveModel().fit(x, np.repeat([1.0, 0.0], 200))
    texts = ["plain words here", "$$ %% &&"]
    rows = [(i, texts[i % 2], "en", "big") for i in range(600)] + [(1000 + i, "other text", "en", "small") for i in range(100)]
    weigh = lambda t: float(model.score(quality.features(pa.array([t])))[0])
    got = result(table(spark, rows), model=model)
    assert got == brute(rows, weigh)
    taken = Counter(i % 2 for i, _, _, _, n in got if i < 1000 for _ in range(n // 3))
    assert taken[0] > 1.5 * taken[1] and rng is not None
    assert sum(copies_of(table(spark, rows), model=model).values()) == sum(r[4] // r[1] for r in got)


def test_repeated_rows_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 7)
    rows = [(7, "a b c", "en", "x")] * 80 + [(k, "d e", "en", "y") for k in range(200)] + [(None, "f g", "en", "y")] * 30
    got = result(table(spark, rows))
    assert got == brute(rows)
    want = sum(r[4] // r[1] for r in got)
    target = {r[2]: r[3] for r in got}
    assert abs(sum(r[4] for r in got if r[2] == 240) - target[240]) < 3
    copies = copies_of(table(spark, rows))
    assert sum(copies.values()) == want
    assert copies[7, "a b c"] == sum(r[4] // 3 for r in got if r[0] == 7)


def test_query_as_brute_force(spark, tmp_path):
    rows = sample_rows()
    save(table(spark, rows), tmp_path, "documents")
    save(spark.createDataFrame([(i, i % 3 > 0, 0) for i in range(200)], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int")), tmp_path, "labels")
    df = table(spark, rows)
    model = quality.fit(df, quality.training_labels(spark, str(tmp_path)))
    weigh = lambda t: float(model.score(quality.features(pa.array([t], pa.string())))[0])
    got = mixing.op8_mix_sources(spark, str(tmp_path)).selectExpr("doc_id", "size", "source_size", "round(target, 4)", "taken").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, weigh)


def test_columns_and_empty_tables(spark):
    df = table(spark, [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", "en", None)])
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(table(spark, [])).collect() == [] == mixing.mixed_documents(table(spark, [])).collect()


def test_texts_are_read_once_and_stand_once_in_a_row(spark):
    """The pass that hands out documents holds a text once and goes over all texts once, so that long ones fit."""
    rows = [(k, f"w{k} " * (k % 7 + 1), "en", f"s{k % 3}") for k in range(200)] + [(500 + k, "x y", "en", f"t{k}") for k in range(3)]
    df = table(spark, rows)
    out = mixing.mixed_documents(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    passes = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(passes) == 1
    # what goes to Python: the columns of the table, and no second copy of a text
    assert passes[0].split("(")[1].split(")")[0].count("#") == len(df.columns)
    assert sum(copies_of(df).values()) == sum(r[4] // r[1] for r in brute(rows) if r[1])


def test_rare_sources_stop_at_their_limit():
    assert water_fill({"a": 100, "b": 1}) == {"a": 98.0, "b": 3.0}
