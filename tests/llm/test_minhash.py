import random

import numpy as np

from deltaweave.llm import minhash
from deltaweave.llm.plan import components

from .helpers import docs, lower, table, words


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    texts = docs(rng, 60, vocabulary=4000, least=5, most=80)
    base = " ".join(f"b{k}" for k in range(120))
    texts += near_copies(rng, base, 80, 6) + [base] * 5 + [texts[0].upper(), texts[1] + "\n", "", None, " \t\n", "one two", "One  two", "x"]
    long = " ".join(f"l{k % 977}{k}" for k in range(30_000))
    texts += [long, long + " tail"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows), width, 80).collect()}
        assert got == brute(rows, width, 80)


def test_null_ids_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(table(spark, rows), 4, 80).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (2, 3, 1, False), (None, 0, None, True)], key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(table(spark, []), 4).collect() == []


def test_chunked_lists_and_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_CHUNK", 8)
    monkeypatch.setattr(minhash, "LIST_PIVOTS", 2)
    monkeypatch.setattr(minhash, "SET_MEMBERS", 8)
    monkeypatch.setattr(minhash, "SET_PIVOTS", 2)
    rng = random.Random(9)
    base = " ".join(f"b{k}" for k in range(100))
    rows = list(enumerate(near_copies(rng, base, 60, 5)))
    # a chain of texts, each near the next alone, and two groups in one template
    chain = [f"c{k}" for k in range(200)]
    rows += [(1000 + k, " ".join(chain[9 * k : 9 * k + 100])) for k in range(11)]
    template = " ".join(f"t{k}" for k in range(60))
    rows += [(2000 + k, f"{template} " + " ".join(f"{'xy'[k % 2]}{j}" for j in range(40)) + f" z{k}") for k in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), 4, 80).collect()}
    assert got == {i: x[1] for i, x in brute(rows, 4, 80).items()}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    m = minhash._multipliers(1024)
    a, b = minhash.signature(pool[:2000], m), minhash.signature(pool[1000:], m)
    assert abs((a == b).mean() - 1000 / 3000) < 0.06
    # strangers do not meet, however large their sets
    big = [minhash.signature(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64), m) >> np.uint64(32) for _ in range(40)]
    assert len(np.unique(np.concatenate(big))) == 40 * 1024


def test_rows_grow_with_members(spark, monkeypatch):
    """Near copies of one text: what is dealt to tasks that compare is linear in their number."""
    monkeypatch.setattr(minhash, "LIST_CHUNK", 256)
    monkeypatch.setattr(minhash, "LIST_PIVOTS", 16)
    monkeypatch.setattr(minhash, "SET_MEMBERS", 256)
    monkeypatch.setattr(minhash, "SET_PIVOTS", 16)
    rows: dict[str, int] = {}
    kept = minhash._with_pivots, minhash._apart

    def counting(name, f):
        def run(*a):
            out = f(*a)
            rows[name] = rows.get(name, 0) + out.count()
            return out

        return run

    monkeypatch.setattr(minhash, "_with_pivots", counting("pivots", kept[0]))
    monkeypatch.setattr(minhash, "_apart", counting("apart", kept[1]))
    rng = random.Random(10)
    base = " ".join(f"b{k}" for k in range(100))
    per_member = []
    for n in (600, 2400):
        rows.clear()
        texts = near_copies(rng, base, n, 5)
        got = minhash.near_duplicates(table(spark, list(enumerate([base, *texts]))), 4, 80).collect()
        per_member.append(sum(rows.values()) / n)
        # three edits or more are below the threshold to everything
        assert 0.3 * n < sum(r.component_id == 0 for r in got) < 0.8 * n
    assert per_member[1] < 1.25 * per_member[0], per_member


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)}


def test_lower_is_ascii_only():
    assert lower("ÀÉA") == "ÀÉa"


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "g h"), (3, "g h i"), (None, "a b c d e f"), (None, "a b c d e f"), (4, None), (4, "")]
    df = table(spark, rows)
    out = minhash.without_near_duplicates(df, 5, 80)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(1, "a b c d e f"), (3, "g h"), (None, "a b c d e f"), (None, "a b c d e f"), (4, None)], key=str
    )


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Whatever the size of the tables: ids are sent to the texts, and only texts of members of linked groups are shuffled."""
    rng = random.Random(31)
    texts = docs(rng, 40, vocabulary=500, least=20, most=40)
    rows = [*enumerate([*texts, *(t + " end" for t in texts[:9]), *texts[:3]])]
    df = table(spark, rows)
    plans, write = [], minhash.lineage.cut

    def spy(frame, **metrics):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame, **metrics)

    monkeypatch.setattr(minhash.lineage, "cut", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that the planner finds too large
    try:
        left = minhash.without_near_duplicates(df)
        last = left._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in last and "SortMergeJoin" not in last and "Exchange hashpartitioning" not in last
        shingled = [p for p in plans if "shingled" in p]
        assert len(shingled) == 1 and "LeftSemi" in shingled[0]
        assert {r.doc_id for r in left.collect()} == {i for i, x in brute(rows, 5, 80).items() if x[2]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(minhash, "SENT_MEMBERS", 0)  # more ids than are sent: the same documents
    assert {r.doc_id for r in minhash.without_near_duplicates(df).collect()} == {r.doc_id for r in left.collect()}
