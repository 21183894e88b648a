import random

import numpy as np

from deltaweave.llm import lines

from .helpers import lower, table

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: lower(x.strip(BLANK))
    owners = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                owners.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if i is None or not (len(owners.get(key(x), ())) > 1 and min(owners[key(x)]) != i)]
        out.append((i, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    pool = [f"this is common line {k}" for k in range(12)] + ["short", "", "  ", "tenchars10", "ninechars", "É" * 10, "é" * 9, "a\rb\x0bcdefghijk"]
    rows = [(i, "\n".join(rng.choice(["{}", " {} ", "{}\r"]).format(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "THIS IS COMMON LINE 3"), (None, "this is common line 1\nthis is common line 1"), (7, "this is common line 2"), (203, "\n" * 5000 + "x" * 100_000)]
    rows += [(204, " " * 3000 + "this is common line 4" + "\t" * 3000), (205, "y" * 3_000_000 + "\nsecond of a long text"), (206, "y" * 3_000_000), (207, "\n"), (208, "é" * 10 + "\n" + "é" * 9)]
    rng.shuffle(rows)
    got = lines.dedup_lines(table(spark, rows), fanout=3).select("_row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_documents_keep_their_columns(spark):
    df = table(spark, [(2, "the same old line\nx"), (1, "the same old line")])
    out = lines.without_repeated_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in out.collect()}
    assert got == {1: ("the same old line", 17, "x"), 2: ("x", 1, "x")}


def test_empty_table(spark):
    assert lines.dedup_lines(table(spark, [])).collect() == []


def test_runs_know_what_was_added():
    rng = np.random.default_rng(2)
    runs, seen = lines.Runs(fanout=3), set()
    for _ in range(40):
        keys = np.zeros(50, [("hi", np.uint64), ("lo", np.uint64)])
        keys["hi"], keys["lo"] = rng.integers(0, 30, 50), rng.integers(0, 30, 50)
        keys = np.unique(keys)
        known = runs.known(keys)
        assert known.tolist() == [tuple(k) in seen for k in keys.tolist()]
        runs.add(keys[~known])
        seen |= set(map(tuple, keys.tolist()))
    assert all(len(level) < 3 for level in runs.levels)
    assert sum(len(r) for level in runs.levels for r in level) == len(seen)
