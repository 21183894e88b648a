import hashlib
import random
from collections import Counter

import numpy as np

from deltaweave.llm import fingerprint as fp

from .helpers import docs, save, table, words


def jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def test_collisions_are_generalised_jaccard():
    rng = random.Random(2)
    texts = docs(rng, 40, vocabulary=25, least=5, most=60)
    prints = fp.fingerprints(texts, 1024)
    gaps = [(prints[i] == prints[i + 1]).mean() - jaccard(texts[i], texts[i + 1]) for i in range(39)]
    assert max(map(abs, gaps)) < 0.07 and abs(np.mean(gaps)) < 0.012


def test_edits_and_neighbours(spark):
    rng = random.Random(3)
    texts = docs(rng, 80, vocabulary=40, least=0, most=50) + ["", None, "é😀 a", "a" * 50_000, "same text here", "same text here"]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    got = {r.doc_id: r for r in fp.fingerprint_documents(table(spark, rows), 64).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == [x.astype(">u2").tobytes().hex() for x in fp.fingerprints([t, changed], 64)]
        assert abs(r.near_edited - jaccard(t, changed)) < 0.35 and abs(r.near_next - jaccard(t, after)) < 0.35


def test_null_and_repeated_ids_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(None, f"null {k} " + t) for k, t in enumerate(docs(rng, 40, most=10))] + [(7, "one text that is repeated")] * 40 + [(7, "another")] + [(k, f"t {k}") for k in range(20, 30)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = fp.fingerprint_documents(table(spark, rows), 64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 40
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 2 and sum(r.near_next == 1.0 and r.doc_id == 7 for r in got) >= 38
    by = {r.doc_id: r for r in got}
    wrap = "t 29"[: 4 - 2] + "nu"  # the next of the last is the first, one without an id
    assert by[29].edited_sha256 == hashlib.sha256(wrap.encode()).hexdigest()


def test_draws_stay_inside():
    bits = np.array([0, 1, 0xFFFFFFFF, 0xFFFFFE00], np.uint32)
    assert ((fp._uniform(bits) > 0) & (fp._uniform(bits) < 1)).all()


def test_query_digests(spark, tmp_path):
    texts = ["", None, "ab", "abc", "é😀 a b", "word " * 3000]
    rows = list(zip((9, 4, 11, 2, 30, 8), texts))
    save(table(spark, rows), tmp_path, "documents")
    got = {r.doc_id: r for r in fp.op4_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert len(got[i].fingerprint) == len(got[i].edited_fingerprint) == 512


def test_few_rows(spark):
    assert fp.fingerprint_documents(table(spark, [])).collect() == []
    (one,) = fp.fingerprint_documents(table(spark, [(5, "a b")])).collect()
    assert one.near_next == 1.0 and one.n_chars == 3
    got = fp.fingerprint_documents(table(spark, [(None, "b"), (1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 1), (False, 1), (True, 0), (True, 1)]
