import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.llm import langid, lm, pieces, quality
from deltaweave.llm.plan import bucketed

from .helpers import docs, save, table, words
from .sql_counts import OP6_COUNTS

ODD = [(900, None), (901, ""), (902, " \n\t"), (None, "aa bb"), (903, "w1 w1 W1 brandnew é"), (903, "w1"), (904, "z" * 20_000)]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_lm_counts_and_probabilities(spark):
    rng = random.Random(4)
    rows = list(enumerate(docs(rng, 120, vocabulary=90))) + ODD
    out = {(r.doc_id, r.n_tokens): r for r in lm.lm_scores(table(spark, rows), bucketed(F.col("doc_id"), 7, 2)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if i is not None and not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*words(t), None]
        r = out[i, len(tokens)]
        assert (r.held_out, r.train_tokens, r.n_known) == (i is not None and held(i), n, sum(x in counts for x in tokens))
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), abs_tol=1e-6)
        assert r.score < 0
    # the lattice prefers words made like those it learned
    assert out[901, 1].score == out[900, 1].score
    assert lm.lm_scores(table(spark, []), F.lit(False)).collect() == []


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_lm_score_by_hand(spark):
    rows = [(k, "ab ab cd") for k in range(6)] + [(50, "ab zz")]
    got = {r.doc_id: r for r in lm.lm_scores(table(spark, rows), F.col("doc_id") == 50).collect()}
    v, end = lm.lattice_model()
    want = sum(map(math.log10, (chance(x, Counter({"ab": 12, "cd": 6, None: 6}), v, end) for x in ("ab", "zz", None))))
    assert math.isclose(got[50].score, want, abs_tol=1e-9)


def segmentations(word, v):
    """Summed weight of all ways to spell the marked word, piece by piece and byte by byte."""
    if not hasattr(v, "by_text"):
        v.by_text = {v.spelled[i].decode("utf-8", "replace"): math.exp(v.scores[i]) for i in v.ids.tolist()}
    weight, by_bytes = v.by_text, [math.exp(v.scores[i]) for i in v.byte_ids.tolist()]
    text = " " + word
    total = [1.0] + [0.0] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - v.longest), e):
            part = text[s:e]
            p = weight.get(part, 0.0)
            if e - s == 1 and part not in weight:
                p = math.prod(by_bytes[b] for b in part.encode())
            total[e] += total[s] * p
    return total[-1]


def chance(token, counts, v, end):
    spelt = math.exp(end) if token is None else segmentations(token, v)
    return ((counts[token] + 1 if counts[token] else 0) + spelt) / (sum(counts.values()) + len(counts) + 1)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_lm_query_by_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(14)
    rows = list(enumerate(docs(rng, 60, vocabulary=40, least=1, most=20))) + [(100, None), (101, ""), (102, "Ünseen wörds 日本 stay proper"), (103, "w1 " * 300)]
    save(table(spark, rows), tmp_path, "documents")
    got = {r.doc_id: r for r in lm.op6_lm_scores(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = {r[0]: r[1:] for r in con.execute(OP6_COUNTS).fetchall()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in rows if i not in held for w in [*words(t), None])
    v, end = lm.lattice_model()
    spelt = {}
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, *sql[i][:3])
        assert math.isclose(r.base_score, sql[i][3], abs_tol=1e-6)
        tokens = [*words(t), None]
        logs = [spelt.setdefault(x, math.log10(chance(x, counts, v, end))) for x in tokens]
        assert math.isclose(r.score, sum(logs), abs_tol=1e-6)
        alone = sum(math.log10(math.exp(end) if x is None else segmentations(x, v)) for x in tokens)
        assert math.isclose(r.lattice_score, alone, abs_tol=1e-6)
        if r.n_known == r.n_tokens:
            assert r.score >= r.base_score
    assert any(r.held_out and r.n_known == r.n_tokens for r in got.values())


def test_letters_of_all_planes():
    text = "".join(map(chr, range(0x30000, 0x30010)))
    grams, of, has_letter = langid.ngrams(__import__("pyarrow").array([text, chr(0x31350), chr(0x10FFFF)]), langid.BUCKETS, langid.LONGEST)
    assert has_letter.tolist() == [True, True, False]
    assert len(set(grams[: of[1]].tolist()) - {0}) > 40


def languages(rng):
    rows = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        letters = "abcdef" if lang == "aa" else "defghi"
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12)), lang))
    return rows


def test_language_id(spark):
    rows = languages(random.Random(5)) + [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", None), (None, "abc", "aa"), (903, "abcdef", None)]
    df = table(spark, rows).withColumn("held_out", F.col("doc_id") % 4 == 2)
    langs, matrix = langid.learn(df.where("not held_out"))
    assert langs == ["aa", "bb"]
    out = {r.doc_id: r for r in langid.predict(df, langs, matrix).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows[:200] if i % 4 == 2]) == 1.0
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[901].score == 0.0
    assert all(0 <= r.score <= 1 for r in out.values())
    # one text by hand
    grams, of, _ = langid.ngrams(__import__("pyarrow").array(["abcdef"]), langid.BUCKETS, langid.LONGEST)
    logs = matrix[0] + matrix[grams[grams > 0]].sum(axis=0)
    assert math.isclose(out[903].score, 1 / np.exp(logs - logs.max()).sum(), rel_tol=1e-4)
    assert langid.predict(table(spark, []).withColumn("held_out", F.lit(False)), langs, matrix).collect() == []
    nothing = langid.learn(table(spark, []))
    assert {r.lang_pred for r in langid.predict(df, *nothing).collect()} == {"und"}


def test_language_counts_are_exact(spark):
    rows = languages(random.Random(6))[:20]
    _, matrix = langid.learn(table(spark, rows).repartition(5), buckets=101)
    import pyarrow as pa

    for k, lang in enumerate(("aa", "bb")):
        counts = np.zeros(102)
        for _, t, own in rows:
            if own == lang:
                counts += np.bincount(langid.ngrams(pa.array([t]), 101, langid.LONGEST)[0], minlength=102)
        want = np.log((counts[1:] + 0.5) / (counts[1:].sum() + 0.5 * 101))
        assert np.allclose(matrix[1:, k], want) and math.isclose(matrix[0, k], math.log(10))


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join(("$$x%%" if bad and rng.random() < 0.7 else rng.choice(["good", "plain", "words", "here"])) for _ in range(30))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    labels += [(5000, 1), (None, 0), (3, None), (4, 7), (6, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, label int")
    df = table(spark, [*rows, (900, None), (901, ""), (None, "x"), (902, "y " * 50_000)])
    model = quality.fit(df, lab.where("doc_id % 5 <> 0 or doc_id is null"))
    out = {r.doc_id: r.score for r in quality.scores(df, model).collect()}
    assert len(out) == 404 and out[900] == out[901] and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.3) == (i % 3 != 0) for i in range(0, 400, 5)]) > 0.97
    kept = quality.keep_scored(df, model, 0.3)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in out.items() if s >= 0.3}
    none = quality.fit(df, lab.limit(0))
    assert {round(r.score, 6) for r in quality.scores(df, none).collect()} == {0.5}
    assert quality.scores(table(spark, []), model).collect() == []
    small = quality.fit(df, lab, sample=100)
    assert small.tables


def test_tables_learn_interactions():
    rng = np.random.default_rng(8)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(pair_rounds=60).fit(x, y)
    assert model.pairs[0][:2] == (1, 0)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
