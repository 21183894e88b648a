import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from deltaweave.llm import pieces, plan, quality  # noqa: E402

from .helpers import docs, save, table  # noqa: E402
from .test_lines import brute as brute_lines  # noqa: E402
from .test_minhash import brute as brute_near  # noqa: E402
from .test_mixing import brute as brute_mix  # noqa: E402


def test_stages_do_as_their_operators(spark, tmp_path):
    rng = random.Random(12)
    texts = docs(rng, 60, vocabulary=500, least=20, most=60)
    texts += [texts[3] + " tail", texts[4], "\n".join(["a repeated boilerplate line", texts[5]]), "\n".join(["a repeated boilerplate line", texts[6]])]
    texts += ["$$%% ##&& " * 12 + str(k) for k in range(30)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    save(table(spark, rows), tmp_path, "documents")
    labels = [(i, 0 if t and "$$" in t else 1, 0) for i, (_, t, _, _) in enumerate(rows)]
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    d, df = str(tmp_path), table(spark, rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, df, d)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(range(64)) and not ids & set(range(64, 94))
    lined = stage["line dedup"](spark, kept, d)
    now = sorted((r.doc_id, r.text) for r in lined.collect())
    assert now == [(i, t) for i, _, _, t in brute_lines([r[:2] for r in rows if r[0] in ids])] or dict(now) == {i: t for i, _, _, t in brute_lines([r[:2] for r in rows if r[0] in ids])}
    one = stage["minhash near-dedup"](spark, lined, d)
    assert one.columns == df.columns
    assert {r.doc_id for r in one.collect()} == {i for i, x in brute_near(now, 5, 80).items() if x[2]}
    mixed = stage["source mixing"](spark, one, d)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    model = quality.fit(df, quality.training_labels(spark, d))
    weigh = lambda t: float(model.score(quality.features(pa.array([t], pa.string())))[0])
    took = Counter({r[0]: r[4] // r[1] for r in brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in one.collect()], weigh) if r[4]})
    assert Counter(r.doc_id for r in mixed.collect()) == took
    whole = corpus_pipeline.run(spark, d).collect()
    assert Counter(r.doc_id for r in whole) == took
    texts = {r.doc_id: r.text for r in one.collect()}
    decoder = pieces.Decoder(pieces.vocabulary_of(pieces.MODEL, ranks=True))
    for r in whole:
        assert decoder.texts(np.array(r.pieces), np.array([0, len(r.pieces)]))[0].decode() == texts[r.doc_id]
    # encoded as the library's unigram search would, up to ties of the score
    flat, offsets = pieces.encode_column(pa.array([texts[r.doc_id] for r in whole]), pieces.vocabulary_of(pieces.MODEL, ranks=True))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [r.pieces for r in whole]


def test_null_ids_and_repeated_rows(spark, tmp_path):
    rng = random.Random(13)
    texts = docs(rng, 30, vocabulary=300, least=20, most=40)
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s1"), (3, texts[3], "en", "s1"), (None, texts[4], "en", "s0"), (None, "a text without an id that is its own", "en", None), (40, None, "en", None), (41, "", "en", "s0")]
    save(table(spark, rows), tmp_path, "documents")
    save(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    d, now = str(tmp_path), table(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, d)
        assert now.columns == table(spark, rows).columns
    left = Counter((r.doc_id, r.text) for r in now.collect())
    assert left[3, texts[3]] == 1 and sum(n for (i, _), n in left.items() if i is None) == 2 and left[40, None] + left[40, ""] == 1
    mixed = corpus_pipeline.mix_stage(spark, now, d)
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(copies) <= set(left) and max(copies.values()) <= 3 and not any(i in (40, 41) for i, _ in copies)
    encoded = corpus_pipeline.run(spark, d).collect()
    assert sum(copies.values()) == len(encoded)


def test_empty_table(spark, tmp_path):
    save(table(spark, []), tmp_path, "documents")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_batches_are_bounded(spark):
    """A stage's rows go to Python workers in batches of a few MB; a session's own bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat('some words ', 400) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    spark.conf.unset(name)
    try:
        assert corpus_pipeline.encode_stage(spark, df, "").count() == 3000
        assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) < 2 * plan.BATCH_BYTES
        spark.conf.set(name, "12345678")
        corpus_pipeline.encode_stage(spark, df, "")
        assert spark.conf.get(name) == "12345678"
    finally:
        spark.conf.unset(name)
