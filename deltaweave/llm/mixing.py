"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, ``-ln(u) / weight``, where u depends on seed, doc_id and text
and the weight is its quality as the quality classifier scores it. A source whose target is its size e times over and more takes e
complete epochs; the fraction that remains takes documents in the order of their keys as long as the
prefix sum of sizes stays within the budget. What the first document that does not fit leaves open is filled by a
second prefix sum over the smaller documents behind it, and so on (``PASSES`` in all); at last one more document is taken if that brings the
source nearer to its target.

Rows of one doc_id, source and text are counted first and go on as one row with a number, so many repeats are one
row; they are taken one by one at the edge of a prefix. The prefix sums are taken in two levels, so no task holds a source:
keys fall into buckets by ``key / (key + 1)``, bucket totals are summed within a source, and documents within a
bucket. The number of buckets grows with the number of documents. Sources of very many documents are looked up in place.

Defined results: a null text has size 0 and takes no words; null sources are one source, last in
order; documents with equal keys go by doc_id, then by text hash; a source of size 0 has target 0;
equal rows share a key and are taken apart only at an edge; rows of one doc_id with different texts, or of a null doc_id, are sampled
apart; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import lineage
from . import quality
from .plan import cut, drop, table, with_hot_keys
from .text import Words, slices

#: Documents that one bucket of keys should hold at most on average.
BUCKET_ROWS = 100_000
#: Prefix sums of a source, each over what is small enough for the gap that the one before has left.
PASSES = 3
#: Equal rows that are written out by one row of a plan.
SPAN = 10_000
#: The least weight of a document.
LEAST = 0.05
#: Sources whose decisions are all sent to where the documents lie; of more, only those of the large ones.
SENT = 1000


def _measured(docs: DataFrame, model: quality.AdditiveModel | None, text: str = "text", passed: list[str] | None = None) -> DataFrame:
    """The columns ``passed`` of ``docs`` (all, unless given), _size, the number of words of the column ``text``, and _weight, its quality; one pass."""
    at = docs.columns.index(text)
    passed = docs.columns if passed is None else passed
    places = [docs.columns.index(c) for c in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, quality.SLICE):
                words = Words(part.column(at), lower=False)
                scores = model.score(quality.features(part.column(at), words)) if model else np.ones(part.num_rows)
                columns = [*(part.column(k) for k in places), pa.array(words.counts(), pa.int64()), pa.array(np.round(np.maximum(LEAST, scores), 6))]
                yield pa.RecordBatch.from_arrays(columns, [*passed, "_size", "_weight"])

    layout = T.StructType([*(docs.schema[c] for c in passed), T.StructField("_size", T.LongType()), T.StructField("_weight", T.DoubleType())])
    return docs.mapInArrow(run, layout)


def uniform(seed: str, *keys: str) -> Column:
    """In (0, 1), by a hash of the seed and the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _named(source: str = "source") -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """All columns of ``sizes`` (source, source_size) and target: shares of the whole size by weights that
    repeat along the sources in code point order (null last), no target above ``limit`` times its size.

    Water filling: sources in order of limit per weight reach their limits first; the first k that do
    are found by prefix sums. One row per source goes through this.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(w) for w in weights])
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    full = (
        sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * limit).cast("double"))
        .withColumn("whole", F.sum("source_size").over(everything))
        .withColumn("caps", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("whole") - F.coalesce("caps", F.lit(0.0))) / F.col("rest"))
        # the first source that stays below its limit at the level of those before it
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("fits"), F.col("level"))).over(everything), F.lit(0.0)))
    )
    # the level rises up to the first source that fits and falls behind it, so the largest that fits is the first
    return full.select(*sizes.columns, F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _place() -> Column:
    return F.struct(F.col("key"), F.col("doc_id"), F.col("tie"))


def _extra() -> Column:
    """How many rows of a group the prefixes of its source take beyond complete epochs; columns of the group (key,
    doc_id, tie, size, n) and of the decision (passes, one)."""
    within = lambda p: (
        F.when((F.col("size") > 0) & (F.col("size") <= p["gap"]) & F.coalesce(_place() > p["after"], F.lit(True)) & (_place() <= p["last"]), F.when(_place() == p["last"], p["taken"]).otherwise(F.col("n")))
        .otherwise(F.lit(0))
        .cast("long")
    )
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda so_far, p: so_far + F.coalesce(within(p), F.lit(0).cast("long")))
    return taken + F.coalesce(_place() == F.col("one"), F.lit(False)).cast("long")


def decide(docs: DataFrame, weights: tuple[int, ...], limit: int, seed: str, model: quality.AdditiveModel | None) -> tuple[DataFrame, DataFrame, int]:
    """(groups, decisions, number of rows): equal documents (doc_id, source, tie, n, size, key, s), and per source what
    is taken of it (s, source_size, target, epochs, passes, one, rows)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.xxhash64("text").alias("tie"))
    groups, facts = lineage.cut(
        _measured(slim, model, passed=["doc_id", "source", "tie"])
        .groupBy("doc_id", "source", "tie")
        .agg(F.count("*").alias("n"), F.max("_size").alias("size"), F.max("_weight").alias("weight"))
        .select("doc_id", "source", "tie", "n", "size", (-F.log(uniform(seed, "doc_id", "tie")) / F.col("weight")).alias("key"), _named().alias("s")),
        rows=F.sum("n"),
        groups=F.count(F.lit(1)),
    )
    total = facts["rows"] or 0
    buckets = max(256, -(-(facts["groups"] or 0) // BUCKET_ROWS))
    sizes = groups.groupBy("s").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    state = cut(
        targets(sizes, weights, limit)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(0).cast("long"))
        .withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("after", F.lit(None).cast("struct<key:double,doc_id:long,tie:long>"))
        .withColumn("passes", F.array().cast("array<struct<after:struct<key:double,doc_id:long,tie:long>,gap:double,last:struct<key:double,doc_id:long,tie:long>,taken:long,n:long>>"))
    )
    for _ in range(PASSES):
        open_ = with_hot_keys(groups.drop("source"), state.where("gap > 0 and source_size > 0").select("s", "gap", "after", "rows"), ["s"], "rows", total)
        fitting = open_.where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.coalesce(_place() > F.col("after"), F.lit(True)))
        keyed = fitting.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1) * buckets).cast("long")).withColumn("all", F.col("size") * F.col("n"))
        by_bucket = keyed.groupBy("s", "bucket").agg(F.sum("all").alias("bucket_size"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).select("s", "bucket", "offset")
        within = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
        summed = keyed.withColumn("before", F.coalesce(F.sum("all").over(within), F.lit(0))).join(offsets, ["s", "bucket"]).withColumn("before", F.col("before") + F.col("offset"))
        taken = summed.withColumn("taken", F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("gap") - F.col("before")) / F.col("size")))).cast("long"))
        found = taken.groupBy("s").agg(
            F.sum(F.col("taken") * F.col("size")).alias("words"),
            F.max_by(F.struct(_place().alias("last"), "taken", "n"), F.when(F.col("taken") > 0, _place())).alias("edge"),
            F.min(F.when(F.col("taken") < F.col("n"), _place())).alias("stop"),
        )
        step = F.struct("after", "gap", F.col("edge.last").alias("last"), F.col("edge.taken").alias("taken"), F.col("edge.n").alias("n"))
        after = cut(
            state.join(found, "s", "left").select(
                "s", "source", "source_size", "rows", "target", "epochs",
                (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"),
                # without a group that did not fit, nothing is left behind the prefix
                F.when(F.col("stop").isNotNull(), F.col("stop")).when(F.col("edge").isNotNull(), F.struct(F.lit(float("inf")).alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tie"))).otherwise(F.col("after")).alias("after"),
                F.when(F.col("edge").isNotNull(), F.array_append("passes", step)).otherwise(F.col("passes")).alias("passes"),
            )
        )
        drop(state)
        state = after
    # one document more where that is nearer: the smallest that still has a row to give
    open_ = with_hot_keys(groups.drop("source"), state.where(f"gap > 0 and epochs < {limit}").select("s", "gap", "passes", F.lit(None).cast("struct<key:double,doc_id:long,tie:long>").alias("one"), "rows"), ["s"], "rows", total)
    least = open_.where((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & (_extra() < F.col("n"))).groupBy("s").agg(F.min_by(_place(), F.struct("size", _place())).alias("one"))
    decisions = cut(state.join(least, "s", "left").select("s", "source_size", "target", "epochs", "passes", "one", "rows"))
    drop(state)
    return groups, decisions, total


def _times(rows: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times, numbered from 1 in ``_nth``; very many repeats are dealt to several tasks."""
    few = rows.where(n <= SPAN).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))))
    parts = rows.where(n > SPAN).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / SPAN).cast("long")))).repartition("doc_id", "tie", "_part")
    many = parts.withColumn("_nth", F.explode(F.sequence(F.col("_part") * SPAN + 1, F.least(n.cast("long"), (F.col("_part") + 1) * SPAN)))).drop("_part")
    return few.unionByName(many)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: str = "mix", model: quality.AdditiveModel | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often it is taken) and taken (copies times size) per document.

    ``model`` scores the quality that weighs documents; without one all weigh the same.
    """
    groups, decisions, total = decide(docs, weights, limit, seed, model)
    joined = with_hot_keys(groups, decisions, ["s"], "rows", total).withColumn("extra", _extra())
    one = _times(joined.select("doc_id", "source", "tie", "n", "size", "source_size", "target", "epochs", "extra"), F.col("n"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("_nth") <= F.col("extra")).cast("long")).otherwise(0).cast("long")
    return one.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: str = "mix", model: quality.AdditiveModel | None = None) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them; same columns.

    A source's decision is its number of epochs and the edges of its prefixes, so texts need no shuffle: these few values per
    source meet the documents where they lie. Each text goes through the scorer once more, and stands once in a row. Only where
    an edge parts equal rows are those rows numbered; few groups have one, and these are known before the texts are read.
    """
    groups, decisions, total = decide(docs, weights, limit, seed, model)
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text, doc, s = names["text"], F.col(names["doc_id"]).cast("long"), _named(names["source"])
    # of several equal rows, an edge takes some, or one more is taken
    parting = F.exists("passes", lambda p: (_place() == p["last"]) & (p["taken"] < p["n"])) | F.coalesce(_place() == F.col("one"), F.lit(False))
    parted, found = lineage.cut(
        with_hot_keys(groups.where("n > 1").drop("source"), decisions, ["s"], "rows", total)
        .where(F.coalesce(parting, F.lit(False)))
        .select(F.col("s").alias("_s"), F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "epochs", _extra().alias("extra")),
        n=F.count(F.lit(1)),
    )
    same = (F.col("_s") == s) & F.col("_doc").eqNullSafe(doc) & (F.col("_tie") == F.xxhash64(text))
    rows = _measured(renamed.join(parted, same, "left_anti") if found["n"] else renamed, model, text)
    rows = rows.withColumns({"doc_id": doc, "tie": F.xxhash64(text), "size": F.col("_size"), "n": F.lit(1).cast("long"), "s": s})
    rows = rows.withColumn("key", -F.log(uniform(seed, "doc_id", "tie")) / F.col("_weight")).drop("_size", "_weight").where("size > 0")
    joined = rows.join(F.broadcast(decisions), ["s"]) if decisions.count() <= SENT else with_hot_keys(rows, decisions, ["s"], "rows", total)
    whole = F.transform("passes", lambda p: F.struct(p["after"].alias("after"), p["gap"].alias("gap"), p["last"].alias("last"), F.lit(1).cast("long").alias("taken"), p["n"].alias("n")))
    out = joined.withColumn("passes", whole).select(*names.values(), (F.col("epochs") + _extra()).alias("_copies"))
    if found["n"]:
        equal = Window.partitionBy("_s", "_doc", "_tie").orderBy(F.to_json(F.struct(*[n for c, n in names.items() if c != "text"])))
        edge = renamed.join(parted, same).withColumn("_copies", F.col("epochs") + (F.row_number().over(equal) <= F.col("extra")).cast("long"))
        out = out.unionByName(edge.select(*names.values(), "_copies"))
    out = out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.training_labels(spark, sf_dir))
    return mix(docs, model=model).select("doc_id", "size", "source_size", "target", "taken")
