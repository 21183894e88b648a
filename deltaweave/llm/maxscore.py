"""Exact top-k search by MaxScore over integer vectors.

A term is a dimension with the sign that helps: for a positive query component the postings of a
dimension are the vectors with a positive component there, for a negative one those with a negative.
A term's bound is the query component times the largest helpful component of the shard. With the k-th best score
known so far as threshold, terms from the largest bound down are essential until the bounds of the
rest together stay below it; only vectors on essential postings are candidates, and the other terms
are probed for those whose sum so far plus what the rest can add reaches the threshold. The rest adds no more than its bounds, nor
than the product of the lengths of what is left of query and vector, so long vectors alone stay competitive. The threshold rises:
first by the heads of the posting lists, which are in order of impact, and while probing by the candidates that lead.

Vectors are dealt once into shards of a bounded number of bytes, in the narrowest integers that hold them, and stay there;
queries come to them. A query first searches the one shard of its own hash; the k-th score it finds is its threshold in
all other shards. The best k of all shards are merged at the end. The queries are a stated set; nothing is broadcast.

Defined results: vectors that are null, or hold null or non-finite components, take no part; of
queries that repeat a vec_id the one with the smallest vector is asked, while repeated candidates count each; equal scores go by
vec_id; missing dimensions count 0; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plan import cut, dealt_blocks, findable, table

#: Bytes of vectors in a shard; its posting lists take up to twice as many more.
SHARD_BYTES = 32 << 20
#: Terms that are probed between two looks at what is still competitive.
STEP = 8


def _matrix(column: pa.Array, width: int, dtype: np.dtype) -> np.ndarray:
    out = np.zeros((len(column), width), dtype)
    lengths = np.array(pa.compute.list_value_length(column))
    out[np.arange(width)[None, :] < lengths[:, None]] = np.array(column.flatten())
    return out


class Shard:
    """Vectors by column, in order of id, with the posting lists and bounds of both signs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.by_impact = np.argsort(self.columns, axis=1, kind="stable").astype(np.int32)
        self.negative, self.positive = (self.columns < 0).sum(axis=1), (self.columns > 0).sum(axis=1)
        self.most, self.least = (f(axis=1).astype(np.int64) for f in (self.columns.max, self.columns.min))
        self.squares = np.square(self.columns, dtype=np.int64).sum(axis=0)
        #: Vectors that were on essential postings, that were probed to the end, and those there were, over all queries.
        self.candidates = self.finished = self.offered = 0

    def postings(self, term: int, sign: int) -> np.ndarray:
        """Rows with a helpful component, the largest first."""
        if sign > 0:
            return self.by_impact[term, len(self.ids) - self.positive[term] :][::-1]
        return self.by_impact[term, : self.negative[term]]

    def top(self, own: int, query: np.ndarray, k: int, threshold: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best vectors but those with id ``own``; only scores of ``threshold`` or more, if given."""
        query = query.astype(np.int64)
        bounds = np.maximum(0, np.where(query > 0, query * self.most, query * self.least))
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[query[terms] != 0]
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # bound of term j and all after it
        left = np.append(np.cumsum(np.square(query[terms])[::-1])[::-1], 0).astype(float)
        other = self.ids != own
        self.offered += len(self.ids)

        def raised(rows: np.ndarray, threshold: int | None) -> int | None:
            if len(rows) < k:
                return threshold
            found = int(np.sort(query @ self.columns[:, rows].astype(np.int64))[-k])
            return found if threshold is None else max(found, threshold)

        heads = [self.postings(d, query[d])[: 2 * k] for d in terms[:4]]
        if heads:
            heads = np.unique(np.concatenate(heads))
            threshold = raised(heads[other[heads]], threshold)
        essential = int(np.searchsorted(-rest, -threshold, side="right")) if threshold is not None else 0
        if threshold is None or essential > len(terms) or rest[-1] >= threshold:
            alive = np.flatnonzero(other)  # even a vector on no postings could be among the best
        else:
            posted = np.zeros(len(self.ids), bool)
            for d in terms[:essential]:
                posted[self.postings(d, query[d])] = True
                if posted.all():
                    break
            alive = np.flatnonzero(posted & other)
        self.candidates += len(alive)
        score, length = np.zeros(len(alive), np.int64), self.squares[alive]
        for at in range(0, len(terms), STEP):
            for d in terms[at : at + STEP]:
                value = self.columns[d, alive].astype(np.int64)
                score += query[d] * value
                length = length - value * value
            done = min(at + STEP, len(terms))
            if threshold is None or done == len(terms):
                continue
            if len(alive) > 4 * k and done <= 2 * STEP:
                lead = alive[np.argpartition(-score, 2 * k)[: 2 * k]]
                threshold = raised(lead, threshold)
            can = np.minimum(rest[done], np.sqrt(left[done] * length) * (1 + 1e-9) + 1)
            good = score + can >= threshold
            alive, score, length = alive[good], score[good], length[good]
        self.finished += len(alive)
        if threshold is not None:
            alive, score = alive[score >= threshold], score[score >= threshold]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return alive[best], score[best]


def _searched(dealt: DataFrame, k: int, width: int, dtype: str) -> DataFrame:
    """query_id, vec_id, score: the k best of each shard for the queries that came to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        shard = None
        for batch in batches:
            asks = np.array(batch.column(0))
            new = batch.filter(pa.array(asks == 0))
            if new.num_rows:
                if shard is not None:  # another shard in the same partition
                    ids, vectors, shard = [], [], None
                ids.append(np.array(new.column(1)))
                vectors.append(_matrix(new.column(2), width, np.dtype(dtype)))
            queries = batch.filter(pa.array(asks == 1))
            if not queries.num_rows or not ids:
                continue
            if shard is None:
                shard = Shard(np.concatenate(ids), np.concatenate(vectors))
                vectors = []
            found: list[list[np.ndarray]] = [[], [], []]
            for own, query, least in zip(queries.column(1).to_pylist(), _matrix(queries.column(2), width, np.dtype(dtype)), queries.column(3).to_pylist(), strict=True):
                rows, scores = shard.top(own, query, k, least)
                for column, values in zip(found, (np.full(len(rows), own), shard.ids[rows], scores), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    return dealt.sortWithinPartitions("_block", "asks", "vec_id").select("asks", "vec_id", "vector", "least").mapInArrow(
        run, "query_id long, vec_id long, score long"
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best vectors with another id by inner product.

    Both frames have vec_id long and vector array<long>.
    """
    findable(vectors.sparkSession)
    largest = F.greatest(F.max(F.abs(F.array_max("vector"))), F.max(F.abs(F.array_min("vector"))))
    n, width, most = vectors.agg(F.count("*"), F.max(F.size("vector")), largest).first()
    wide, most_asked = queries.agg(F.max(F.size("vector")), largest).first()
    width, most = max(width or 0, wide or 0, 1), max(most or 0, most_asked or 0)
    kind, dtype, bytes_ = next(x for x in (("smallint", "<i2", 2), ("int", "<i4", 4), ("bigint", "<i8", 8)) if most < 1 << (8 * x[2] - 1))
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-n * width * bytes_ // SHARD_BYTES))
    narrow = F.col("vector").cast(f"array<{kind}>").alias("vector")
    none = F.lit(None).cast("long")
    held = vectors.select(F.lit(0).alias("asks"), "vec_id", narrow, none.alias("least"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"))
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.lit(1).alias("asks"), "vec_id", narrow, none.alias("least"))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")

    def search(coming: DataFrame) -> DataFrame:
        return _searched(dealt_blocks(held.unionByName(coming), shards, F.col("shard")).drop("shard"), k, width, dtype)

    first = cut(search(asked.withColumn("shard", home)))
    known = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home))
    rest = search(asked.drop("least").join(known, "vec_id", "left").withColumn("shard", others).select(held.columns)) if shards > 1 else first.limit(0)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector (floor of scale times each component, as a double) of the usable rows."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    )


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
