"""Near-duplicate documents by MinHash and a signature-coordinate inverted join.

1. One pass over the texts makes, per document, its distinct word shingles (64-bit hashes), a
   128-bit key of the whole set and one token per signature coordinate: 64 mixed bits of the
   coordinate and its minimum.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Each class is posted under its tokens. A pair of classes that agrees in ``match`` coordinates
   or more must agree in one of the ``coordinates - match + 1`` rarest of either (prefix), so only
   these are joined; tokens of one class alone are dropped before any join.
4. Posting lists are merged: a task counts the collisions of the members' signatures and keeps the
   pairs with ``match`` or more, skipping members that are together already. What remains of a list are links of a
   spanning forest, never all pairs. A long list is cut into chunks that each get some members of
   the list as pivots besides; only members that these leave apart from the list's largest group meet the
   rest of the list, chunk by chunk.
5. The members of linked groups are shingled once more, into a table of sets, and links are confirmed
   exactly: a blocked sparse product gives all intersection sizes of a group; a spanning forest of the
   confirmed links leaves the task. In a large group a member whose shingles are mostly its own can have no
   link at all (an exact bound) and is left out; the rest is cut into chunks, with some members that have few shingles
   of their own as pivots; only members that are still apart from the largest class meet the others.

So rows grow with the members of a list or group, except for members that stay apart from its largest
class although they share most of their shingles with others: these are compared with all.

A pair at the similarity threshold misses the match threshold with a probability of about 4e-6
at the defaults (64 coordinates, 36 matches, 0.8), and pairs above it with less.

Defined results: null or blank texts have no shingles and are linked with nothing; a row with a
null ``doc_id`` keeps a null component and is kept; repeated rows give repeated results; rows of one ``doc_id`` with
different texts are one document that has the links of all; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import lineage
from .plan import components, cut, drop, partitions, shuffles_removed, table, with_hot_keys
from .text import mix64, shingle_sets, slices

COORDINATES, MATCH = 64, 36
#: Members of a posting list that one task compares at a time, and the pivots that every chunk of a longer list gets.
LIST_CHUNK, LIST_PIVOTS = 2048, 128
#: Shingles and members that one task confirms, and the pivots that every chunk of a larger group gets.
SET_CHUNK, SET_MEMBERS, SET_PIVOTS = 2_000_000, 256, 32
#: Ids (of members of linked groups, of documents that go) that are sent to all texts, so that these, or the texts of others, are not
#: shuffled. With more ids, all texts are.
SENT_MEMBERS = 1_000_000


def _multipliers(coordinates: int) -> np.ndarray:
    rng = np.random.default_rng(8191)
    return rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each coordinate a token: the smallest product over the set, mixed with the coordinate.

    Minima crowd near zero, so they are mixed before any of their bits are compared.
    """
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, at : at + 1024] * multipliers[:, None]).min(axis=1), out=least)
    return mix64(mix64(least) + np.arange(1, len(least) + 1, dtype=np.uint64))


def sketch(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key (k1, k2) of the set, and its tokens, packed (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(coordinates)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1), width)
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                tokens = [_packed(signature(s, multipliers)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(tokens, pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, tokens binary"
    )


def _packed(tokens: np.ndarray) -> bytes:
    """The upper halves of all tokens, which are compared along the lists, before the lower ones."""
    return tokens.view(np.uint32).reshape(-1, 2).T[::-1].tobytes()


def _unpacked(column: pa.Array, coordinates: int) -> np.ndarray:
    """Tokens (int64, one row per class) of a column of packed ones."""
    halves = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, 2, coordinates)
    return (halves[:, 0].astype(np.uint64) << np.uint64(32) | halves[:, 1]).view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Cut batches sorted by their first ``keys`` columns into whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
            if held and held[-1].column(k)[-1] != batch.column(k)[0]:
                changed[0] = True
        begin = 0
        for at in np.flatnonzero(changed).tolist():
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        """(member, root) of every id that is not its own root."""
        ids = [x for x in self.parent if self.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([self.find(x) for x in ids], pa.int64())], ["a", "b"])


def _merge_list(ids: np.ndarray, signatures: np.ndarray, match: int, forest: Forest) -> None:
    """Link members of one posting list whose signatures agree in ``match`` coordinates or more."""
    roots = np.array([forest.find(x) for x in ids.tolist()])
    for i in range(len(ids) - 1):
        other = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1  # the rest is merged already: skipped
        if not len(other):
            if (roots == roots[0]).all():
                return
            continue
        hits = other[(signatures[other] == signatures[i]).sum(axis=1) >= match]
        for j in hits.tolist():
            if roots[j] != roots[i]:
                forest.join(int(ids[i]), int(ids[j]))
                low = min(roots[i], roots[j])
                roots[(roots == roots[i]) | (roots == roots[j])] = low


def _confirm(ids: np.ndarray, sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Link members of one group by the exact similarity of their full sets."""
    sizes = np.array([len(s) for s in sets])
    if len(ids) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * shared >= percent * (sizes.sum() - shared):
            forest.join(int(ids[0]), int(ids[1]))
        return
    order = np.argsort(-sizes, kind="stable")
    everything = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(len(order)), sizes[order])
    by_value = np.argsort(everything, kind="stable")
    values, owner = everything[by_value], owner[by_value]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    held_by = np.bincount(column)
    keep = held_by[column] > 1
    column, owner = (np.cumsum(held_by > 1) - 1)[column[keep]], owner[keep]
    shared = np.zeros((len(ids), len(ids)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(ids), width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        shared += dense @ dense.T
    shared = np.rint(shared).astype(np.int64)
    ranked = sizes[order]
    union = ranked[:, None] + ranked[None, :] - shared
    for i, j in np.argwhere(np.triu(100 * shared >= percent * union, 1)).tolist():
        forest.join(int(ids[order[i]]), int(ids[order[j]]))


def _with_pivots(members: DataFrame, pivots: DataFrame, chunks: str) -> DataFrame:
    """Members in one of their key's ``chunks``, by a hash of the id; pivots in every chunk. Column ``chunk``."""
    mine = F.pmod(F.xxhash64("rep"), F.col(chunks)).cast("int")
    own = members.withColumn("chunk", mine)
    every = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))).where(F.col("chunk") != mine)
    return own.unionByName(every.select(own.columns))


def _sub(pivots: int):
    """A number below ``pivots`` for a member; of the members of a key with the same one, one is a pivot."""
    return F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(pivots)).alias("sub")


def _apart(members: DataFrame, key: str, chunk: int, total: int) -> DataFrame:
    """Members (with ``component``; ``total`` at most) of keys that still have several components, dealt so that each one outside
    its key's largest component meets all members of the key: column ``chunk`` numbers pairs of chunks."""
    by = members.groupBy(key, "component").agg(F.count("*").alias("n"))
    state = (
        by.groupBy(key)
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        .where("most < all")
        .select(key, "main", "all", F.ceil(F.col("all") / chunk).cast("int").alias("ca"), F.ceil((F.col("all") - F.col("most")) / chunk).cast("int").alias("co"))
    )
    open_ = with_hot_keys(members, state, [key], "all", total).drop("all")
    column, row = (F.pmod(F.xxhash64("rep"), F.col(n)).cast("int") for n in ("ca", "co"))
    everyone = F.transform(F.sequence(F.lit(0), F.col("co") - 1), lambda i: i * F.col("ca") + column)
    across = F.transform(F.filter(F.sequence(F.lit(0), F.col("ca") - 1), lambda j: j != column), lambda j: row * F.col("ca") + j)
    return open_.withColumn("chunk", F.explode(everyone)).unionByName(open_.where("component <> main").withColumn("chunk", F.explode(across))).drop(
        "main", "ca", "co"
    )


def candidate_groups(classes: DataFrame, total: int, coordinates: int = COORDINATES, match: int = MATCH) -> DataFrame:
    """(id, component): groups of classes chained by signatures that agree in ``match`` coordinates.

    ``classes`` has rep (the class) and tokens, ``total`` rows of them.
    """
    prefix = coordinates - match + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in grouped(batches, 2):
            if group.num_rows > 1:
                sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(group.num_rows, coordinates)
                _merge_list(group.column(2).to_numpy(), sig, match, forest)  # the rep, or the component it is in already
        yield forest.stars()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                tokens = _unpacked(part.column(1), coordinates)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), coordinates)), pa.array(tokens.reshape(-1))], ["rep", "token"])

    postings = classes.select("rep", "tokens").mapInArrow(post, "rep long, token long")
    shared = postings.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    mine, facts = lineage.cut(
        with_hot_keys(postings, shared, ["token"], "f", coordinates * total)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("all"))
        # the tokens that no one else has come first, and find no one
        .withColumn("all", F.slice("all", 1, F.greatest(F.lit(0), F.lit(prefix - coordinates) + F.size("all"))))
        .where(F.size("all") > 0),
        longest=F.max(F.array_max(F.transform("all", lambda t: t["f"]))),
    )
    lists = (
        classes.select("rep", F.expr(f"substring(tokens, 1, {4 * coordinates})").alias("sig"))
        .join(mine, "rep")
        .select("rep", "sig", F.explode("all").alias("t"))
        .select(F.col("t.token").alias("token"), "rep", "sig", F.col("t.f").alias("f"))
    )
    n = partitions(classes)

    def merged(dealt: DataFrame, columns: list[str]) -> DataFrame:
        return (
            dealt.select("token", "chunk", *columns, "sig")
            .repartition(n, "token", "chunk")
            .sortWithinPartitions("token", "chunk", *columns)
            .mapInArrow(merge, "a long, b long")
        )

    longest = facts["longest"] or 0
    if longest <= LIST_CHUNK:
        out = components(merged(lists.withColumn("chunk", F.lit(0)), ["rep"]))
        drop(mine)
        return out
    chunked = lists.withColumn("chunks", F.ceil(F.col("f") / LIST_CHUNK).cast("int")).drop("f")
    pivots = chunked.where("chunks > 1").groupBy("token", _sub(LIST_PIVOTS)).agg(F.min(F.struct("rep", "sig", "chunks")).alias("p")).select("token", "p.*")
    once = components(merged(_with_pivots(chunked, pivots, "chunks"), ["rep"]))
    long_ = chunked.where("chunks > 1").drop("chunks").join(once.select(F.col("id").alias("rep"), "component"), "rep", "left")
    more = merged(_apart(long_.withColumn("component", F.coalesce("component", "rep")), "token", LIST_CHUNK, prefix * total), ["component", "rep"])
    out = components(once.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop(mine, once)
    return out


def confirmed_groups(docs: DataFrame, classes: DataFrame, total: int, loose: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component): the ``total`` classes chained by exact similarity, within the groups of ``loose`` (id, component)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                # rows of one id come together, where a join has sorted them: equal ones count once
                ids, hashes = part.column(1).to_pylist(), part.column(4).to_pylist()
                both = [last, *zip(ids, hashes, strict=True)]
                last = both[-1]
                part = part.filter(pa.array([a != b for a, b in zip(both[:-1], both[1:], strict=True)]))
                sets = [s.tobytes() for s in shingle_sets(part.column(part.schema.get_field_index("text")), width)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(sets, pa.binary())], ["grp", "rep", "chunks", "shingles"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = part.column(2).to_pylist()
                many = [len(s) // 8 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(part.column(k).to_numpy(), many)) for k in range(2)), pa.array(np.frombuffer(b"".join(sets), np.int64))], ["grp", "rep", "h"]
                )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in grouped(batches, 2):
            if group.num_rows > 1:
                sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
                _confirm(group.column("rep").to_numpy(), sets, percent, forest)
        yield forest.stars()

    n = partitions(docs)

    def checked(dealt: DataFrame) -> DataFrame:
        return (
            dealt.select("grp", "chunk", "rep", "shingles")
            .repartition(n, "grp", "chunk")
            .sortWithinPartitions("grp", "chunk", "rep")
            .mapInArrow(confirm, "a long, b long")
        )

    roots = loose.select(F.col("component").alias("id"), "component").distinct()
    members = loose.unionByName(roots).join(classes.select(F.col("rep").alias("id"), "n_shingles"), "id")
    chunks = F.greatest(F.ceil(F.sum("n_shingles") / SET_CHUNK), F.ceil(F.count("*") / SET_MEMBERS)).cast("int")
    sizes = members.groupBy("component").agg(chunks.alias("chunks"), F.count("*").alias("n"))
    asked, needed = lineage.cut(
        with_hot_keys(members, sizes, ["component"], "n", total).select(F.col("component").alias("grp"), F.col("id").alias("rep"), "chunks"), n=F.count(F.lit(1))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text", F.xxhash64("text").alias("_h"))
    if (needed["n"] or 0) <= SENT_MEMBERS:
        texts = texts.join(F.broadcast(asked.select("rep")), "rep", "left_semi")
    sets, facts = lineage.cut(
        texts.join(asked, "rep").select("grp", "rep", "chunks", "text", "_h").mapInArrow(shingled, "grp long, rep long, chunks int, shingles binary"),
        most=F.max("chunks"),
    )
    drop(asked)
    if (facts["most"] or 0) <= 1:
        out = components(checked(sets.withColumn("chunk", F.lit(0))))
        drop(sets)
        return out
    large = sets.where("chunks > 1")
    alone = (
        large.select("grp", "rep", "shingles").mapInArrow(spread, "grp long, rep long, h long").groupBy("grp", "h").agg(F.count("*").alias("f"), F.min("rep").alias("rep")).where("f = 1")
        .groupBy("grp", "rep").agg(F.count("*").alias("own"))
    )
    size = (F.length("shingles") / 8).cast("long")
    # an intersection has no shingle of one's own, and the union no fewer than one's all
    able, left = lineage.cut(
        large.join(alone, ["grp", "rep"], "left")
        .withColumn("own", F.coalesce("own", F.lit(0)))
        .where(100 * (size - F.col("own")) >= percent * size)
        .select("grp", "rep", "shingles", (F.col("own") / size).alias("share")),
        n=F.count(F.lit(1)),
    )
    chunks = F.greatest(F.ceil(F.sum(size) / SET_CHUNK), F.ceil(F.count("*") / SET_MEMBERS)).cast("int")
    fresh = able.groupBy("grp").agg(chunks.alias("chunks"), F.count("*").alias("n"))
    dealt = with_hot_keys(able, fresh, ["grp"], "n", left["n"]).drop("n")
    cleanest = able.groupBy("grp", _sub(SET_PIVOTS)).agg(F.min(F.struct("share", "rep")).alias("p")).select("grp", "p.rep")
    pivots = dealt.join(cleanest, ["grp", "rep"], "left_semi")
    small = sets.where("chunks = 1").withColumn("chunk", F.lit(0))
    links = checked(small).unionByName(checked(_with_pivots(dealt, pivots, "chunks")))
    once = components(links)
    placed = able.join(once.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = checked(_apart(placed, "grp", SET_MEMBERS, left["n"]))
    out = components(once.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop(sets, able, once)
    return out


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, match: int = MATCH
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``100 * |intersection| >= percent * |union|`` of their sets of
    ``width``-word shingles (lower-cased A-Z); component_id is the smallest id reachable.
    """
    usable = "n_shingles > 0 and doc_id is not null"
    with shuffles_removed(docs.sparkSession):
        sketches, facts = lineage.cut(sketch(docs, width, coordinates), n=F.count(F.lit(1)))
        classes, found = lineage.cut(
            sketches.where(usable)
            .groupBy("k1", "k2")
            .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")),
            n=F.count(F.lit(1)),
        )
        loose = candidate_groups(classes, found["n"], coordinates, match)
        linked = confirmed_groups(docs, classes, found["n"], loose, width, percent)
        drop(loose)
    of_class = classes.join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "k1", "k2", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    # an exact copy finds its class by the key of its set; a class of very many copies is looked up in place
    filled = with_hot_keys(sketches.where(usable).select("doc_id", "n_shingles", "k1", "k2"), of_class, ["k1", "k2"], "copies", facts["n"])
    single = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        filled.select("doc_id", "n_shingles", "component_id")
        .unionByName(single)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates; same columns.

    Of rows that repeat a doc_id one stays, the first by text and then by the other columns; rows without a doc_id stay all.
    """
    found = near_duplicates(docs, width, percent)
    with shuffles_removed(docs.sparkSession):
        by_id = cut(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_rows")))
        gone, facts = lineage.cut(by_id.where("not _kept").select("_id"), n=F.count(F.lit(1)))
    doc = F.col("doc_id").cast("long")
    left = docs.join(F.broadcast(gone) if (facts["n"] or 0) <= SENT_MEMBERS else gone, doc == F.col("_id"), "left_anti")
    again = by_id.where("_kept and _rows > 1").select("_id")
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    one = (
        left.join(again, doc == F.col("_id"))
        .groupBy("_id")
        .agg(F.min_by(F.struct(*columns), F.struct("text", F.to_json(F.struct(*others)))).alias("_row"))
        .select("_row.*")
    )
    return left.join(again, doc == F.col("_id"), "left_anti").unionByName(one)


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
