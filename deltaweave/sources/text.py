"""Text formats of graphs, results and changes: a folder of files, read as a whole.

Each line is one record; blank lines are skipped. Rows whose fields do not parse are errors unless
``strict`` is false, which drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fixpoint import Result
from ..types import KernelSpec

#: Of a file of part i: its number.
PART = r"part-?0*(\d+)"


def part_of(key: Column, parts: int, rule: str = "mod") -> Column:
    """The part of a key: by 'mod' (whole numbers), 'string' (a hash of the text) or 'pair' (the first id of ``a_b``)."""
    if rule == "mod":
        return F.pmod(key.cast("long"), F.lit(parts)).cast("int")
    if rule == "string":
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")
    if rule == "pair":
        return F.pmod(F.split(key.cast("string"), "_")[0].cast("long"), F.lit(parts)).cast("int")
    raise ValueError(f"no partition rule {rule!r}")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def routed(spark: SparkSession, path: str, parts: int, rule: str = "mod", misplaced: str = "error") -> DataFrame:
    """Lines (value) of files ``part<i>`` that hold the keys of part i of ``parts`` alone, with the number of their file (part).

    Lines of other keys are an error, or left out where ``misplaced`` is 'drop'.
    """
    file = F.regexp_extract(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1), PART, 1).cast("int")
    lines = spark.read.text(path).select("value", file.alias("part")).where(F.trim("value") != "")
    own = part_of(F.split("value", "\t", 2)[0], parts, rule) == F.col("part")
    if misplaced == "drop":
        return lines.where(own)
    if misplaced != "error":
        raise ValueError(f"misplaced must be error or drop, not {misplaced!r}")
    wrong = F.raise_error(F.concat(F.lit("a line of another part: "), F.col("value")))
    return lines.select(F.when(own, F.col("value")).otherwise(wrong).alias("value"), "part")


def read_graph(spark: SparkSession, path: str, weighted: bool, parts: int | None = None, misplaced: str = "error") -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of adjacency lines ``k<TAB>d1 d2 `` or ``k<TAB>d1,w1 d2,w2 ``; with ``parts`` each file is held to its keys."""
    lines = routed(spark, path, parts, "mod", misplaced) if parts else _lines(spark, path)
    return parse_graph(lines, weighted)


def parse_graph(lines: DataFrame, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """As `read_graph`, from lines in a column ``value``."""
    parts = lines.select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].cast("long").alias("src"), F.get("p", F.lit(1)).alias("rest"))
    items = parts.select("src", F.explode(F.filter(F.split(F.coalesce("rest", F.lit("")), " "), lambda x: x != "")).alias("item"))
    if weighted:
        pair = F.split("item", ",")
        edges = items.select("src", pair[0].cast("long").alias("dst"), pair[1].cast("double").alias("weight"))
    else:
        edges = items.select("src", F.col("item").cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    return edges, parts.select(F.col("src").alias("id"))


def read_result(spark: SparkSession, path: str, dtype: str = "double") -> DataFrame:
    """(id, delta, value) of lines ``k<TAB>delta:value``; labels are of ``dtype`` 'long'."""
    found = F.regexp_extract
    line = F.col("value")
    pattern = r"^\s*(-?\d+)\t([^:]*):(.*)$"
    number = lambda x: F.when(x.isin("inf", "Infinity"), F.lit(float("inf"))).when(x.isin("-inf", "-Infinity"), F.lit(float("-inf"))).otherwise(x.cast("double")) if dtype == "double" else x.cast(dtype)
    return _lines(spark, path).select(
        found(line, pattern, 1).cast("long").alias("id"), number(F.trim(found(line, pattern, 2))).alias("delta"), number(F.trim(found(line, pattern, 3))).alias("v")
    ).withColumnRenamed("v", "value")


def parse_changes(lines: DataFrame, strict: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Changes from lines ``T src,dst[,w]`` in a column ``value``, a blank or a tab behind the type; columns to ``keep`` follow."""
    rest = F.split(F.substring("value", 3, 1 << 20), ",")
    kind = F.substring("value", 1, 1)
    ok = kind.isin("A", "R", "I", "D")
    if strict:
        kind = F.when(ok, kind).otherwise(F.raise_error(F.concat(F.lit("not a change: "), F.col("value"))))
    else:
        lines = lines.where(ok)
    return lines.select(
        kind.alias("type"), F.trim(rest[0]).cast("long").alias("src"), F.trim(rest[1]).cast("long").alias("dst"), F.trim(F.get(rest, F.lit(2))).cast("double").alias("weight"),
        *(keep or []),
    )


def read_changes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(seq, type, src, dst, weight) in the order of the lines of each file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    # files in order of their names (up to 2**17), in them blocks by their place (in MB), in these lines as they come
    names = lines.select("_file").distinct().select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_nth"))
    out = parse_changes(lines.where(F.trim("value") != ""), strict, ["_file", "_block", "_at"]).join(names, "_file")
    place = F.shiftleft(F.col("_nth"), 45) + F.shiftleft(F.shiftright("_block", 20), 27) + F.col("_at").bitwiseAND(F.lit((1 << 27) - 1))
    return out.select(place.alias("seq"), "type", "src", "dst", "weight")


def read_critical_edges(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def read_in_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(dst, src, contrib) of lines ``k<TAB>u1,c1 u2,c2 ``."""
    edges, _ = read_graph(spark, path, weighted=True)
    return edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("contrib"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, i_ab, links_a, links_b) of lines ``a_b<TAB>I a1 a2 ... <TAB>b1 b2 ... ``."""
    p = F.split("value", "\t")
    key = F.split(p[0], "_")
    numbers = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: x.cast("long"))
    first = numbers(p[1])
    return _lines(spark, path).select(
        key[0].cast("long").alias("a"), key[1].cast("long").alias("b"), first[0].alias("i_ab"), F.slice(first, 2, F.size(first)).alias("links_a"), numbers(p[2]).alias("links_b")
    )


def _number(c: Column) -> Column:
    """Whole numbers without a fraction, infinities as inf."""
    return F.when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _write(df: DataFrame, key: Column, path: str, parts: int | None) -> None:
    """Lines (one column ``line``), optionally dealt so that part i of n has the keys with key % n = i."""
    if parts:
        df = df.repartitionById(parts, F.pmod(key, F.lit(parts)).cast("int"))
    df.select("line").write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, vertices: DataFrame | None, path: str, weighted: bool = True, parts: int | None = None) -> None:
    item = F.concat_ws(",", F.col("dst").cast("string"), _number(F.col("weight"))) if weighted else F.col("dst").cast("string")
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", item.alias("item")))).alias("links"))
    if vertices is not None:
        lists = vertices.select("id").distinct().join(lists, "id", "full_outer")
    text = F.concat(F.col("id").cast("string"), F.lit("\t"), F.coalesce(F.array_join(F.transform("links", lambda x: F.concat(x["item"], F.lit(" "))), ""), F.lit("")))
    _write(lists.select("id", text.alias("line")), F.col("id"), path, parts)


def write_pairs(pairs: DataFrame, path: str, parts: int | None = None) -> None:
    """A pair graph (a, b, i_ab, links_a, links_b), dealt by its first ids."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x.cast("string"), F.lit(" "))), "")
    line = F.concat(F.concat_ws("_", "a", "b"), F.lit("\t"), F.col("i_ab").cast("string"), F.lit(" "), joined("links_a"), F.lit("\t"), joined("links_b"))
    _write(pairs.select("a", line.alias("line")), F.col("a"), path, parts)


def result_summary(spec: KernelSpec, state: DataFrame) -> DataFrame:
    """One row on a result that is written: sums of the deltas and values that are not the identity, and how many are."""
    none = lambda c: F.col(c) == spec.nothing
    total = lambda c: F.coalesce(F.sum(F.when(~none(c), F.col(c).cast("double"))), F.lit(0.0))
    return state.agg(total("delta").alias("sum_delta"), F.count_if(none("delta")).alias("n_no_delta"), total("value").alias("sum_value"), F.count_if(none("value")).alias("n_no_value"))


def write_result(state: DataFrame, path: str, parts: int | None = None) -> None:
    delta = _number(F.col("delta")) if "delta" in state.columns else F.lit("0")
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), delta, F.lit(":"), _number(F.col("value")))
    _write(state.select("id", line.alias("line")), F.col("id"), path, parts)


def write_changes(changes: DataFrame, path: str, both_ways: bool = False, parts: int | None = None) -> None:
    if both_ways:
        changes = changes.unionByName(changes.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    line = F.concat(F.col("type"), F.lit(" "), F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string"), _number(F.col("weight"))))
    _write(changes.select("src", line.alias("line")), F.col("src"), path, parts)


def write_critical_edges(edges: DataFrame, path: str, parts: int | None = None) -> None:
    line = F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"))
    _write(edges.select("src", line.alias("line")), F.col("src"), path, parts)


def write_in_neighbours(contributions: DataFrame, path: str, parts: int | None = None) -> None:
    turned = contributions.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("contrib").alias("weight"))
    write_graph(turned, None, path, True, parts)


def write_log(result: Result, seconds: dict[str, float], path: str, spark: SparkSession) -> None:
    """A run's log: one line ``<phase>--> total_time: <seconds>`` per phase, and one per superstep."""
    lines = [f"{phase}--> total_time: {took:.3f}" for phase, took in seconds.items()]
    lines += [f"superstep {m['round']} pending {m['pending']} total {m['total']}" for m in result.metrics]
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(path)


def timing_table(spark: SparkSession, path: str, phases: list[str], name: str = r"([^/]*)/[^/]*$") -> DataFrame:
    """One row per run from logs with lines ``<phase>--> total_time: <seconds>``: run (what the pattern ``name`` finds in the
    file's path) and the seconds of each phase; runs that lack a phase are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_extract(F.input_file_name(), name, 1).alias("run"), "value")
    found = lines.select("run", F.regexp_extract("value", r"([\w:]+)--> total_time: ([\d.]+)", 1).alias("phase"), F.regexp_extract("value", r"--> total_time: ([\d.]+)", 1).alias("s"))
    table = found.where("phase <> ''").groupBy("run").pivot("phase", phases).agg(F.last(F.col("s").cast("double")))
    return table.dropna(subset=phases)


def repartition_lines(spark: SparkSession, path: str, to: str, parts: int, pattern: str = r"(\d+)") -> None:
    """Deal any of these text folders anew, so that part i has the keys with key % parts = i; the key is the
    first number that the pattern finds."""
    lines = _lines(spark, path).select(F.col("value").alias("line"), F.regexp_extract("value", pattern, 1).cast("long").alias("k"))
    _write(lines, F.col("k"), to, parts)
