import time

from pyspark.sql import functions as F

from deltaweave.llm import plan

from .helpers import save, table


def test_blocks_have_a_partition_each(spark):
    for blocks in (1, 7, 300):
        df = plan.dealt_blocks(spark.range(5000), blocks, F.pmod("id", F.lit(blocks)))
        found = df.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_block").alias("n"), F.count("*").alias("rows")).collect()
        assert len(found) == blocks and {r.n for r in found} == {1}
        # a later grouping by the block needs no other exchange, and more partitions part no block
        assert df.groupBy("_block").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    wide = spark.range(5000).withColumn("_block", plan.seat(F.pmod("id", F.lit(50)))).repartition(211, "_block")
    assert {r.n for r in wide.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_block").alias("n")).collect()} == {1}


def test_partitions_of_joined_frames(spark, tmp_path):
    save(table(spark, [(k, "some text " * 50) for k in range(2000)]), tmp_path, "documents")
    docs = plan.table(spark, str(tmp_path), "documents")
    one = plan.partitions(docs, 2000)
    twice = docs.join(docs.select("doc_id"), "doc_id")
    thrice = twice.join(docs.select("doc_id"), "doc_id")
    assert one > 4 and plan.partitions(twice, 2000) <= 2 * one + 1 and plan.partitions(thrice, 2000) <= 3 * one + 2
    assert plan.partitions(spark.createDataFrame([(1,)], "a int")) >= 4


def test_hot_keys_join_like_others(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id") % 500).cast("long").alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = sorted(map(tuple, plan.with_hot_keys(rows, values, ["k"], "n", 6000).select("k", "id", "n", "m").collect()))
    assert got == sorted(map(tuple, rows.join(values, "k").select("k", "id", "n", "m").collect())) and len(got) == 6000


def test_ends_of_components(spark):
    assert plan.components(spark.createDataFrame([], "a long, b long")).collect() == []
    edges = [(5, k) for k in range(6, 900)] + [(2000 + k, 2001 + k) for k in range(30)] + [(3, 3)]
    got = {r.id: r.component for r in plan.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 5 for k in range(6, 900)} | {2001 + k: 2000 for k in range(30)}


def test_shuffle_files_go_with_their_query(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(5000).withColumn("k", F.xxhash64("id"))
    at = files()
    with plan.shuffles_removed(spark):
        out = plan.cut(rows.groupBy("k").count())
        for _ in range(50):  # files go in the background
            if files() <= at:
                break
            time.sleep(0.1)
    assert files() <= at and out.count() == 5000
    at = files()
    plan.cut(rows.groupBy("k").count())
    assert files() > at  # outside, they stay until the driver's garbage is collected
