"""The order of fractional ranks against plain Python, and many sources of one row."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from notelake.llm import sharding


def test_rows_stand_in_the_order_of_their_fractional_ranks(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None])) for i in range(900)] + [(5000 + i, f"own {i}") for i in range(300)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "id long, source string, shard int").drop("shard")
    out = sharding.interleave(df.repartition(5), F.col("source"), F.struct("id"), 8).withColumn("key", F.xxhash64(F.lit(17), F.struct("id"), "source")).collect()
    own, parts = defaultdict(list), {}
    for x in out:
        own[x.source].append(x)
    for same in own.values():
        for k, x in enumerate(sorted(same, key=lambda x: x.key)):
            parts[x.id] = Fraction(2 * k + 1, 2 * len(same))
    place = {x.id: (x.shard, x.slot) for x in out}
    order = [parts[i] for i in sorted(place, key=place.get)]
    assert order == sorted(order) and len(out) == len(rows)
    assert all(Counter(x.shard for x in out)[s] == 150 for s in range(8))
    assert sorted(x.slot for x in out if x.shard == 3) == list(range(150))


def test_many_sources_of_one_row_are_no_single_task(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc"), F.concat(F.lit("s"), "id").alias("source"))
    out = sharding.interleave(df, F.col("source"), F.struct("doc"), 8)
    plan = out._jdf.queryExecution().toString()
    assert "_range" in plan
    ordered = out.inputFiles()  # a file for each range of the order
    sizes = [spark.read.parquet(f).count() for f in ordered]
    assert len(sizes) == 4 and max(sizes) < 15_000 and sum(sizes) == 40_000
    assert sorted(r[1] for r in out.groupBy("shard").count().collect()) == [5000] * 8
