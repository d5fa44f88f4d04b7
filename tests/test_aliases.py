"""What a repair of aliases shuffles and writes, and what the generator looks up."""

import os

from pyspark.sql import functions as F

from strataloom.functions import aliases
from strataloom.operators import aliasing


def test_texts_are_shuffled_by_their_record_alone(spark):
    rows = spark.range(50).select(F.col("id").alias("memory_id"), F.lit(1).alias("revision"), F.lit("t").alias("body"), F.col("id").cast("string").alias("input_hash"))
    markers = rows.filter("memory_id % 2 = 0").select("memory_id", F.col("revision").cast("long").alias("revision"), F.when(F.col("memory_id") == 4, "old").otherwise(F.col("input_hash")).alias("input_hash"), F.lit(aliasing.GENERATOR).alias("generator"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        late = aliasing.outdated(rows, markers)
        plan = late._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning" in line and "input_hash" in line for line in plan.splitlines()), plan
        assert {r["memory_id"] for r in late.collect()} == {4, *range(1, 50, 2)} and late.columns == rows.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_repair_writes_no_texts(spark, sf_dir):
    from strataloom.plans.catalog import QUERIES
    from strataloom.sources.scratch import shared_dir

    place = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = {n for n in os.listdir(place) if n.startswith("outdated")}
    assert QUERIES["alias_repair"](spark, sf_dir).count()
    assert {n for n in os.listdir(place) if n.startswith("outdated")} == before


def test_plain_words_cost_no_look_up():
    aliases._unit.cache_clear()
    body = " ".join("Word" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(1000))
    assert aliases.code_aliases("", body + " Cfg readFile deps") == "config configuration dependencies dependency file read readfile"
    assert aliases._unit.cache_info().misses <= 10
