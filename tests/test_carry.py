"""As-of joins against brute force: ties, gaps, null groups, groups that start late, and one group with most rows."""

import random

import pytest
from pyspark.sql import functions as F

from settleframe.plans import carry

LEFT, RIGHT = "g string, t int, name string", "g string, t int, a int, b string"


def brute(left, right, exact=True):
    out = []
    for g, t, name in left:
        rows = [r for r in right if r[0] == g and r[1] is not None and t is not None and (r[1] <= t if exact else r[1] < t)]
        low = lambda v: (v is not None, v)  # noqa: E731  nulls are least
        found = max(rows, key=lambda r: (r[1], low(r[2]), low(r[3])), default=(None,) * 4)
        out.append((g, t, name, found[2], found[3]))
    return sorted(map(str, out))


@pytest.mark.parametrize("exact", [True, False])
def test_against_brute_force(spark, exact):
    draw = random.Random(3)
    groups = ["hot"] * 12 + ["late", "x", None]
    times = lambda g: draw.randrange(400, 500) if g == "late" else draw.randrange(0, 500, 3)
    right = [(g, None if draw.random() < 0.05 else times(g), draw.choice([None, 1, 2, 3]), draw.choice([None, "p", "q"])) for g in draw.choices(groups, k=700)]
    left = [(g, None if draw.random() < 0.05 else draw.randrange(-5, 520), f"n{k}") for k, g in enumerate(draw.choices([*groups, "never"], k=600))]
    left += left[:20]
    got = carry.as_of(spark.createDataFrame(left, LEFT).repartition(5), spark.createDataFrame(right, RIGHT).repartition(7), ["g"], "t", ["a", "b"], exact=exact)
    assert got.columns == ["g", "t", "name", "a", "b"] and sorted(str(tuple(r)) for r in got.collect()) == brute(left, right, exact)


def test_empty_sides_and_no_groups(spark):
    left, right = spark.createDataFrame([("x", 5, "n"), ("y", 9, "m")], LEFT), spark.createDataFrame([("x", 5, 1, "p"), ("z", 7, 2, "q")], RIGHT)
    assert [tuple(r) for r in carry.as_of(left, right.limit(0), ["g"], "t", ["a"]).orderBy("g").collect()] == [("x", 5, "n", None), ("y", 9, "m", None)]
    assert carry.as_of(left.limit(0), right, ["g"], "t", ["a"]).count() == 0
    assert [r.b for r in carry.as_of(left, right.drop("g"), [], "t", ["b"]).orderBy("g").collect()] == ["p", "q"]


def test_a_hot_group_lies_in_many_ranges(spark):
    right = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 2).alias("t"), F.col("id").alias("v"))
    left = spark.range(40_000).select(F.lit("hot").alias("g"), F.col("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = carry.as_of(left, right, ["g"], "t", ["v"])
    assert got.where("v is null or v <> t div 2").count() == 0 and got.count() == 40_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
