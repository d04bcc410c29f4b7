import itertools

import pytest
from pyspark.sql import functions as F

from sparkassay.operators import costs as C
from sparkassay.operators import designs as D
from workloads.frontier import COST_DOC

# Published (design, central cost) pairs.
PUBLISHED = {7388: 121.0, 7376: 123.0, 11972: 121.0, 7310: 144.0, 7364: 125.0, 7382: 136.0}


def test_grid_order_is_the_cartesian_product(spark):
    spaces = (D.discrete("a", 1, 2), D.locked(("b", "c"), (10, 11), (20, 21), (30, 31)), D.discrete("d", 5, 6))
    rows = D.grid_build(spark, spaces).orderBy("gidx").collect()
    want = [(a, *bc, d) for a, bc, d in itertools.product((1, 2), ((10, 11), (20, 21), (30, 31)), (5, 6))]
    assert [tuple(r)[1:] for r in rows] == [tuple(map(float, w)) for w in want]
    back = D.grid_lookup(D.grid_build(spark, spaces).withColumnRenamed("gidx", "g"), spaces)
    assert back.where(F.col("g") != F.col("gidx")).isEmpty()
    off = spark.createDataFrame([(1.0, 10.0, 21.0, 5.0)], "a double, b double, c double, d double")
    assert D.grid_lookup(off, spaces).first()["gidx"] is None


def test_published_costs(spark):
    model = C.cost_profile_load(COST_DOC)
    grid = D.grid_build(spark, D.DESIGN_SPACE)
    assert grid.count() == 27720
    costs = C.design_cost(grid, model, ["central"])
    got = {r["gidx"]: r["cost"] for r in costs.where(F.col("gidx").isin(list(PUBLISHED))).collect()}
    assert got == PUBLISHED
    row = C.cost_manifest(costs, model).first()
    assert (row["cost_min"], row["cost_max"], row["ratio_ok"]) == (100.0, 249.0, True)
    assert C.missing_premiums(grid, model).isEmpty()


def test_components_sum_to_the_cost(spark):
    model = C.cost_profile_load(COST_DOC)
    some = D.with_design(spark.range(0, 27720, 997).withColumnRenamed("id", "gidx"), D.DESIGN_SPACE)
    for profile in model.profiles:
        parts = C.cost_components(some, model, profile).groupBy("gidx").agg((F.sum("cost") + 100.0).alias("s"))
        diff = parts.join(C.design_cost(some, model, [profile]), "gidx").where(F.abs(F.col("s") - F.col("cost")) > 1e-9)
        assert diff.isEmpty()


def test_two_premiums_for_one_value_are_refused():
    doc = {**COST_DOC, "components": [{**COST_DOC["components"][0], "premiums": {"0.75": 1.0, "0.750": 2.0}}]}
    with pytest.raises(ValueError):
        C.cost_profile_load(doc)


def test_negative_zero_finds_its_premium(spark):
    model = C.cost_profile_load(COST_DOC)
    row = D.with_design(spark.range(1).withColumnRenamed("id", "gidx"), D.DESIGN_SPACE).withColumn("fault", F.lit(-0.0))
    assert C.missing_premiums(row, model).isEmpty()


def test_premiums_of_parts_beyond_the_grid(spark, tmp_path):
    from workloads.frontier import missing_premiums

    far = D.grid_size(D.DESIGN_SPACE) * 3
    keys = [0, 3, 27719, 27720, 27723, far + 7]
    spark.createDataFrame([(k,) for k in keys for _ in range(2)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, missing_premiums(spark, str(tmp_path)).collect()))
    assert got == [(k, "sensor_generation_rate") for k in keys if k % 4 == 3]
