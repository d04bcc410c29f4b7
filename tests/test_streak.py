from pyspark.sql import functions as F

from sparkassay.operators import selection as S


def test_streak_reads_its_cycles_once(spark):
    cycles = spark.range(300).select((F.col("id") % 3).alias("run"), F.col("id").alias("cycle"), (F.col("id") % 7 / 100).alias("distance"))
    out = S.early_stop_streak(cycles, ["run"], 0.04, 3)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    streak = {}
    for r in sorted(out.collect(), key=lambda r: r["cycle"]):
        streak[r["run"]] = streak.get(r["run"], 0) + 1 if r["distance"] <= 0.04 else 0
        assert (r["streak"], r["stop"]) == (streak[r["run"]], streak[r["run"]] >= 3)
