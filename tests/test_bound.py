from pyspark.sql import functions as F

from moodfeed.functions import tokens as tk


def test_a_bound_value_is_computed_once(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    found = df.select(tk._bound(F.upper("text"), lambda t: F.concat(t, t, t)).alias("x"))
    assert [r.x for r in found.collect()] == ["A BA BA B", None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("upper") == 1
