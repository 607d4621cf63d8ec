import pytest
from pyspark.sql import functions as F

from platewise.operators.numbering import numbered


@pytest.mark.parametrize("small", [True, False])
def test_numbers_are_dense_and_ordered(spark, small):
    df = spark.range(1000, numPartitions=7).select(((F.col("id") * 37) % 500).alias("a.b"), F.lit("x").alias("number2"))
    rows = numbered(df, F.col("`a.b`").desc(), small=small).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1000))
    assert [r["a.b"] for r in rows] == sorted((k * 37 % 500 for k in range(1000)), reverse=True)
    assert numbered(df.limit(0), "number2", small=small).collect() == []
