from platewise.tables import spread


def test_only_narrow_tables_are_spread(spark):
    wide, narrow = spark.range(100, numPartitions=9), spark.range(100, numPartitions=1)
    assert spread(wide, "id") is wide
    many = spread(narrow, "id")
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in many.collect()) == list(range(100))
