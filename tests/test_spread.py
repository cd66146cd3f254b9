from millrace.operators.spread import spread


def test_spread(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(4)
    assert spread(spark, few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(spark, many) is many
    assert spread(spark, few).count() == 100
