from pyspark.sql import functions as F

from tidemark.llm.common import HOT_ROWS, hot_edge, join_spread


def test_join_spread_is_a_plain_join_only_where_no_key_can_be_hot(spark):
    left = spark.range(3 * HOT_ROWS).select(F.when(F.col("id") < 2 * HOT_ROWS, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    total, joins = left.count(), lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    most = right.agg(F.max("n")).first()[0]
    assert most > hot_edge(total)
    spread = join_spread(left, right, ["k"], "n", total, most=most)
    assert joins(spread) == 3 == joins(join_spread(left, right, ["k"], "n", total))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, spread.collect())) == want
    cold, n = left.where("k > 0"), HOT_ROWS
    for plain in (join_spread(cold, right.where("k > 0"), ["k"], "n", n), join_spread(cold, right.where("k > 0"), ["k"], "n", 100 * n, most=1)):
        assert joins(plain) == 1 and sorted(map(tuple, plain.collect())) == [x for x in want if x[0]]
