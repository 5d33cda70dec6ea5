import edge

from lockstep.llm.rows import row_key, times


def test_nulls_are_no_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "null 1", "a"), (1, "a", None), (1, None, None), (1, "", "")], "doc_id long, x string, y string")
    assert df.select(row_key(df).alias("k")).distinct().count() == 5


def test_any_column_names(spark):
    rows = [(1, "a", 2, 3, 4, 5, 6), (1, "b", 2, 3, 4, 5, 6), (2, None, 2, 3, 4, 5, 6), (2, None, 2, 3, 4, 5, 6), (None, "z", 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int, _n int, `a.b` int, row int, `we``ird` int")
    keyed = df.select(row_key(df).alias("_key"), "doc_id").groupBy("_key", "doc_id").count().withColumnsRenamed({"count": "_m"})
    from pyspark.sql import functions as F

    found = times(df, keyed.withColumn("_n", F.when(F.col("doc_id") == 1, 1).otherwise(2)))
    assert found.columns == df.columns
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[2], rows[4], rows[4]], key=str)
    assert edge.plain(times(edge.empty(spark, df), keyed.withColumn("_n", F.lit(1)))) == []
