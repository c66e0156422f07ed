import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.layout import longest_run


def test_longest_runs_need_no_table_of_pages(spark):
    r = random.Random(4)
    rows = [(k % 9, r.choice((None, *range(40)))) for k in range(220)] + [(10, None), (11, 5), (11, 5)]
    pages = spark.createDataFrame(rows, "doc_id int, page long")
    w = Window.partitionBy("doc_id").orderBy("page")
    plain = pages.distinct().withColumn("new", (F.col("page") - F.lag("page").over(w) > 2).cast("int"))
    plain = plain.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(w)).groupBy("doc_id", "island").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("run"))
    got = longest_run(pages, ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.schema["run"].dataType.typeName() == "long"
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
