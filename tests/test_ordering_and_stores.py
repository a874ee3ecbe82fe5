"""Windows over groups of any size, and stores in buckets."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.plans import stores
from quireflow.plans.ordering import along


def test_along_is_the_window_over_the_group(spark):
    """A group with most rows lies in several ranges; nulls, small groups and a null group too."""
    rng = random.Random(5)
    rows = [("hot", i, rng.choice([None, i]), rng.choice([None, "a", "b"])) for i in range(4000)] + [(f"d{k}", i, i, None) for k in range(40) for i in range(k % 7 + 1)] + [(None, i, 1, "n") for i in range(5)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, i int, v int, t string").repartition(6)
    w = Window.partitionBy("g").orderBy("i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = d.select("*", F.sum("v").over(run).alias("s"), F.last("t", True).over(run).alias("l"), F.lag("t").over(w).alias("p"), F.lead("v").over(w).alias("n"))
    got = along(d, ["g"], ["i"], sums={"s": F.col("v")}, lasts={"l": F.col("t")}, lags={"p": F.col("t")}, leads={"n": F.col("v")})
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert along(d.limit(0), ["g"], ["i"], sums={"s": F.col("v")}).count() == 0


def test_stores_replace_only_their_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "doc_id string, v int")
    stores.replace_documents(rows([f"d{i}" for i in range(200)], 1), path, buckets=8)
    stores.replace_documents(rows(["d3", "d4", "new"], 2), path, rows(["d5"], 0), buckets=8)
    got = {r.doc_id: r.v for r in stores.read_store(spark, path).collect()}
    assert len(got) == 200 and got["d3"] == got["d4"] == got["new"] == 2 and "d5" not in got and got["d6"] == 1
    assert len(list((tmp_path / "t").glob("bucket=*"))) == 8
    stores.replace_documents(rows([], 0), path, rows(list(got), 0), buckets=8)
    assert not list((tmp_path / "t").glob("bucket=*"))
