"""Tables kept by document: hash buckets of doc_id, so that their number does not grow with the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Buckets of a store; a store is always written with the number it was made with.
BUCKETS = 64


def bucket(key: str = "doc_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_store(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """A store without its bucket column; with ``doc_id``, only that document's bucket is read."""
    d = spark.read.parquet(path)
    if doc_id is not None:
        one = spark.range(1).select(F.lit(doc_id).alias("doc_id")).select(bucket()).first().bucket
        d = d.where((F.col("bucket") == one) & (F.col("doc_id") == doc_id))
    return d.drop("bucket")


def replace_documents(new: DataFrame, path: str, documents: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Put the rows of ``new`` in place of all rows of its documents (and of ``documents``, a table of doc_id).

    The other documents of the buckets concerned are read and written again; no other bucket is touched.
    """
    spark = new.sparkSession
    rows = new.drop("bucket").withColumn("bucket", bucket(buckets=buckets))
    if exists(spark, path):
        gone = new.select("doc_id")
        gone = materialize((gone if documents is None else gone.unionByName(documents.select("doc_id"))).distinct())
        touched = [r.bucket for r in gone.select(bucket(buckets=buckets)).distinct().collect()]  # at most ``buckets`` numbers
        kept = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(gone, "doc_id", "left_anti")
        rows = materialize(kept.unionByName(rows, allowMissingColumns=True))
        for b in sorted(set(touched) - {r.bucket for r in rows.select("bucket").distinct().collect()}):  # emptied buckets are not overwritten
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
