"""Places for intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (tests) gets a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="inkframe-")
        sc.setCheckpointDir(base)
    return base


class Scratch:
    """Tables written once to the shared folder and read back: each cuts the lineage, so a lost executor costs no more than the tasks it held."""

    #: All that were made, for those who know when the results read from them have been written.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", {}
        Scratch.made.append(self)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if path := self.paths.pop(name, None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, scratch: Scratch, name: str = "numbered") -> DataFrame:
    """The rows, stored, with ``_row``, a number of their own: keys may be null or repeat."""
    return scratch.store(docs.withColumn("_row", F.monotonically_increasing_id()), name)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Alternates the large-star and small-star steps, both plain aggregations and joins, until the edges are stars around
    the smallest vertices; each round is a stored table, so rounds don't pile up in the plan.
    """
    # edges lead from the larger vertex a to the smaller b
    now, i = scratch.store(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a != b").distinct(), f"{name}0"), 0
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(now.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1 AND up > 0").count():
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        # each neighbour larger than b gets b's least neighbour, or b
        large = now.join(least, "b").select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # each vertex and its smaller neighbours get the least of them
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now, i = scratch.store(small, f"{name}{i + 1}"), i + 1
        scratch.drop(f"{name}{i - 1}")
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(now.select("b").distinct().select("b", F.col("b").alias("comp")))
