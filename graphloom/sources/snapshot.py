"""Parquet snapshots, a folder for each predicate: patterns with a constant predicate read only its files.

Inside a predicate the files are sorted by subject, so that the row-group statistics of ``s.id`` skip what a constant
subject can't match; Bloom filters of ``o.id`` do the same for a constant object.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TERM, display
from .triples import TripleTable

#: Spark skips names with an underscore when it lists the triples.
_SCOPES = "_scopes"
_FILES = f"s {TERM}, p {TERM}, o {TERM}, pkey string"


def write(table: TripleTable, path: str, check_ids: bool = False, scopes: int = 0) -> None:
    """``check_ids``: fail if two different terms have one key (it costs a pass over all terms).

    ``scopes``: how many loads have named blank nodes in it; kept with the snapshot.
    """
    if check_ids:
        terms = table.frame.select(F.explode(F.array("s", "p", "o")).alias("t"))
        clash = terms.groupBy("t.id", "t.id2").agg(F.count_distinct(F.concat_ws("\u0001", "t.kind", display(F.col("t")))).alias("n")).where("n > 1")
        if not clash.isEmpty():
            raise ValueError("two terms have the same id")
    clustered = table.frame.repartitionByRange("pkey", F.col("s.id")).sortWithinPartitions("pkey", F.col("s.id"))
    writer = clustered.write.partitionBy("pkey").option("parquet.bloom.filter.enabled#o.id", "true")
    writer.parquet(path)
    spark = table.frame.sparkSession
    spark.range(1).select(F.lit(scopes).cast("long").alias("scopes")).write.parquet(f"{path}/{_SCOPES}")


def read(spark: SparkSession, path: str) -> TripleTable:
    return TripleTable(spark.read.schema(_FILES).parquet(path))


def scopes(spark: SparkSession, path: str) -> int:
    """The loads so far; 0 for a folder that only a stream has written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_SCOPES}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0
    return spark.read.parquet(f"{path}/{_SCOPES}").first()["scopes"]

