"""Triples held as one DataFrame: columns s, p, o (terms) and pkey (the predicate's IRI)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TERM

SCHEMA = f"s {TERM}, p {TERM}, o {TERM}, pkey string"


class TripleTable:
    """``frame`` may be a snapshot partitioned by ``pkey``: then a constant predicate prunes partitions."""

    def __init__(self, frame: DataFrame):
        self.frame, self.spark = frame, frame.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> TripleTable:
        return TripleTable(spark.createDataFrame([], SCHEMA))

    @staticmethod
    def of(triples: DataFrame) -> TripleTable:
        """From columns s, p, o."""
        return TripleTable(triples.select("s", "p", "o", F.col("p.lex").alias("pkey")))

    def slice(self, predicate: str | None = None, s=None, o=None) -> DataFrame:
        df = self.frame if predicate is None else self.frame.where(F.col("pkey") == predicate)
        return df.select("s", "p", "o")

    def keys(self, predicate: str | None = None, s=None, o=None) -> tuple[DataFrame, dict[str, str]]:
        """No term is a table's key here."""
        return self.slice(predicate, s, o), {}

    def can_collapse(self, a, b) -> bool:
        return False
