"""The store: a source of triples and the questions that can be put to it. All results are lazy DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import display, key
from .operators.patterns import matching
from .query import Query, pattern
from .sources import ntriples, snapshot, turtle
from .sources.tables import TableGraph
from .sources.triples import TripleTable


def _has_key(term: Column, wanted) -> Column:
    first, *second = (wanted,) if isinstance(wanted, int) else wanted[:2]
    return (term["id"] == first) & (term["id2"] == second[0] if second else F.lit(True))


class TripleStore:
    """Immutable: loading returns a new store. The same triple loaded twice counts twice, unless ``dedup`` is asked for."""

    def __init__(self, source, scopes: int = 0, read_only: bool = False):
        self.source, self.spark, self.scopes, self.read_only = source, source.spark, scopes, read_only

    @staticmethod
    def empty(spark: SparkSession) -> TripleStore:
        return TripleStore(TripleTable.empty(spark))

    @staticmethod
    def from_snapshot(spark: SparkSession, path: str) -> TripleStore:
        """Goes on with the scopes of blank nodes where the snapshot ended."""
        return TripleStore(snapshot.read(spark, path), snapshot.scopes(spark, path))

    @staticmethod
    def from_tables(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> TripleStore:
        return TripleStore(TableGraph(spark, sf_dir, tables), read_only=True)

    @staticmethod
    def from_ntriples(spark: SparkSession, path: str, **options) -> TripleStore:
        return TripleStore.empty(spark).load(path, "ntriples", **options)

    @staticmethod
    def from_turtle(spark: SparkSession, path: str, **options) -> TripleStore:
        return TripleStore.empty(spark).load(path, "turtle", **options)

    def load(self, path: str, kind: str = "guess", on_invalid: str = "drop") -> TripleStore:
        """Append a file, a folder or a glob. Blank nodes of different files, and of different loads, are different."""
        if kind == "guess":
            kind = "turtle" if path.rstrip("/").endswith((".ttl", ".turtle")) else "ntriples"
        reader = turtle if kind == "turtle" else ntriples
        return self.add(reader.read(self.spark, path, self.scopes + 1, on_invalid), self.scopes + 1)

    def add(self, triples: DataFrame, scopes: int | None = None) -> TripleStore:
        """Append triples (s, p, o)."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        both = self.source.frame.unionByName(TripleTable.of(triples).frame)
        return TripleStore(TripleTable(both), self.scopes if scopes is None else scopes)

    def dedup(self) -> TripleStore:
        frame = self.triples()
        keyed = frame.groupBy(*[key(F.col(c)).alias(f"{c}_id") for c in "spo"]).agg(*[F.first(c).alias(c) for c in "spo"])
        return TripleStore(TripleTable.of(keyed), self.scopes)

    def as_read_only(self) -> TripleStore:
        return TripleStore(self.source, self.scopes, True)

    def save(self, path: str, check_ids: bool = False) -> None:
        source = self.source if isinstance(self.source, TripleTable) else TripleTable.of(self.triples())
        snapshot.write(source, path, check_ids, self.scopes)

    def triples(self) -> DataFrame:
        return self.source.slice()

    def match(self, s=None, p=None, o=None) -> DataFrame:
        """The triples that fit; None fits all, a list any of its terms."""
        return matching(self.source, pattern(s, p, o))

    def match_ids(self, s=None, p=None, o=None) -> DataFrame:
        """The triples whose terms have these keys: (id, id2), or a collected term, or id alone; None fits all."""
        df = self.triples()
        for c, wanted in zip("spo", (s, p, o)):
            df = df if wanted is None else df.where(_has_key(F.col(c), wanted))
        return df

    def term(self, wanted) -> DataFrame:
        """The term with this key (as in :meth:`match_ids`), if it is in the store."""
        return self.terms().where(_has_key(F.col("t"), wanted)).select("t")

    def count(self, s=None, p=None, o=None) -> int:
        return self.match(s, p, o).count()

    def size(self) -> int:
        return self.triples().count()

    def query(self) -> Query:
        return Query(self.source)

    def bgp(self, *patterns) -> DataFrame:
        return self.query().bgp(*patterns).to_df()

    def terms(self) -> DataFrame:
        """Each term once: id, id2 and t."""
        frame = self.triples()
        ends = reduce(DataFrame.union, [frame.select(F.col(c).alias("t")) for c in "spo"])
        return ends.groupBy("t.id", "t.id2").agg(F.first("t").alias("t"))

    def search(self, regex: str, limit: int | None = None) -> DataFrame:
        """id and display of the terms whose display text has a match."""
        found = self.terms().select("id", display(F.col("t")).alias("term")).where(F.col("term").rlike("(?d)" + regex))
        return found if limit is None else found.limit(limit)

    def nodes(self) -> DataFrame:
        """id, id2, term, in_degree and out_degree of every subject and object."""
        frame = self.triples()
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = frame.select(F.col("s").alias("t"), none.alias("i"), one.alias("o")).union(frame.select(F.col("o").alias("t"), one.alias("i"), none.alias("o")))
        return ends.groupBy("t.id", "t.id2").agg(display(F.first("t")).alias("term"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))

    def edges(self) -> DataFrame:
        return self.triples().select(F.col("s.id").alias("s"), F.col("p.id").alias("p"), F.col("o.id").alias("o"))

    def ntriples(self, limit: int | None = None) -> DataFrame:
        """Display text of each triple (unescaped, numbers bare); :func:`sources.ntriples.write` gives the standard form."""
        frame = self.triples() if limit is None else self.triples().limit(limit)
        return frame.select(F.concat_ws(" ", *[display(F.col(c)) for c in "spo"], F.lit(".")).alias("value"))
