"""A virtual graph over relational tables: nothing is copied, each predicate is a projection of one table.

Subjects are ``urn:{table}:{key}``, predicates ``urn:p:{column}``. Patterns that share a subject variable and read
columns of one table become a single scan (the key is unique and a column has one value, so the self-join on the key
adds nothing). A constant subject or foreign-key object turns into a condition on the key column, which Parquet sees.
:meth:`TableGraph.keys` gives IRIs as the integer keys in them: a table and a key say as much as 128 bits of hash and the
text, and a key is all that joins and paths have to shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import IRI, RDF_TYPE, XSD, Const
from ..plans.algebra import Var

P = "urn:p:"


def subject(table: str, key: Column) -> Column:
    return T.iri(F.concat(F.lit(f"urn:{table}:"), key.cast("string")))


def key_of(table: str, node: Const) -> int | None:
    """The key of which :func:`subject` makes this constant; None if there is none."""
    head, tail = node.lex[: len(table) + 5], node.lex[len(table) + 5 :]
    return int(tail) if node.kind == IRI and head == f"urn:{table}:" and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", tail) else None


def _double(c: Column) -> Column:
    return T.typed(c.cast("string"), F.lit(XSD + "double"), c)


def _integer(c: Column) -> Column:
    return T.typed(c.cast("string"), F.lit(XSD + "integer"), c)


def _time(c: Column) -> Column:
    return T.typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(XSD + "dateTime"))


def _time_fraction(c: Column) -> Column:
    return T.typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(XSD + "dateTime"))


@dataclass(frozen=True)
class Mapped:
    """``table.column`` as the objects of one predicate; ``target`` names the table of a foreign key."""

    table: str
    key: str
    column: str
    build: Callable[[Column], Column] | None = None
    target: str | None = None
    text_lang: str | None = None

    def object(self) -> Column:
        c = F.col(self.column)
        if self.target:
            return subject(self.target, c)
        return T.tagged(c, F.col(self.text_lang)) if self.text_lang else self.build(c)


# table -> (key, {column: how it becomes a term, or the table that it refers to})
_TABLES: dict[str, tuple[str, dict]] = {
    "region": ("r_regionkey", {"r_name": T.plain}),
    "nation": ("n_nationkey", {"n_name": T.plain, "n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_name": T.plain, "c_nationkey": "nation", "c_acctbal": _double, "c_mktsegment": T.plain}),
    "supplier": ("s_suppkey", {"s_name": T.plain, "s_nationkey": "nation", "s_acctbal": _double}),
    "part": ("p_partkey", {"p_name": T.plain, "p_brand": T.plain, "p_type": T.plain, "p_size": _integer, "p_retailprice": _double}),
    "orders": ("o_orderkey", {"o_custkey": "customer", "o_orderstatus": T.plain, "o_totalprice": _double, "o_orderdate": _time, "o_orderpriority": T.plain}),
    "events": ("event_id", {"ts": _time_fraction, "user_id": _integer, "event_type": T.plain, "value": _double, "props": T.plain}),
    "documents": ("doc_id", {"lang": T.plain, "source": T.plain, "n_chars": _integer}),
    "labels": ("doc_id", {"quality": _integer, "toxic": _integer}),
    "pages": ("page_id", {"url": T.plain, "html": T.plain}),
    "benchmark": ("item_id", {}),
}


class TableGraph:
    """``tables`` limits which tables patterns with a free predicate read."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = tables
        self.mapped: dict[str, Mapped] = {}
        for table, (key, columns) in _TABLES.items():
            for column, how in columns.items():
                self.mapped[P + column] = Mapped(table, key, column, None if isinstance(how, str) else how, how if isinstance(how, str) else None)
        self.mapped[P + "text"] = Mapped("documents", "doc_id", "text", text_lang="lang")
        # several values for a subject, or subjects that are no key: plain edges, never collapsed.
        # predicate -> (table, how its rows become s and o, the tables whose keys s and o are; without these they are terms)
        nation, n = ("nation", "nation"), F.col("n_nationkey")
        self.edges: dict[str, tuple[str, Callable[[DataFrame], DataFrame], tuple[str, str] | None]] = {
            P + "hasPart": ("lineitem", lambda d: d.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("o")), ("orders", "part")),
            P + "hasSupplier": ("lineitem", lambda d: d.select(F.col("l_orderkey").alias("s"), F.col("l_suppkey").alias("o")), ("orders", "supplier")),
            P + "links": ("nation", lambda d: d.select(n.alias("s"), ((7 * n + 3) % 25).alias("o")), nation),
            P + "maps": ("nation", lambda d: d.select(n.alias("s"), ((n * n + 1) % 25).alias("o")), nation),
            P + "role": ("conversations", lambda d: d.select(self._turn(F.col("turn")).alias("s"), T.plain(F.col("role")).alias("o")), None),
            P + "said": ("conversations", lambda d: d.select(self._turn(F.col("turn")).alias("s"), T.plain(F.col("text")).alias("o")), None),
            P + "next": ("conversations", self._next, None),
            P + "follows": ("orders", self._follows, ("orders", "orders")),
        }

    @staticmethod
    def _turn(turn: Column) -> Column:
        return T.blank(F.concat(F.lit("b1b"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string")))

    def _next(self, d: DataFrame) -> DataFrame:
        later = d.select("conv_id", (F.col("turn") - 1).alias("turn"))
        return d.select("conv_id", "turn").join(later, ["conv_id", "turn"]).select(self._turn(F.col("turn")).alias("s"), self._turn(F.col("turn") + 1).alias("o"))

    def _follows(self, d: DataFrame) -> DataFrame:
        """The next order of the same customer."""
        later = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
        return d.select("o_orderkey", later.alias("later")).where("later is not null").select(F.col("o_orderkey").alias("s"), F.col("later").alias("o"))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def predicates(self) -> list[str]:
        named = [p for p, m in self.mapped.items() if self.tables is None or m.table in self.tables]
        return named + [p for p, (t, *_) in self.edges.items() if self.tables is None or t in self.tables]

    @staticmethod
    def _key(node, table: str) -> str | None:
        """The key in a constant IRI of that table; None if the constant is none, so no row can match."""
        head = f"urn:{table}:"
        tail = node.lex[len(head):] if node.kind == IRI and node.lex.startswith(head) else ""
        return tail if tail.isdigit() else None

    def slice(self, predicate: str | None = None, s: Const | None = None, o: Const | None = None) -> DataFrame:
        if predicate is None:
            parts = [self.slice(p, s, o) for p in self.predicates()]
            parts += [self._types(t, s) for t in _TABLES if self.tables is None or t in self.tables]
            return reduce(DataFrame.unionByName, parts)
        if predicate == RDF_TYPE:
            return reduce(DataFrame.unionByName, [self._types(t, s) for t in _TABLES if self.tables is None or t in self.tables])
        df, tables = self.keys(predicate, s, o)
        return df.select(*[subject(tables[c], F.col(c)).alias(c) if c in tables else F.col(c) for c in "spo"])

    def keys(self, predicate: str | None = None, s: Const | None = None, o: Const | None = None) -> tuple[DataFrame, dict[str, str]]:
        """:meth:`slice`, but the columns that the second result names have a long, the key in that table, for an IRI."""
        if predicate in self.edges:
            table, build, ends = self.edges[predicate]
            rows, tables = build(self.read(table)), dict(zip("so", ends or ()))
        elif predicate in self.mapped:
            m = self.mapped[predicate]
            rows, tables = self._keyed(self.read(m.table), m.key, s, m.table), {"s": m.table}
            if m.target:
                rows, tables = self._keyed(rows, m.column, o, m.target), {"s": m.table, "o": m.target}
            rows = rows.where(F.col(m.column).isNotNull()).select(F.col(m.key).alias("s"), (F.col(m.column) if m.target else m.object()).alias("o"))
        elif predicate is None or predicate == RDF_TYPE:
            return self.slice(predicate, s, o), {}
        else:
            return self.spark.createDataFrame([], f"s {T.TERM}, p {T.TERM}, o {T.TERM}"), {}
        return self._as_keys(rows.select("s", T.iri(F.lit(predicate)).alias("p"), "o"), tables)

    @staticmethod
    def _as_keys(rows: DataFrame, tables: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
        """Columns of any integer type as longs; what is no integer becomes a term at once."""
        whole = {c for c, kind in rows.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
        how = lambda c: F.col(c).cast("long") if c in whole else subject(tables[c], F.col(c))
        return rows.select(*[how(c).alias(c) if c in tables else c for c in rows.columns]), {c: t for c, t in tables.items() if c in whole}

    def _keyed(self, rows: DataFrame, column: str, node: Const | None, table: str) -> DataFrame:
        if node is None:
            return rows
        key = self._key(node, table)
        return rows.where(F.lit(False)) if key is None else rows.where(F.col(column) == int(key))

    def _types(self, table: str, s: Const | None) -> DataFrame:
        key = _TABLES[table][0]
        rows = self._keyed(self.read(table), key, s, table)
        return rows.select(subject(table, F.col(key)).alias("s"), T.iri(F.lit(RDF_TYPE)).alias("p"), T.iri(F.lit(f"urn:{table}")).alias("o"))

    def can_collapse(self, a, b) -> bool:
        """Both read columns of one keyed table for the same subject, into variables."""
        ok = lambda p: isinstance(p.p, Const) and p.p.lex in self.mapped and isinstance(p.s, Var) and isinstance(p.o, Var)
        return ok(a) and ok(b) and a.s == b.s and self.mapped[a.p.lex].table == self.mapped[b.p.lex].table

    def star(self, predicates: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """s, o0, o1, ... of one scan, as :meth:`keys` gives them."""
        ms = [self.mapped[p] for p in predicates]
        rows = self.read(ms[0].table)
        for m in ms:
            rows = rows.where(F.col(m.column).isNotNull())
        tables = {"s": ms[0].table} | {f"o{k}": m.target for k, m in enumerate(ms) if m.target}
        columns = [(F.col(m.column) if m.target else m.object()).alias(f"o{k}") for k, m in enumerate(ms)]
        return self._as_keys(rows.select(F.col(ms[0].key).alias("s"), *columns), tables)
