"""Triple patterns and their joins.

A source offers ``slice(predicate, s, o)`` (columns s, p, o) for one predicate IRI or, with None, for all. A constant
predicate so touches one Parquet partition, or one mapped column; a constant subject or object reaches the scan.
``keys`` is the same, but may give a table's integer keys for its IRIs. Patterns are joined on those, and the terms are
made of them when all joins are done.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import IRI, Const, same
from ..plans.algebra import Pattern, Var
from ..plans.order import ordered
from ..sources.tables import subject


@dataclass(frozen=True)
class Rows:
    """``frame``, of which the columns in ``tables`` hold keys of that table, and the others terms."""

    frame: DataFrame
    tables: dict[str, str] = field(default_factory=dict)

    def term(self, c: str) -> Column:
        return subject(self.tables[c], F.col(c)) if c in self.tables else F.col(c)

    def with_terms(self, *names: str) -> Rows:
        """The named columns as terms (all, if none is named)."""
        names = set(names or self.frame.columns) & set(self.tables)
        if not names:
            return self
        made = self.frame.select(*[self.term(c).alias(c) if c in names else F.col(c) for c in self.frame.columns])
        return Rows(made, {c: t for c, t in self.tables.items() if c not in names})

    def select(self, columns: dict[str, str]) -> Rows:
        """``columns``: new name -> column."""
        return Rows(self.frame.select(*[F.col(c).alias(n) for n, c in columns.items()]), {n: self.tables[c] for n, c in columns.items() if c in self.tables})


def constant_condition(term: Column, node) -> Column:
    if isinstance(node, tuple):
        return term["id"].isin(*[n.id() for n in node]) & term["id2"].isin(*[n.column()["id2"] for n in node]) if node else F.lit(False)
    return same(term, node.column())


def _matching(source, pattern: Pattern) -> Rows:
    p = pattern.p
    predicate = p.lex if isinstance(p, Const) and p.kind == IRI else None
    rows = Rows(*source.keys(predicate, pattern.s if isinstance(pattern.s, Const) else None, pattern.o if isinstance(pattern.o, Const) else None))
    df, places = rows.frame, dict(zip("spo", pattern.nodes()))
    for c, node in places.items():
        if isinstance(node, (Const, tuple)):
            df = df.where(constant_condition(rows.term(c), node))
    first: dict[str, str] = {}
    for c, node in places.items():
        if isinstance(node, Var):
            if node.name in first:
                df = df.where(_equal(rows, first[node.name], c))
            else:
                first[node.name] = c
    return Rows(df, rows.tables)


def _equal(rows: Rows, a: str, b: str) -> Column:
    alike = a in rows.tables and rows.tables[a] == rows.tables.get(b)
    return F.col(a) == F.col(b) if alike else same(rows.term(a), rows.term(b))


def matching(source, pattern: Pattern) -> DataFrame:
    """The triples (s, p, o) that the pattern matches."""
    return _matching(source, pattern).with_terms().frame


def bindings(source, pattern: Pattern) -> Rows:
    """One column for each variable of the pattern; rows keep their multiplicity."""
    columns = {}
    for c, node in zip("spo", pattern.nodes()):
        if isinstance(node, Var):
            columns.setdefault(node.name, c)
    return _matching(source, pattern).select(columns)


def join_rows(left: Rows, right: Rows) -> Rows:
    """Natural join on the shared variables: on keys where both sides have keys of one table, else on the ids of terms."""
    shared = [c for c in right.frame.columns if c in left.frame.columns]
    if not shared:
        return Rows(left.frame.crossJoin(right.frame), left.tables | right.tables)
    unlike = [c for c in shared if left.tables.get(c) != right.tables.get(c)]
    if unlike:
        left, right = left.with_terms(*unlike), right.with_terms(*unlike)
    a, b = left.frame, right.frame.select(*[F.col(c).alias(f"__{c}" if c in shared else c) for c in right.frame.columns])
    condition = reduce(lambda x, y: x & y, [a[c] == b[f"__{c}"] if c in left.tables else same(a[c], b[f"__{c}"]) for c in shared])
    return Rows(a.join(b, condition).drop(*[f"__{c}" for c in shared]), left.tables | {c: t for c, t in right.tables.items() if c not in shared})


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Natural join on the ids of shared variables; a cartesian product if there is none."""
    return join_rows(Rows(left), Rows(right)).frame


def _stars(source, patterns: tuple[Pattern, ...]) -> list[Rows]:
    """Each pattern on its own, but those with one subject variable over columns of one mapped table as a single scan."""
    out, done = [], set()
    for i, p in enumerate(patterns):
        if i in done:
            continue
        group = [j for j, q in enumerate(patterns) if j >= i and j not in done and source.can_collapse(p, q)]
        names = [patterns[j].o.name for j in group]
        if len(group) > 1 and len(set(names)) == len(names) and isinstance(p.s, Var) and p.s.name not in names:
            done.update(group)
            star = Rows(*source.star([patterns[j].p.lex for j in group]))
            out.append(star.select({p.s.name: "s"} | {n: f"o{k}" for k, n in enumerate(names)}))
        else:
            done.add(i)
            out.append(bindings(source, p))
    return out


def bgp(source, patterns: tuple[Pattern, ...]) -> DataFrame:
    """Join of all patterns: the most selective first, then always one that shares a variable with those before.

    The columns stand in the order in which the patterns, as given, name them.
    """
    found = _stars(source, ordered(patterns))
    # later rows that share a variable go first, so that products stay as small as the query allows
    out, rest = found[0], found[1:]
    while rest:
        nxt = next((r for r in rest if set(r.frame.columns) & set(out.frame.columns)), rest[0])
        rest.remove(nxt)
        out = join_rows(out, nxt)
    return out.with_terms().frame.select(*dict.fromkeys(v for p in patterns for v in p.variables()))
