"""Transitive closure of one predicate.

With a bound end, semi-naive rounds follow the frontier: the edges are written once, and each round looks up the pairs
that were new in the last one, keeps those not seen before and writes them to the shared folder, so that the lineage
stays one round long and the result survives lost executors.

With free ends, the result is larger than the edges, so it is the edges that are shuffled: those of one weakly connected
component are brought together, and each task closes its components. Components of more than ``most`` edges are closed by
rounds that join new pairs with all pairs on both sides; these grow with the logarithm of the longest path.

Nodes are terms, or a table's keys where both ends of the predicate are IRIs of one table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import KEY, TERM, Const, key
from ..plans.algebra import Path, Pattern, Var
from ..scratch import new_path, releasing, staged
from ..shipping import ship
from ..sources.tables import key_of, subject
from .components import components, least_of_each
from .patterns import bindings, join

#: Edges of a component that one task closes, edges that it reads at a time, and pairs that it marks at a time.
MOST, READ, MARKED = 1000, 1 << 16, 1 << 22


def _rounds(first: DataFrame, step) -> DataFrame:
    """All pairs from ``first`` on; ``step(delta, reached)`` gives the candidates of the next round."""
    spark = first.sparkSession
    base, n = new_path(spark, "closure"), 0
    delta = first.distinct()
    pair = delta.schema
    while True:
        path = f"{base}/round={n}"
        with releasing(spark):
            delta.write.parquet(path)
        fresh = spark.read.schema(pair).parquet(path)
        if fresh.isEmpty():
            break
        reached = spark.read.schema(pair).parquet(*[f"{base}/round={k}" for k in range(n + 1)])
        delta = step(fresh, reached).distinct().join(reached, ["s", "o"], "left_anti").select("s", "o")
        n += 1
    return spark.read.schema(pair).parquet(*[f"{base}/round={k}" for k in range(n + 1)])


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """edges (s, o), starts (s) -> all (s, o) with a path of one or more edges from a start; nodes are longs or keys."""
    edges = staged(edges.select("s", "o"), "edges")
    along = edges.select(F.col("s").alias("via"), F.col("o").alias("next"))
    first = edges.join(starts.distinct(), "s", "left_semi").select("s", "o")
    return _rounds(first, lambda fresh, _: fresh.join(along, fresh.o == along.via).select("s", F.col("next").alias("o")))


def _both(fresh: DataFrame, reached: DataFrame) -> DataFrame:
    ahead = fresh.alias("a").join(reached.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
    behind = reached.alias("a").join(fresh.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
    return ahead.union(behind)


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """What tells nodes apart: the long, or the two ids of a term."""
    parts = column.flatten()[:2] if pa.types.is_struct(column.type) else [column]
    return [p.to_numpy(zero_copy_only=False) for p in parts]


def _rooted(batches):
    """Edges with the smallest node (the first number of it) that the edges read together link theirs to."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        s, o = (_numbers(t.column(c).combine_chunks())[0] for c in (0, 1))
        moved, least = least_of_each(s, o)
        root = s.copy()
        if len(moved):
            at = np.minimum(np.searchsorted(moved, s), len(moved) - 1)
            root = np.where(moved[at] == s, least[at], s)
        return t.append_column("root", pa.array(root, pa.int64())).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= READ * 16:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _closed(t: pa.Table):
    """All pairs of the components in a table of s, o and label that has whole components only."""
    s, o, label = (t.column(c).combine_chunks() for c in range(3))
    values, label = pa.concat_arrays([s, o]), np.tile(label.to_numpy(zero_copy_only=False), 2)
    by = [label, *[np.concatenate(x) for x in zip(_numbers(s), _numbers(o))]]
    order = np.lexsort(by[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in by:
        new[1:] |= x[order][1:] != x[order][:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    node = order[new]  # where each node stands in values; those of one component follow each other
    a, b = code[: len(s)], code[len(s) :]
    begins = np.flatnonzero(np.r_[True, label[node][1:] != label[node][:-1]])
    size = np.diff(np.r_[begins, len(node)])
    part = np.cumsum(size**2) // MARKED
    of = np.repeat(np.arange(len(size)), size)
    for k in np.unique(part):
        mine = part[of[a]] == k
        for f, g in _reached(a[mine], b[mine], of, begins, size, part == k):
            for i in range(0, len(f), READ):
                yield pa.RecordBatch.from_arrays([pc.take(values, pa.array(node[x[i : i + READ]])) for x in (f, g)], names=["s", "o"])


def _reached(a, b, of, begins, size, mine):
    """The pairs of nodes that the edges (a, b) connect, those of one number of steps after the other."""
    offset = np.cumsum(np.where(mine, size**2, 0)) - np.where(mine, size**2, 0)
    place = lambda x, y: offset[of[x]] + (x - begins[of[x]]) * size[of[x]] + (y - begins[of[x]])
    seen = np.zeros(int((size[mine] ** 2).sum()), bool)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    _, once = np.unique(place(a, b), return_index=True)
    once.sort()
    a, b = a[once], b[once]
    f, g = a, b
    while len(f):
        seen[place(f, g)] = True
        yield f, g
        low = np.searchsorted(a, g)
        steps = np.searchsorted(a, g, "right") - low
        at = np.repeat(low - np.cumsum(steps) + steps, steps) + np.arange(steps.sum())
        f, g = np.repeat(f, steps), b[at]
        where = place(f, g)
        fresh = np.flatnonzero(~seen[where])
        fresh = fresh[np.unique(where[fresh], return_index=True)[1]]
        f, g = f[fresh], g[fresh]


def _solved(batches):
    """Rows sorted by label -> the pairs of each component. A component has no more than ``MOST`` edges."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < READ:
            continue
        t = pa.Table.from_batches(held)
        last = t.column("label")[-1].as_py()
        cut = pc.index(t.column("label"), last).as_py()
        if cut:
            yield from _closed(t.slice(0, cut).combine_chunks())
            t = t.slice(cut).combine_chunks()
        held, n = t.to_batches(), t.num_rows
    if n:
        yield from _closed(pa.Table.from_batches(held).combine_chunks())


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (s, o) -> all (s, o) with a path of one or more edges; nodes are longs or terms."""
    spark, most = edges.sparkSession, MOST if most is None else most
    ship(spark)
    terms = dict(edges.dtypes)["s"] != "bigint"
    kind = TERM if terms else "long"
    first = lambda c: F.col(f"{c}.id") if terms else F.col(c)
    local = staged(edges.select("s", "o").where("s is not null and o is not null").mapInArrow(_rooted, f"s {kind}, o {kind}, root long"), "edges")
    # a node with two roots links them
    at = local.select(F.explode(F.array(first("s"), first("o"))).alias("node"), "root")
    shared = staged(at.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("root")).where("least != root").select("node", "least"), "shared")
    labelled = local.withColumnRenamed("root", "label")
    if not shared.isEmpty():
        roots = staged(components(at.join(shared, "node").select(F.col("root").alias("u"), F.col("least").alias("v")).where("u != v")), "roots")
        labelled = local.join(roots.withColumnRenamed("root", "label"), local.root == roots.node, "left").select("s", "o", F.coalesce("label", local.root).alias("label"))
    large = staged(labelled.groupBy("label").count().where(F.col("count") > most).select("label"), "large")
    rest = not large.isEmpty()
    small = labelled.join(large, "label", "left_anti") if rest else labelled
    solved = small.select("s", "o", "label").repartition("label").sortWithinPartitions("label").mapInArrow(_solved, f"s {kind}, o {kind}")
    if not rest:
        return solved
    left = labelled.join(large, "label", "left_semi").select("s", "o")
    if not terms:
        return solved.union(_rounds(left, _both))
    return solved.union(_attached(_rounds(left.select(key(F.col("s")).alias("s"), key(F.col("o")).alias("o")), _both), _ends(left)))


def _ends(edges: DataFrame) -> DataFrame:
    """id and t of each term."""
    return edges.select(F.explode(F.array("s", "o")).alias("t")).groupBy(key(F.col("t")).alias("id")).agg(F.first("t").alias("t"))


def _attached(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs of keys as pairs of terms."""
    for c in ("s", "o"):
        pairs = pairs.join(ends.select(F.col("id").alias(c), F.col("t").alias(f"{c}_term")), c)
    return pairs.select(F.col("s_term").alias("s"), F.col("o_term").alias("o"))


def path(source, op: Path, left: DataFrame | None = None) -> DataFrame:
    """Bindings of a path's ends; with ``left``, joined to the rows that earlier operators made."""
    bound = lambda n: left is not None and isinstance(n, Var) and n.name in left.columns
    rows = bindings(source, Pattern(Var("s"), op.p, Var("o")))
    table = rows.tables.get("s")
    constants = [n for n in (op.s, op.o) if isinstance(n, Const)]
    if table != rows.tables.get("o") or bound(op.s) or bound(op.o) or any(key_of(table, n) is None for n in constants if table):
        table = None
    edges = rows.frame if table else rows.with_terms().frame
    # node: what edges hold -> what tells it from others; at: the same of a constant
    node = (lambda c: c) if table else key
    at = lambda n: F.lit(key_of(table, n)).cast("long") if table else n.key()
    if not (constants or bound(op.s) or bound(op.o)):
        pairs = closure(edges)
        if op.kind == "*":
            nodes = edges.select(F.explode(F.array("s", "o")).alias("s")).where("s is not null").distinct() if table else _ends(edges).select(F.col("t").alias("s"))
            pairs = pairs.where(node(F.col("s")) != node(F.col("o"))).union(nodes.select("s", F.col("s").alias("o")))
    else:
        pairs = _from_bound(source, op, edges, node, at, left, bound, None if table else _ends(edges))
    if isinstance(op.s, Var) and op.s == op.o:
        pairs = pairs.where(node(F.col("s")) == node(F.col("o")))
    made = lambda c: subject(table, F.col(c)) if table else F.col(c)
    columns = {n.name: made(c) for c, n in (("o", op.o), ("s", op.s)) if isinstance(n, Var)}
    names = list(dict.fromkeys(n.name for n in (op.s, op.o) if isinstance(n, Var)))
    out = pairs.select(*[columns[n].alias(n) for n in names])
    return out if left is None else join(left, out)


def _from_bound(source, op: Path, edges: DataFrame, node, at, left, bound, ends: DataFrame | None) -> DataFrame:
    """The pairs of a path with an end that is a constant or a column of ``left``."""
    ids = edges.select(node(F.col("s")).alias("s"), node(F.col("o")).alias("o")).where("s is not null and o is not null")
    back = ids.select(F.col("o").alias("s"), F.col("s").alias("o"))
    one = lambda n: source.spark.range(1).select(at(n).alias("s"))
    known = lambda n: left.select(key(F.col(n.name)).alias("s"))
    if isinstance(op.s, Const) or bound(op.s):
        pairs = reachable(ids, one(op.s) if isinstance(op.s, Const) else known(op.s))
    else:
        pairs = reachable(back, one(op.o) if isinstance(op.o, Const) else known(op.o)).select(F.col("o").alias("s"), F.col("s").alias("o"))
    if op.kind == "*":
        zero = (ids.select("s").union(ids.select("o")) if ends is None else ends.select(F.col("id").alias("s"))).select("s", F.col("s").alias("o"))
        if isinstance(op.s, Const):  # a constant reaches itself even if the predicate doesn't touch it
            zero = zero.union(one(op.s).select("s", F.col("s").alias("o")))
        pairs = pairs.union(zero).distinct()
    for c, n in (("s", op.s), ("o", op.o)):
        if isinstance(n, Const):
            pairs = pairs.where(F.col(c) == at(n))
    if ends is None:
        return pairs
    if op.kind == "*" and isinstance(op.s, Const):
        me = op.s.column()
        ends = ends.union(source.spark.range(1).select(key(me).alias("id"), me.alias("t"))).groupBy("id").agg(F.first("t").alias("t"))
    return _attached(pairs, ends)
