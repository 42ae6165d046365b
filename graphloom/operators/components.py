"""Connected components as DataFrame rounds: contraction inside partitions, then one pointer jump."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, staged

_EDGES = "u long, v long"


def least_of_each(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v) that aren't the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(further := label[label], label):
            label = further
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(most: int):
    """Links -> a star for each component of the links that the partition has (of each ``most`` links, if it has more)."""

    def run(batches):
        held, n = [], 0

        def star():
            u, v = least_of_each(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if n > most:
                yield star()
                held, n = [], 0
        if held:
            yield star()

    return run


def contracted(edges: DataFrame, most: int = 1 << 21) -> DataFrame:
    """(u, v) -> (u, v) with v < u and the same components; all in place, nothing is shuffled."""
    return edges.select("u", "v").where("u != v").mapInArrow(_contracted(most), _EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): the smallest node that links reach. Only nodes with a link appear.

    A round brings the links of each larger node together (no more than one from each partition), contracts all links of
    each partition, and lets every node jump to its root's root; so the number of rounds grows with the logarithm of the
    longest path, and is one or two where partitions see most of a component. No task gathers a component: the jump is a
    join on the root, which splits where a root has very many nodes.
    """
    edges = staged(contracted(edges), "edges")
    while True:
        stars = staged(contracted(edges.repartition("u")), "stars")
        parents = stars.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("k")).select(F.col("u").alias("p"), "w", "k")
        jumped = stars.join(parents, stars.v == parents.p, "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved"))
        discard(edges)
        edges = staged(jumped, "edges")
        discard(stars)
        state = edges.groupBy("u").agg(F.count(F.lit(1)).alias("k"), F.bool_or("moved").alias("moved")).agg(F.max("k").alias("k"), F.bool_or("moved").alias("moved")).first()
        # done: one root for each node, and no root has a root
        if state["k"] in (None, 1) and not state["moved"]:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
