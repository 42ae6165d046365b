"""Context-triggered piecewise hashing: document fingerprints that survive edits, and their likeness.

A hash of the last seven bytes cuts a text into chunks wherever the context says so; each chunk gives one character. The
block size (3 * 2^level) is the smallest at which a text has at most 64 chunks, so the whole text always counts. A
fingerprint is ``level:signature:signature at twice the block size``. Fingerprints of equal or neighbouring block sizes
are compared by the edit distance (insertions and deletions) of the signatures at a block size that both have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged
from .rolling import Rolling

MOST = 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTERS] = np.arange(64)
_WINDOW = 7


def _signature(rolling: Rolling, ends: np.ndarray) -> str:
    """A letter for each chunk: ``ends`` are the chunks' ends, exclusive."""
    h = rolling.of(np.concatenate(([0], ends[:-1])), ends)
    return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    n = len(text)
    if n == 0:
        return "0::"
    rolling = Rolling(text)
    tops = np.arange(1, n + 1)
    context = rolling.of(np.maximum(tops - _WINDOW, 0), tops) >> np.uint64(32)
    cut = np.flatnonzero((context + np.uint64(1)) % np.uint64(3) == 0)
    factor = (context[cut] + np.uint64(1)) // np.uint64(3)
    level_of = np.log2((factor & (~factor + np.uint64(1))).astype(np.float64)).astype(np.int64)
    cut = cut + 1

    def ends(level: int) -> np.ndarray:
        e = cut[level_of >= level]
        return e if len(e) and e[-1] == n else np.append(e, n)

    level = 0
    while len(at := ends(level)) > MOST:
        level += 1
    return f"{level}:{_signature(rolling, at)}:{_signature(rolling, ends(level + 1))}"


def _common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lengths of the longest common subsequences, 64 positions to a word, all pairs side by side."""
    k = len(a)
    peq = np.zeros((k, 64), np.uint64)
    for i in range(max(map(len, a), default=0)):
        rows = np.array([r for r in range(k) if len(a[r]) > i])
        peq[rows, _PLACE[[a[r][i] for r in rows.tolist()]]] |= np.uint64(1) << np.uint64(i)
    v = np.full(k, ~np.uint64(0))
    for j in range(max(map(len, b), default=0)):
        rows = np.array([r for r in range(k) if len(b[r]) > j])
        u = v[rows] & peq[rows, _PLACE[[b[r][j] for r in rows.tolist()]]]
        v[rows] = (v[rows] + u) | (v[rows] - u)
    return np.bitwise_count(~v).astype(np.int64)


def _share(a: bytes, b: bytes, n: int = 5) -> bool:
    """Whether two signatures have ``n`` letters in a row in common; by chance that hardly happens."""
    n = min(n, len(a), len(b))
    return n > 0 and any(a[i : i + n] in b for i in range(len(a) - n + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair: 1 for equal fingerprints, 0 for block sizes that differ by more than one step.

    Else 1 - edit distance / total length, of the best pair of signatures at a block size that both have; signatures
    without five letters in a row in common (or all letters of the shorter one) count 0.
    """
    out = np.array([float(a == b) for a, b in zip(left, right)])
    at, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            continue
        (lx, x1, x2), (ly, y1, y2) = x.encode().split(b":"), y.encode().split(b":")
        step = int(lx) - int(ly)
        for p, q in {0: ((x1, y1), (x2, y2)), 1: ((x1, y2),), -1: ((x2, y1),)}.get(step, ()):
            if _share(p, q):
                at.append(i)
                a.append(p)
                b.append(q)
    if at:
        lengths = np.array([len(p) + len(q) for p, q in zip(a, b)])
        np.maximum.at(out, at, np.minimum(2 * _common(a, b) / lengths, 0.999))
    return out


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text", "place"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string, place long"


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
    """rows and nexts: (doc_id, text, fingerprint)."""
    texts = [edited(a[1], b[1]).encode() for a, b in zip(rows, nexts)]
    prints = [fingerprint(t) for t in texts]
    own = [r[2] for r in rows]
    columns = [[r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(t).hexdigest() for t in texts], own, prints, likeness(own, prints), likeness(own, [r[2] for r in nexts]), [None] * len(rows), [None] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _ends(rows: list[tuple], places: list[int]) -> pa.RecordBatch:
    none = [None] * len(rows)
    columns = [[r[0] for r in rows], none, none, none, none, none, none, [r[1] for r in rows], places]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _in_order(batches):
    """Compares each document with the one after it; yields the partition's first and last texts for the step across."""
    place, last, first = 2 * TaskContext.get().partitionId(), None, None
    for batch in batches:
        rows = [(i, t or "", fingerprint((t or "").encode())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if not rows:
            continue
        first = first or rows[0]
        rows = ([last] if last else []) + rows
        for i in range(0, len(rows) - 1, 512):
            yield _compared(rows[i : i + 512][: len(rows) - 1 - i], rows[i + 1 : i + 513])
        last = rows[-1]
    if last:
        yield _ends([first, last], [place, place + 1])


def _across(batches):
    """Rows of (doc_id, text, next_id, next_text): the last document of a partition and the first of the next one."""
    for batch in batches:
        ids, texts, next_ids, next_texts = (batch.column(i).to_pylist() for i in range(4))
        pair = lambda i, t: (i, t or "", fingerprint((t or "").encode()))
        if ids:
            yield _compared(list(map(pair, ids, texts)), list(map(pair, next_ids, next_texts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text, of any length; null texts count as empty.

    Null ids and repeated rows are kept, an empty table gives an empty result, other columns are ignored. Nothing is
    shuffled.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next document.

    The order is descending doc_id; ties are in the order of the texts' hashes, null ids come last; after the last
    document comes the first. Null texts count as empty; a single document is its own next; an empty table gives an
    empty result; other columns, whatever their names, are ignored. Texts of any length are hashed whole. The documents
    are range-partitioned once; the last document of each partition is then joined with the first of the next one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    order = (F.desc_nulls_last("doc_id"), F.asc("h"))
    done = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_in_order, _SCHEMA), "fingerprints")
    ends = done.where("place is not null").select("doc_id", "text", "place")
    # of the places of ends (two numbers for each partition, no texts): which first one follows each last one, in a ring
    places = ends.select("place").where("place % 2 = 0")
    following = places.select((F.col("place") + 1).alias("place"), F.coalesce(F.lead("place").over(W.orderBy("place")), F.min("place").over(W.partitionBy())).alias("after"))
    firsts = ends.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), F.col("place").alias("after"))
    pairs = ends.join(following, "place").join(firsts, "after").select("doc_id", "text", "next_id", "next_text")
    out = done.where("place is null").union(pairs.mapInArrow(_across, _SCHEMA))
    return out.drop("text", "place")
