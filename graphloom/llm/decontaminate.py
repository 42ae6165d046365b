"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised to their words, and each word of the benchmark has a symbol of its own, so the automaton is over
words and a document is scanned once, a symbol for each of its words. Every match is mapped back to word numbers and to
code-point offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import each, packed, resident

# Bytes outside words become spaces, A-Z become a-z, all other bytes stay.
_SEPARATORS = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)}
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b in _SEPARATORS else b for b in range(256))
_WORD = re.compile(rb"[^ ]+")

#: The symbol of words that the benchmark doesn't have; the others follow it.
_OTHER = "\x00"


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(items: list[tuple], size: int) -> dict[tuple[bytes, ...], list[str]]:
    """Window -> the items that have it. An item of fewer words is one window."""
    found: dict[tuple, set] = {}
    for item_id, text in items:
        w = words((text or "").encode())
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    return {k: sorted(map(str, ids - {None})) for k, ids in found.items()}


def symbols(vocabulary: list[bytes]) -> dict[bytes, str]:
    """A character for each word, surrogates left out."""
    return {w: chr(k + 1 if k + 1 < 0xD800 else k + 0x801) for k, w in enumerate(vocabulary)}


def _automaton(key: str, patterns: list[str]) -> ahocorasick.Automaton:
    """Compiled once in each Python worker."""

    def make():
        a = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            a.add_word(p, i)
        if patterns:
            a.make_automaton()
        return a

    return resident("decontaminate", key, make)


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code-point offsets in ``text`` of each run of hit words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))  # code points before a byte
    return [{"start": int(points[at[i][0]]), "end": int(points[at[j - 1][1]])} for i, j in zip(edges[::2], edges[1::2])]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  max_benchmark_bytes: int = 64 << 20, max_states: int = 5_000_000, keep: bool = False) -> DataFrame:
    """Mark the document words that lie in a benchmark window of ``size`` words.

    Null texts have no words. A null item id marks words but is not listed. Repeated items and rows are kept as they
    are. The benchmark is collected only after its size was checked, and broadcast only after the automaton's was:
    beyond ``max_benchmark_bytes``, ``max_states`` (words of all windows; a state takes about 100 bytes in each Python
    worker) or the million symbols that there are, the call fails rather than drop windows (scan such a benchmark in
    several calls). ``keep``: text and others (all other columns, whatever their names, as a struct) follow. An empty
    table gives an empty result. Texts of any length are scanned whole, in time in proportion to their length.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    n_bytes = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    if n_bytes > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {n_bytes} bytes, more than max_benchmark_bytes={max_benchmark_bytes}")
    found = windows([tuple(r) for r in items.collect()], size)
    vocabulary = sorted({w for window in found for w in window})
    n_states = sum(map(len, found))
    if n_states > max_states or len(vocabulary) > 1_000_000:
        raise ValueError(f"the automaton would have {n_states} states over {len(vocabulary)} words, more than max_states={max_states} or a million words")
    symbol = symbols(vocabulary)
    patterns = ["".join(map(symbol.__getitem__, window)) for window in found]
    key = hashlib.sha256(b"\n".join(b" ".join(w) for w in found)).hexdigest()
    shared = spark.sparkContext.broadcast((symbol, patterns, list(found.values())))

    rows = packed(docs, id_col, text_col)
    rows = rows if keep else rows.drop("others")
    schema = StructType([*StructType.fromDDL(SCHEMA).fields, *(rows.schema.fields[1:] if keep else ())])

    def scan(batches):
        symbol, patterns, meaning = shared.value
        automaton = _automaton(key, patterns)
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out = defaultdict(list)
            for text in each(batch.column(1).cast(pa.binary())):
                text = text or b""
                w = words(text)
                hit, ids = np.zeros(len(w), bool), set()
                for end, i in automaton.iter("".join([symbol.get(x, _OTHER) for x in w])) if patterns and w else ():
                    hit[end + 1 - len(patterns[i]) : end + 1] = True
                    ids.update(meaning[i])
                n_hit = int(hit.sum())
                out["n_words"].append(len(w))
                out["n_hit"].append(n_hit)
                out["n_items"].append(len(ids))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() if ids else none)
                out["contaminated"].append(n_hit > 0)
                out["spans"].append(_spans(text, hit) if n_hit else [])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds)] or [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, *batch.columns[1 if keep else 3 :]], names=schema.names)

    return rows.mapInArrow(scan, schema)
