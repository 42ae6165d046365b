"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

Equal strings of ``length`` symbols have the same minimizer at the same place. So a text is cut into overlapping
segments, one for each minimizer, that hold every window of ``length`` symbols exactly once, and equal windows can only
be in segments with equal minimizers. Segments that are equal as a whole (by a 128-bit digest) are settled by counting.
Where different segments share a minimizer, their contents are brought together: a run-length compressed BWT with the
suffix-array samples of its run heads is built over them, and the matching statistics, streamed from those samples,
mark the long matches.

The same is done with two kinds of symbols: bytes, whose long matches are removed, and words, whose long matches in
other documents are reported as passages.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .rolling import Rolling

BYTES, WORDS = 0, 1
#: Symbols of the substrings among which the minimizer is chosen.
_GRAM = {BYTES: 32, WORDS: 4}
#: Low bits of a minimizer's value hold its place.
_PLACE = np.uint64((1 << 32) - 1)
#: Owner of a segment that stands in several documents.
_SEVERAL = 0


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def word_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    blank = np.concatenate(([True], _SPACE[np.frombuffer(text, np.uint8)], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def symbols(text: bytes, unit: int, rolling: Rolling) -> np.ndarray:
    """The bytes, or a hash of each word."""
    return np.frombuffer(text, np.uint8) if unit == BYTES else rolling.of(*word_ends(text))


def symbols_of(parts: list[bytes], unit: int) -> list[np.ndarray]:
    if unit == BYTES:
        return [np.frombuffer(p, np.uint8) for p in parts]
    joined = b"\n".join(parts)
    first, end = word_ends(joined)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return np.split(Rolling(joined).of(first, end), np.searchsorted(first, begins[1:]))


def minimizers(rolling: Rolling, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text of ``length`` symbols or more: (first window, end of windows, minimizer hash)."""
    gram = min(gram, length)
    h = rolling.every(gram)
    w = length - gram + 1
    n = len(rolling.sums) - length
    v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the least hash, the leftmost of equal ones
    padded = np.concatenate((v, np.full(-len(v) % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    return first, np.append(first[1:], n), h[chosen[first]].view(np.int64)


def digests(text: np.ndarray, first: np.ndarray, end: np.ndarray, unit: int) -> np.ndarray:
    """A row of two longs, the 128-bit digest, for each [first, end) of the symbols."""
    view, size = memoryview(text.tobytes()), text.itemsize
    one = partial(xxhash.xxh3_128_digest, seed=unit)
    raw = b"".join([one(view[a:b]) for a, b in zip((first * size).tolist(), (end * size).tolist())])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


class RunIndex:
    """Run-length compressed BWT of several strings of symbols, each with an end mark of its own.

    ``heads``: text places of the suffixes that start a BWT run, ascending; ``before``: the suffix one place up in the
    suffix array; ``common``: how much both have in common. These samples give both for every other place.
    """

    def __init__(self, strings: list[np.ndarray]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        n = self.n = int((self.lengths + 1).sum())
        inside = np.ones(n, bool)
        inside[self.starts + self.lengths] = False
        flat = np.concatenate(strings)
        if flat.dtype != np.uint8:
            flat = np.unique(flat, return_inverse=True)[1]
        text = np.zeros(n, np.int64)
        text[inside] = flat
        largest = int(text.max()) + 1
        text[~inside] = largest + np.arange(len(strings))
        order = self._suffixes(text, inside, largest)
        bwt = text[order - 1]
        head = np.concatenate(([True], bwt[1:] != bwt[:-1]))
        self.runs = int(head.sum())
        places, before = order[head], np.concatenate(([-1], order[:-1]))[head]
        by = np.argsort(places)
        self.heads, self.before = places[by], before[by]
        self.common = self._extend(text, self.heads, self.before)

    def _suffixes(self, text: np.ndarray, inside: np.ndarray, largest: int) -> np.ndarray:
        """The suffix array, by prefix doubling of those suffixes alone that still have equals."""
        n, place = self.n, int(self.n).bit_length()
        bits = int(largest + 1).bit_length()
        size = min(8, (63 - place) // bits)
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        padded, live = np.concatenate((text, np.zeros(size, np.int64))), np.concatenate((inside, np.zeros(size, bool)))
        for k in range(size):  # up to the end mark; marks sort first, and among themselves by their place
            open_ &= live[k : k + n]
            key = (key << bits) | np.where(open_, padded[k : k + n] + 1, 0)
        mask = (1 << place) - 1
        packed = np.sort((key << place) | np.arange(n))
        order, key = packed & mask, packed >> place
        first = np.concatenate(([True], key[1:] != key[:-1])) | ~open_[order]
        del padded, live, packed, key, open_
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        while len(slots := np.flatnonzero(~(first & np.append(first[1:], True)))):
            at = order[slots]
            if 3 * place < 64:  # the place goes into the sorted value, too
                packed = np.sort((rank[at] << (2 * place)) | (rank[at + size] << place) | at)
                at, key = packed & mask, packed >> place
            else:
                key = (rank[at] << place) | rank[at + size]
                by = np.argsort(key)
                at, key = at[by], key[by]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            order[slots], first[slots] = at, new
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            size *= 2
        return order

    @staticmethod
    def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 16) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        padded = np.concatenate((text, np.arange(1 << 40, (1 << 40) + step)))
        live = np.flatnonzero(b >= 0)
        while len(live):
            at = np.arange(step)
            equal = padded[(a[live] + out[live])[:, None] + at] == padded[(b[live] + out[live])[:, None] + at]
            run = np.where(equal.all(1), step, equal.argmin(1))
            out[live] += run
            live = live[run == step]
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place: the longest match with the suffix before it in sorted order, and where that stands."""
        i = np.arange(self.n)
        sample = np.searchsorted(self.heads, i, "right") - 1
        gone = i - self.heads[sample]
        return self.common[sample] - gone, self.before[sample] + gone

    def long_matches(self, length: int, owners: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(string, first, end): runs of places at which a match of ``length`` symbols starts that also starts elsewhere.

        With ``owners``, the document of each string (or ``_SEVERAL``), a match counts only if another document has it.
        """
        match, other = self.matching_statistics()
        long = np.flatnonzero(match >= length)
        marked = np.zeros(self.n + 1, np.int8)
        marked[long] = 1
        marked[other[long]] = 1
        if owners is not None and len(long):
            # matches of one string are a chain of neighbours; each is told by the place that begins it
            begin = np.arange(self.n)
            begin[long] = other[long]
            while not np.array_equal(further := begin[begin], begin):
                begin = further
            places = np.flatnonzero(marked[:-1])
            owner = owners[np.searchsorted(self.starts, places, "right") - 1]
            mixed = np.zeros(self.n, bool)
            mixed[begin[places[(owner != owners[np.searchsorted(self.starts, begin[places], "right") - 1]) | (owner == _SEVERAL)]]] = True
            marked[places] = mixed[begin[places]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marked))))
        string = np.searchsorted(self.starts, edges[::2], "right") - 1
        return [(int(s), int(a - self.starts[s]), int(b - self.starts[s])) for s, a, b in zip(string, edges[::2], edges[1::2])]


def _cut(sizes: dict[int, int]):
    """Segments of each text: (h1, h2, key, lo, hi, width, starts); a class of equal segments in a text is one row.

    The lowest bit of ``key`` is the unit; ``lo`` and ``hi`` are the digest of the segment.
    """
    names = ["h1", "h2", "key", "lo", "hi", "width", "starts"]

    def run(batches):
        out: list[list] = [[] for _ in range(6)]
        starts, counts, held = [], [], 0
        for batch in batches:
            for text, h1, h2 in zip(*(batch.column(i).cast(pa.binary() if i == 0 else pa.int64()).to_pylist() for i in range(3))):
                if text is None or len(text) < min(sizes.values()):
                    continue
                rolling = Rolling(text)
                for unit, length in sizes.items():
                    s = symbols(text, unit, rolling)
                    if len(s) < length:
                        continue
                    first, end, key = minimizers(rolling if unit == BYTES else Rolling(s), length, _GRAM[unit])
                    whole = digests(s, first, end - 1 + length, unit)
                    low = whole[:, 0].tolist()
                    at, n = np.arange(len(first)), np.ones(len(first), np.int64)
                    if len(set(low)) < len(low):
                        _, at, inverse, n = np.unique(whole, axis=0, return_index=True, return_inverse=True, return_counts=True)
                        starts.append(first[np.argsort(inverse.ravel(), kind="stable")])
                    else:
                        starts.append(first)
                    for column, values in zip(out, (np.full(len(at), h1), np.full(len(at), h2), (key[at] & ~1) | unit, whole[at, 0], whole[at, 1], (end - first)[at])):
                        column.append(values)
                    counts.append(n)
                    held += len(first)
                if held > 1 << 14:
                    yield batch_of(out, starts, counts)
                    out, starts, counts, held = [[] for _ in range(6)], [], [], 0
        yield batch_of(out, starts, counts)

    def batch_of(out, starts, counts):
        cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(cat(counts)))).astype(np.int32)
        *longs, width = (cat(c) for c in out)
        return pa.RecordBatch.from_arrays([*map(pa.array, longs), pa.array(width, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cat(starts), pa.int32()))], names=names)

    return run


def _structs(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a column of lists of numeric structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    return column.offsets.to_numpy(), {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}


def _fetch(sizes: dict[int, int]):
    """The bytes of the segments that a text must hand out."""

    def run(batches):
        for batch in batches:
            offsets, f = _structs(batch.column(1))
            parts: list[bytes] = []
            size, done = 0, offsets[0]

            def fetched(end: int) -> pa.RecordBatch:
                columns = [pa.array(f[name][done:end], pa.int64()) for name in ("key", "lo", "hi", "owner", "bytes")]
                return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names=["key", "lo", "hi", "owner", "bytes", "part"])

            for text, a, b in zip(batch.column(0).cast(pa.binary()).to_pylist(), offsets, offsets[1:]):
                words = word_ends(text) if (f["key"][a:b] & 1).any() else None
                for key, start, width in zip(f["key"][a:b].tolist(), f["start"][a:b].tolist(), f["width"][a:b].tolist()):
                    end = start + width - 1 + sizes[key & 1]
                    parts.append(text[words[0][start] : words[1][end - 1]] if key & 1 else text[start:end])
                    size += len(parts[-1])
                if size > 4 << 20:
                    yield fetched(b)
                    parts, size, done = [], 0, b
            yield fetched(offsets[-1])

    return run


_MARKS = "lo long, hi long, first int, end int"


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["lo", "hi", "first", "end"])


def _match(sizes: dict[int, int], block: int):
    """Rows sorted by key; whole keys of a unit are indexed together while they fit a block, a larger key alone."""

    def run(batches):
        held: dict[int, list] = {u: [] for u in sizes}
        size, last = dict.fromkeys(sizes, 0), None

        def done(unit):
            rows, held[unit], size[unit] = held[unit], [], 0
            index = RunIndex(symbols_of([r[3] for r in rows], unit))
            found = index.long_matches(sizes[unit], np.array([r[2] for r in rows]) if unit == WORDS else None)
            return _marks([(*rows[s][:2], a, b) for s, a, b in found])

        for batch in batches:
            for key, lo, hi, owner, n_bytes, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                unit = key & 1
                if key != last:
                    if held[unit] and size[unit] + n_bytes > block:
                        yield done(unit)
                    size[unit] += n_bytes
                last = key
                held[unit].append((lo, hi, owner, part))
        for unit in sizes:
            if held[unit]:
                yield done(unit)

    return run


def _windows(sizes: dict[int, int]):
    """For minimizers with very many different segments: a row for each window, to be counted by its digest."""

    def run(batches):
        for batch in batches:
            for key, lo, hi, owner, _, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                unit = key & 1
                s = symbols(part, unit, Rolling(part))
                first = np.arange(len(s) - sizes[unit] + 1)
                d = digests(s, first, first + sizes[unit], unit)
                same = lambda x: pa.array(np.full(len(first), x))
                yield pa.RecordBatch.from_arrays([same(key), same(lo), same(hi), same(owner), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(first.astype(np.int32))], names=["key", "lo", "hi", "owner", "w1", "w2", "first"])

    return run


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans, ascending, that touch no other."""
    by = np.argsort(lo)
    lo, hi = lo[by], np.maximum.accumulate(hi[by]) if len(hi) else hi
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1]))) if len(lo) else by
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(hi)) - 1].tolist())) if len(lo) else []


_OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage_words": pa.int64()}


def _apply(with_kept: bool):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            offsets, f = _structs(batch.column(2))
            for text, a, b in zip(batch.column(1).cast(pa.binary()).to_pylist(), offsets, offsets[1:]):
                text, at, parts = text or b"", 0, []
                gone, words = (_merged(f["lo"][a:b][of], f["hi"][a:b][of]) for of in (f["unit"][a:b] == BYTES, f["unit"][a:b] == WORDS))
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept = b"".join(parts)
                for column, value in zip(out, (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in words), kept)):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, list(_OUT.values())[1:])]
            more = [pa.array(out[5], pa.binary())] if with_kept else []
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, *more], names=[*_OUT, *["kept"] * with_kept])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 51, block: int = 1 << 20, most: int = 3 << 20, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Remove every byte that lies in a string of ``length`` bytes that starts anywhere else, too.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (words in passages of ``passage`` words
    or more, split at white space, that stand in another row, too; nothing is removed for them), and with ``with_kept``
    the kept bytes. Strings are judged on the input. Null texts count as empty; null ids and repeated rows are kept (a
    repeated text of ``length`` bytes or more loses all of them); an empty table gives an empty result; other columns,
    whatever their names, are ignored. Texts of any length are cut whole; no task holds more of one than its segments.

    An index holds whole minimizers until it has ``block`` bytes. The different segments of one minimizer that together
    exceed ``most`` bytes are settled by counting the 128-bit digests of their windows instead.
    """
    sizes = {BYTES: length, WORDS: passage}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    cut = keyed.select("text", "h1", "h2").mapInArrow(_cut(sizes), "h1 long, h2 long, key long, lo long, hi long, width int, starts array<int>")
    segments = staged(cut, "segments")
    is_word = F.col("key").bitwiseAND(1) == 1

    # classes of equal segments: what stands twice, or for words in two rows, is repeated as a whole
    first = F.min(F.struct("h1", "h2", F.element_at("starts", 1).alias("start"), "key", "width"))
    classes = segments.groupBy("lo", "hi").agg(F.sum(F.size("starts")).alias("n"), F.count(F.lit(1)).alias("n_rows"), first.alias("at"))
    classes = classes.select("lo", "hi", "at.*", "n_rows", F.when(is_word, F.col("n_rows")).otherwise(F.col("n")).alias("n"))
    per_symbol = F.when(is_word, 8).otherwise(1)
    content = (F.col("width") - 1 + F.when(is_word, passage).otherwise(length)) * per_symbol
    keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum(content).alias("bytes")).where("different > 1").select("key", "bytes")
    classes = staged(classes.join(keys, "key", "left").where("n > 1 or bytes is not null"), "classes")

    # contents of one segment of each class whose minimizer has others
    owner = F.when(F.col("n_rows") > 1, _SEVERAL).otherwise(F.when(F.col("h1") == _SEVERAL, 1).otherwise(F.col("h1")))
    wanted = classes.where("bytes is not null").groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "lo", "hi", "start", "width", "bytes", owner.alias("owner"))).alias("wanted"))
    # equal texts are one before they are shuffled; so each segment is handed out once
    distinct = keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    fetched = distinct.join(wanted, ["h1", "h2"]).select("text", "wanted").mapInArrow(_fetch(sizes), "key long, lo long, hi long, owner long, bytes long, part binary")
    parts = staged(fetched, "parts")
    few = parts.where(F.col("bytes") <= most)
    marks = few.repartition("key").sortWithinPartitions("key").mapInArrow(_match(sizes, block), _MARKS)
    many = parts.where(F.col("bytes") > most)
    windows = many.mapInArrow(_windows(sizes), "key long, lo long, hi long, owner long, w1 long, w2 long, first int")
    counted = windows.groupBy("key", "w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("o1"), F.max("owner").alias("o2"), F.bool_or(F.col("owner") == _SEVERAL).alias("several"))
    again = counted.where((F.col("n") > 1) & (~is_word | F.col("several") | (F.col("o1") != F.col("o2")))).select("key", "w1", "w2")
    many = windows.join(again, ["key", "w1", "w2"]).select("lo", "hi", "first", (F.col("first") + 1).alias("end"))

    whole = classes.where("n > 1").select("lo", "hi", F.lit(0).alias("first"), F.col("width").alias("end"))
    found = staged(whole.union(marks).union(many).distinct(), "marks")
    discard(classes, parts)
    spans = segments.join(found, ["lo", "hi"]).select("h1", "h2", is_word.cast("int").alias("unit"), "first", "end", F.explode("starts").alias("s"))
    reach = F.when(F.col("unit") == WORDS, passage).otherwise(length) - 1
    spans = spans.select("h1", "h2", "unit", (F.col("s") + F.col("first")).alias("lo"), (F.col("s") + F.col("end") + reach).alias("hi")).distinct()
    marked = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("unit", "lo", "hi")).alias("spans"))
    ready = keyed.join(marked, ["h1", "h2"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"
    return ready.mapInArrow(_apply(with_kept), schema + ", kept binary" * with_kept)
