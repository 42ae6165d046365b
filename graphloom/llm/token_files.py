"""Token-ID files: independent zstandard frames, a checksum for each, and a seek table at the end.

A file is a run of zstandard frames (little-endian ids of whole documents), a skippable frame with the document index
(ids, token counts, number of documents in each frame), and a skippable frame with the public zstd seek table
(compressed size, size, low 32 bits of the content's XXH64), so that a reader fetches and decompresses only the frames
of the documents it wants, and any zstd tool reads the rest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, staged

# Fixed values of the public seekable format.
SEEK_MAGIC, SEEK_END, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
NULL_ID = -(1 << 63)


def _open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class TokenWriter:
    """Writes one file. Documents come in order; a frame closes once it holds ``frame_bytes``."""

    def __init__(self, stream, dtype: str, frame_bytes: int = 256 << 10, level: int = 3):
        self.stream, self.dtype, self.frame_bytes = stream, np.dtype(dtype), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting, self.size, self.in_frame = [], 0, 0
        self.ids, self.counts, self.frames, self.seek = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.waiting.append(raw)
        self.size += len(raw)
        self.in_frame += 1
        if self.size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.in_frame:
            raw = b"".join(self.waiting)
            packed = self.zstd.compress(raw)
            self.stream.write(packed)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.frames.append(self.in_frame)
            self.waiting, self.size, self.in_frame = [], 0, 0

    def finish(self) -> None:
        self._close_frame()
        head = struct.pack("<4sII", self.dtype.str.encode().ljust(4), len(self.ids), len(self.frames))
        index = zstandard.ZstdCompressor().compress(head + np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + np.array(self.frames, "<i8").tobytes())
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in [*self.seek, (len(index) + 8, 0, 0)])
        end = struct.pack("<IBI", len(self.seek) + 1, 0x80, SEEK_END)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(end)) + table + end)


class TokenReader:
    """Random access to one file: the tables at its end are read first, then only the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = source.read_at(9, size - 9)
        n, _, magic = struct.unpack("<IBI", tail)
        if magic != SEEK_END:
            raise ValueError("no seek table at the end")
        raw = source.read_at(12 * n, size - 9 - 12 * n)
        seek = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.at = np.concatenate(([0], np.cumsum([x[0] for x in seek]))).tolist()
        self.seek = seek[:-1]
        index = zstandard.ZstdDecompressor().decompress(source.read_at(seek[-1][0] - 8, self.at[-2] + 8))
        kind, n_docs, n_frames = struct.unpack_from("<4sII", index)
        self.dtype = np.dtype(kind.decode().strip())
        arrays = np.frombuffer(index, "<i8", offset=12)
        self.ids, self.counts, self.frames = arrays[:n_docs], arrays[n_docs : 2 * n_docs], arrays[2 * n_docs : 2 * n_docs + n_frames]
        self.first = np.concatenate(([0], np.cumsum(self.frames)))

    def frame(self, k: int) -> list[np.ndarray]:
        """The documents of frame ``k``; raises if the checksum differs."""
        packed, size, checksum = self.seek[k]
        raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, self.at[k]), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        ids = np.frombuffer(raw, self.dtype)
        return np.split(ids, np.cumsum(self.counts[self.first[k] : self.first[k + 1]])[:-1])

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of the first document with this id, from its frame alone."""
        place = int(np.flatnonzero(self.ids == doc_id)[0])
        k = int(np.searchsorted(self.first, place, "right")) - 1
        return self.frame(k)[place - int(self.first[k])]


# White space as the tokenizers library cuts at it; Arrow's function for it cuts at _MORE, too.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_MORE = "[\x1c-\x1f]"
#: Stretches in which lower-casing and composition act on each character alone, and which hold no special token.
_SIMPLE = r"\A[\x{21}-;=-~\x{a1}-\x{12f}]*\z"
#: The words of the tokenizer within simple stretches of lower case, and the end of a stretch.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\n{_LETTER}{_NUMBER}]+")
#: What the tokenizer does before its merges.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class WordEncoder:
    """The tokenizers library over the words of ``word_bpe_49k.json``, each different word once.

    That tokenizer cuts at white space and looks at nothing across it. Arrow tells the different stretches between white
    space apart, block by block; simple ones are cut into the tokenizer's words, whose different ones the library encodes
    in long rows, without the steps that leave such words as they are; all other stretches it encodes one by one.
    """

    def __init__(self, path_or_json: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(path_or_json) if path_or_json.lstrip().startswith("{") else Tokenizer.from_file(path_or_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.keep = most, most // 2
        spec = json.loads(self.tokenizer.to_str())
        if any(spec[k] != v for k, v in _STEPS.items()) or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("this tokenizer cuts texts in another way")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        steps = [{"type": "WhitespaceSplit"}, _STEPS["pre_tokenizer"]["pretokenizers"][1]]
        self.merger = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))
        # number 0 is the end of a stretch, without ids
        self.words, self.flat, self.at = _Numbers({"\n": 0}), np.zeros(0, np.int64), np.zeros(2, np.int64)

    def _forget(self) -> None:
        """Keep the words that were met first: the frequent ones are among them."""
        self.words = _Numbers(islice(self.words.items(), self.keep))
        self.at = self.at[: self.keep + 1]
        self.flat = self.flat[: self.at[-1]].copy()

    def encode(self, texts: pa.Array, block: int = 8 << 20):
        """The ids of each text (null: none), some MB of texts at a time."""
        # texts begin a block where the bytes before them fill one
        before = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // block
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
        for start, end in zip(cuts, cuts[1:]):
            yield from self._encode_block(texts.slice(start, end - start).fill_null(""))

    def _encode_block(self, texts: pa.Array):
        if pc.any(pc.match_substring_regex(texts, _MORE)).as_py():
            cut = pc.split_pattern_regex(texts, _SPACE)
        else:
            cut = pc.utf8_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        flat, starts, lens = self._stretches(coded.dictionary)
        codes, ends = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(cut).to_numpy())
        for start, end in zip([0, *ends.tolist()], ends.tolist()):
            parts = codes[start:end]
            yield _take(flat, starts[parts], lens[parts])
        if len(self.words) > self.most:
            self._forget()

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each stretch's are among them: start and number."""
        simple = pc.match_substring_regex(stretches, _SIMPLE).to_numpy(zero_copy_only=False)
        strings = stretches.to_numpy(zero_copy_only=False)
        found = _WORDS.findall("\n".join([*strings[simple], ""]).lower())
        odd = strings[~simple].tolist()
        numbers = np.fromiter(map(self.words.__getitem__, chain(found, odd)), np.int64, len(found) + len(odd))
        self._learn_words()
        n = np.diff(self.at)[numbers]
        last = numbers == 0
        last[len(found) :] = True
        ends = np.cumsum(n)[last]
        order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
        starts, lens = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        lens[order] = np.diff(ends, prepend=0)
        starts[order] = ends - lens[order]
        return _take(self.flat, self.at[numbers], n), starts, lens

    def _learn_words(self) -> None:
        ids, lens = self._encoded(list(islice(self.words, len(self.at) - 1, None)))
        self.flat = np.concatenate((self.flat, ids))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lens)))

    def _encoded(self, words: list[str], row: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        simple = pc.match_substring_regex(pa.array(words, pa.string()), _SIMPLE).to_numpy(zero_copy_only=False)
        simple, odd = np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()
        lens, ids = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)]
        rows = [simple[i : i + row] for i in range(0, len(simple), row)]
        texts = [" ".join([words[i] for i in r]) for r in rows]
        for r, e in zip(rows, self.merger.encode_batch_fast(texts, add_special_tokens=False)):
            found = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != len(r):
                raise ValueError("this tokenizer does not mark the ends of words")
            lens[r] = np.diff(ends, prepend=0)
            ids.append(found)
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            lens[i] = len(e.ids)
            ids.append(np.array(e.ids, np.int64))
        flat, order = np.concatenate(ids), np.array(simple + odd, np.int64)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return _take(flat, starts, lens), lens


def _take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + len]."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - ends + lens, lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(source: str) -> WordEncoder:
    """One for each Python worker; what it has met serves the worker's next tasks."""
    if source not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[source] = WordEncoder(source)
    return _ENCODERS[source]


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, frame_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids in ascending doc_id order, a file for each partition.

    Returns the manifest: part, path, n_docs, n_tokens and ``start``, the ids in all files before. Null ids come first,
    rows with one id are in the order of their texts' hashes, null texts count as empty. A task writes under a name of
    its own and renames at the end, so that a repeated task leaves no half file in the manifest.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    shared = spark.sparkContext.broadcast(source)

    def write(batches):
        encoder = _encoder(shared.value)
        dtype = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        fs, root = _open_folder(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(name + ".open") as stream:
            out = TokenWriter(stream, dtype, frame_bytes)
            end = np.array([end_id], np.int64)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                    out.add(doc_id, np.concatenate((ids, end)))
            out.finish()
        fs.move(name + ".open", name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([len(out.ids)], pa.int64()), pa.array([sum(out.counts)], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    manifest = staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    # a row for each file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files frame by frame."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inside = _open_folder(path)
                with fs.open_input_file(inside) as source:
                    reader = TokenReader(source)
                    for k in range(len(reader.seek)):
                        docs = reader.frame(k)
                        ids = reader.ids[reader.first[k] : reader.first[k + 1]].tolist()
                        lens = np.array([len(d) for d in docs], np.int64)
                        starts = start + np.cumsum(lens) - lens
                        start += int(lens.sum())
                        crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                        yield pa.RecordBatch.from_arrays([pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start")
    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
