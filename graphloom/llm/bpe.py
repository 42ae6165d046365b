"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus (counted over all documents) are compiled, with the ids that BPE gives them, into
an acyclic automaton whose common suffixes are shared; numbers summed along a word's path give its place in the table of
id outputs. The automaton is one flat file that each Python worker maps into memory. Words that it lacks are merged
exactly, rank by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
from array import array
from collections import Counter
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, new_path, resident, staged

# Code points (hexadecimal) that newer tables count as letters or numbers, but the tokenizer's don't.
_NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2
1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_NEWER = "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in _NEWER.split())
_LETTER, _NUMBER = rf"[\p{{L}}--[{_NEWER}]]", rf"[\p{{N}}--[{_NEWER}]]"
# White space in the tokenizer's pattern, and that pattern.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+", regex.V1)
#: Whole stretches between white space: the pattern above never looks beyond one, so each different one is split once.
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, by the public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The vocabulary and exact merging, from the text of a tokenizers JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        to_byte = _byte_chars()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode() for s, i in vocab.items()}
        raw |= {i: s.encode() for s, i in self.special.items()}
        n = max(raw) + 1
        self.token_bytes = [raw.get(i, b"") for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_ids[b] = vocab[c]
        self.n, pairs = n, []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((vocab[a] * n + vocab[b], rank, vocab[a + b]))
        self.rank_of = {k: (r, i) for k, r, i in pairs}
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int64)
        self.merged = np.array([p[2] for p in pairs], np.int64)
        self.token_len = np.array([len(t) for t in self.token_bytes], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the sorted merges; a value past the end where there is none."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge_all(self, words: list[bytes], long: int = 48) -> list[np.ndarray]:
        """The ids of each word. Words of one length are merged side by side; those over ``long`` bytes by a heap."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        ranks = np.append(self.ranks, np.iinfo(np.int64).max)
        for length, where in by_length.items():
            if length == 0 or length > long:
                for i in where:
                    out[i] = self._merge_long(words[i])
                continue
            ids = self.byte_ids[np.frombuffer(b"".join([words[i] for i in where]), np.uint8)].reshape(-1, length)
            live, where = np.arange(len(where)), np.array(where)
            while True:
                if ids.shape[1] > 1:
                    at = self._rank(ids[:, :-1], ids[:, 1:])
                    best = ranks[at].argmin(1)
                    place = at[np.arange(len(at)), best]
                    go = place < len(self.keys)
                else:
                    go = np.zeros(len(ids), bool)
                for k, row in zip(live[~go].tolist(), ids[~go]):
                    out[where[k]] = row
                if not go.any():
                    break
                ids, live, best, place = ids[go], live[go], best[go], place[go]
                ids[np.arange(len(ids)), best] = self.merged[place]
                keep = np.arange(ids.shape[1])[None, :] != best[:, None] + 1
                ids = ids[keep].reshape(len(ids), -1)
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.rank_of.get(ids[i] * self.n + ids[after[i]])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            push(i)
            push(before[i])
        return np.array([i for i in ids if i >= 0], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.token_len[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.token_flat[np.repeat(self.token_at[ids] - ends + lens, lens) + np.arange(total)].tobytes()
        return raw.decode("utf-8", "replace").encode()


class Lexicon:
    """Flat arrays of the automaton: sorted keys (state * 256 + byte), target, number to add, final states, outputs."""

    FIELDS = ("keys", "target", "add", "final", "out_at", "out")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def compile(words: list[bytes], outputs: list[np.ndarray]) -> Lexicon:
        """Minimal acyclic automaton of the sorted ``words``, built word by word with a register of finished states."""
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = []
        finals: list[bool] = []
        path: list[tuple[bool, dict]] = [(False, {})]  # states of the last word, not finished yet

        def finish(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                key = (final, tuple(out.items()))
                if key not in register:
                    register[key] = len(arcs)
                    arcs.append(out)
                    finals.append(final)
                path[-1][1][last[len(path) - 1]] = register[key]

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            finish(common, last)
            path.extend((False, {}) for _ in range(len(word) - common))
            path[-1] = (True, path[-1][1])
            last = word
        finish(0, last)
        arcs.append(path[0][1])
        finals.append(path[0][0])
        root, n_words = len(arcs) - 1, [0] * len(arcs)
        rows = []
        for s, out in enumerate(arcs):  # targets come before their sources
            seen = int(finals[s])
            for byte, t in out.items():
                rows.append((((root - s) << 8) | byte, root - t, seen))
                seen += n_words[t]
            n_words[s] = seen
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        at = np.concatenate(([0], np.cumsum([len(o) for o in outputs]))).astype(np.int64)
        out = np.concatenate([*outputs, np.zeros(0, np.int64)]).astype(np.int64)
        return Lexicon({"keys": table[:, 0].copy(), "target": table[:, 1].copy(), "add": table[:, 2].copy(), "final": np.array(finals[::-1], np.int64), "out_at": at, "out": out})

    def to_bytes(self) -> bytes:
        head = json.dumps([len(getattr(self, f)) for f in self.FIELDS]).encode().ljust(256)
        return head + b"".join(np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS)

    @staticmethod
    def mapped(path: str) -> Lexicon:
        with open(path, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, arrays = 256, {}
        for name, n in zip(Lexicon.FIELDS, json.loads(whole[:256])):
            arrays[name] = np.frombuffer(whole, np.int64, n, at)
            at += 8 * n
        return Lexicon(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't in the lexicon; all words take a step together."""
        lens = np.array([len(w) for w in words], np.int64)
        at = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(words) else lens
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, step = np.flatnonzero(lens > 0), 0
        dead = lens == 0
        while len(live) and len(self.keys):
            key = (state[live] << 8) | flat[at[live] + step]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            ok = self.keys[found] == key
            dead[live[~ok]] = True
            live, found = live[ok], found[ok]
            state[live] = self.target[found]
            number[live] += self.add[found]
            step += 1
            live = live[lens[live] > step]
        good = ~dead & (self.final[state] == 1) if len(self.keys) else np.zeros(len(words), bool)
        return np.where(good, number, -1)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, remembering at most about ``most`` different stretches at a time."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon, most: int = 250_000):
        self.bpe, self.lexicon, self.most, self.keep = bpe, lexicon, most, most // 2
        self.numbers = _Numbers()
        self.flat, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the stretches that were met first: the frequent ones are among them."""
        self.numbers = _Numbers(islice(self.numbers.items(), self.keep))
        self.at = self.at[: self.keep + 1]
        self.flat = self.flat[: self.at[-1]].copy()

    def _word_ids(self, words: list[bytes]) -> list[np.ndarray]:
        numbers = self.lexicon.find(words)
        there, missing = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0).tolist()
        ids: list = [None] * len(words)
        out = self.lexicon.out
        for i, a, b in zip(there.tolist(), self.lexicon.out_at[numbers[there]], self.lexicon.out_at[numbers[there] + 1]):
            ids[i] = out[a:b]
        for i, m in zip(missing, self.bpe.merge_all([words[i] for i in missing])):
            ids[i] = m
        return ids

    def _learn(self) -> None:
        """Ids of the stretches that are new."""
        new = list(islice(self.numbers, len(self.at) - 1, None))
        if not new:
            return
        words, parts, sizes = _Numbers(), array("q"), []
        for chunk in new:
            found = _WORDS.findall(chunk)
            parts.extend(map(words.__getitem__, found))
            sizes.append(len(found))
        ids = self._word_ids([w.encode() for w in words])
        lens = np.array([len(x) for x in ids], np.int64)
        starts = np.concatenate(([0], np.cumsum(lens)))
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        parts = np.frombuffer(parts, np.int64)
        grown = np.concatenate(([0], np.cumsum(lens[parts])))
        self.at = np.concatenate((self.at, self.at[-1] + grown[np.cumsum(sizes)]))
        self.flat = np.concatenate((self.flat, _take(flat, starts[parts], lens[parts])))

    def encode(self, texts: Iterable[str], block: int = 4 << 20):
        """Yields the ids of each text, in order; works through blocks of about ``block`` characters."""
        waiting, size = [], 0
        split = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.bpe.special, key=len, reverse=True))) if self.bpe.special else None
        for text in texts:
            parts = split.split(text) if split and any(s in text for s in self.bpe.special) else [text]
            waiting.append([-1 - self.bpe.special[p] if p in self.bpe.special else np.array(list(map(self.numbers.__getitem__, _CHUNKS.findall(p))), np.int64) for p in parts if p])
            size += len(text)
            if size >= block or len(self.numbers) > self.most:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list):
        self._learn()
        for parts in waiting:
            done = [np.array([-1 - p]) if isinstance(p, int) else _take(self.flat, self.at[p], self.at[p + 1] - self.at[p]) for p in parts]
            yield done[0] if len(done) == 1 else np.concatenate([*done, np.zeros(0, np.int64)])
        if len(self.numbers) > self.most:
            self._forget()


def _take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + len]."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lens, lens) + np.arange(total)]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (UTF-8 bytes) -> n over all documents."""

    def count(batches):
        resident("words")
        chunks: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for w in _WORDS.findall(chunk):
                    words[w] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in each(batch.column(0)):
                chunks.update(_CHUNKS.findall(text or ""))
                if len(chunks) > 300_000:
                    yield counted()
        yield counted()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int, text_col: str = "text") -> list[bytes]:
    """The words that occur most often, about ``size`` at most, sorted; words that occur once are left out.

    A histogram of the counts (a few hundred rows) gives the least count to take; of the last step of the histogram, that
    share of words (by hash) which there is room for. So no task sends more to the driver than its share of the answer.
    """
    counts = staged(count_words(docs, text_col).where("n > 1 and length(word) <= 64").withColumn("step", F.floor(F.log2("n") * 16)), "word-counts")
    least, total, share = 1 << 30, 0, 1.0
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        least = r["step"]
        if total + r["count"] > size:
            share = (size - total) / r["count"]
            break
        total += r["count"]
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    chosen = counts.where((F.col("step") > least) | ((F.col("step") == least) & drawn))
    return sorted(bytes(r["word"]) for r in chosen.select("word").collect())


def share_lexicon(docs: DataFrame, bpe: Bpe, size: int, text_col: str = "text") -> str:
    """Compile the ``size`` most frequent words and hand the file to all executors; its name."""
    spark = docs.sparkSession
    words = frequent_words(docs, size, text_col)
    data = Lexicon.compile(words, bpe.merge_all(words)).to_bytes()
    path = new_path(spark, "lexicon")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(data)
    stream.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def _encoder(name: str, source: str) -> Encoder:
    """One for each Python worker; what it has met serves the worker's next tasks."""
    return resident("bpe", name, lambda: Encoder(Bpe(source), Lexicon.mapped(SparkFiles.get(name))))


def encode_documents(docs: DataFrame, tokenizer_path: str, lexicon_size: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Columns: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8), and
    with ``with_ids`` also ids and decoded. Null texts count as empty. Null ids and repeated rows are kept; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Texts of any length are encoded
    whole. ``lexicon_size`` bounds the automaton, not the words: all others are merged exactly.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    spark = docs.sparkSession
    name = share_lexicon(docs, Bpe(source), lexicon_size, text_col)
    shared = spark.sparkContext.broadcast(source)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def encode(batches):
        encoder = _encoder(name, shared.value)
        bpe = encoder.bpe
        for batch in batches:
            n, first, second, kept, decoded = [], [], [], [], []
            for ids in encoder.encode(t or "" for t in each(batch.column(1))):
                raw = bpe.decode(ids)
                n.append(len(ids))
                first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    kept.append(ids)
                    decoded.append(raw.decode())
            more = [pa.array(kept, pa.list_(pa.int64())), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), *more], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)
