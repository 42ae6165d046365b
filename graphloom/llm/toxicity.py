"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the sum over all subsequences of three characters (with marks for the ends of the word), each
counted with a decay for every character that the subsequence skips; so an insult with inserted characters stays close
to the insult. The machine is trained on words of labelled documents, whose labels belong to the document and not to
the word: training alternates between choosing the words that witness a toxic document and fitting the machine to them
(multiple-instance learning). A document's score comes from its strongest words.

A kernel machine over landmarks is linear in the subsequences, so it is folded into one weight for each subsequence of
the landmarks, and every distinct word of a batch is scored once. A document's score is the margin of a second support
vector machine, over the values that the kernel machine gives its words, mapped to 0..1 by a fitted sigmoid.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import each, packed, resident

DECAY, SPAN = 0.55, 6
#: The second and third place of a subsequence, after the first.
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
#: Marks an empty slot of the table; keys have 63 bits.
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_WEIGHT = np.array([DECAY ** (b - 2) for _, b in _GAPS], np.float32)


def units(text: str) -> list[str]:
    """Lower-cased words; runs of single characters (s p a c e d insults) count as one word, too."""
    words = text.lower().split()
    run: list[str] = []
    more = []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            more.append("".join(run))
        run = []
    if len(run) > 2:
        more.append("".join(run))
    return words + more


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence key, weight) of each place; weights are scaled so that a word's squares sum to 1."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    parts = []
    for (a, b), weight in zip(_GAPS, _WEIGHT):
        i = np.flatnonzero(word[:-b] == word[b:]) if len(word) > b else np.zeros(0, np.int64)
        key = (chars[i] << np.uint64(42)) | (chars[i + a] << np.uint64(21)) | chars[i + b]
        parts.append((word[i], key, np.full(len(i), weight, np.float32)))
    w, key, value = (np.concatenate(x) for x in zip(*parts))
    norm = np.sqrt(np.bincount(w, value.astype(np.float64) ** 2, len(words)))
    return w, key, value / np.maximum(norm, 1e-9)[w].astype(np.float32)


@dataclass
class Machine:
    """Subsequence weights in an open hash table with linear probing, and the document layer (margin and sigmoid in one)."""

    keys: np.ndarray
    weights: np.ndarray
    multiplier: int
    bias: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    final: np.ndarray | None = None

    @staticmethod
    def fold(keys: np.ndarray, weights: np.ndarray, bias: float) -> Machine:
        bits = max(12, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        m = int(np.random.default_rng(1).integers(1 << 62)) | 1
        table, values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float32)
        slot = ((keys * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):  # of the keys at one empty slot the first stays, the others go on to the next slot
            at, first = np.unique(slot[left], return_index=True)
            free = table[at] == _EMPTY
            table[at[free]], values[at[free]] = keys[left[first[free]]], weights[left[first[free]]]
            left = np.delete(left, first[free])
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
        return Machine(table, values, m, bias)

    def words(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word, or for its letters alone if that is higher."""
        out = self._values(words)
        mixed = [(i, letters) for i, w in enumerate(words) if not w.isalpha() and (letters := "".join(filter(str.isalpha, w)))]
        if mixed:
            at = [i for i, _ in mixed]
            out[at] = np.maximum(out[at], self._values([w for _, w in mixed]))
        return out

    def _values(self, words: list[str]) -> np.ndarray:
        out, bits = np.full(len(words), self.bias, np.float64), int(np.log2(len(self.keys)))
        for start, end in _blocks(words, 1 << 14):
            w, key, value = _features(words[start:end])
            slot = ((key * np.uint64(self.multiplier)) >> np.uint64(64 - bits)).astype(np.int64)
            got = np.where(self.keys[slot] == key, self.weights[slot], 0)
            open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != _EMPTY))
            while len(open_):  # another key is there: go on until the key or an empty slot
                slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
                there = self.keys[slot[open_]]
                got[open_] = np.where(there == key[open_], self.weights[slot[open_]], 0)
                open_ = open_[(there != key[open_]) & (there != _EMPTY)]
            out[start:end] += np.bincount(w, got * value, end - start)
        return out

    def documents(self, summary: np.ndarray) -> np.ndarray:
        z = np.concatenate(((summary - self.center) / self.scale, np.ones((len(summary), 1))), 1)
        return _sigmoid(z @ self.final)


TOP = 6


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summarise(values: np.ndarray) -> np.ndarray:
    """What the document layer sees of the values of a document's distinct words."""
    top = np.full(TOP, -1.5)
    if len(values):
        best = np.sort(np.partition(values, max(0, len(values) - TOP))[-TOP:])[::-1]
        top[: len(best)] = np.clip(best, -1.5, 1.5)
    n = len(values)
    return np.concatenate((top, [np.log1p(n), np.log1p(np.sum(values > 0)), np.log1p(np.sum(values > 0.5)), np.sum(values > 0) / (n + 5)]))


def _kernel(words: list[str], landmark_keys: np.ndarray, landmark_rows: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Kernel values of words and landmarks; ``landmark_rows``: for each known subsequence its weight in each landmark.

    Works through blocks of places, however long the words are.
    """
    out = np.zeros((len(words), landmark_rows.shape[1]), np.float32)
    for start, end in _blocks(words, 4096):
        w, key, value = _features(words[start:end])
        at = np.searchsorted(landmark_keys, key)
        at[at == len(landmark_keys)] = 0
        ok = landmark_keys[at] == key
        w, at, value = w[ok], at[ok], value[ok]
        for k in range(0, len(w), block):
            order = np.argsort(w[k : k + block], kind="stable") + k
            rows = landmark_rows[at[order]] * value[order, None]
            heads = np.flatnonzero(np.concatenate(([True], w[order][1:] != w[order][:-1])))
            out[start + w[order][heads]] += np.add.reduceat(rows, heads)
    return out


def _blocks(words: list[str], most: int):
    """(start, end): runs of words of at most ``most`` characters together, or of one word."""
    start = 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (size == 0 or size + len(words[end]) < most):
            size += len(words[end]) + 2
            end += 1
        yield start, end
        start = end


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1.0, rounds: int = 25, block: int = 1 << 11) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows inside the margin.

    Sums over blocks of rows; only a block of them is ever held in double precision.
    """
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    active = None
    for _ in range(rounds):
        square, right, inside = np.diag(ridge), np.zeros(len(w)), np.zeros(len(x), bool)
        for start in range(0, len(x), block):
            part = slice(start, start + block)
            z = np.concatenate((x[part], np.ones((len(x[part]), 1), x.dtype)), 1).astype(np.float64)
            inside[part] = near = y[part] * (z @ w) < 1
            z = z[near]
            a = z * cost[part][near, None]
            square += a.T @ z
            right += a.T @ y[part][near]
        if active is not None and (inside == active).all():
            break
        active = inside
        w = np.linalg.solve(square, right)
    return w[:-1], float(w[-1])


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    z = np.concatenate((x, np.ones((len(x), 1))), 1)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], landmarks: int = 320, rounds: int = 5, seed: int = 7, hard: int = 12_000, easy: int = 8_000) -> Machine:
    """Train on whole labelled texts: the words first, then the document layer on what they say.

    ``hard``, ``easy``: of the words of clean documents, each round of the fit takes at most so many of those that look
    worst (the ones that look so in most documents) and so many drawn from the rest.
    """
    number: dict[str, int] = {}
    docs = [np.array(sorted({number.setdefault(u, len(number)) for u in units(t)}), np.int64) for t in texts]
    words, y = list(number), np.array(labels)
    del number
    if not words or len(set(labels)) < 2:
        base = float(y.mean()) if len(y) else 0.0
        m = Machine.fold(np.zeros(1, np.uint64), np.zeros(1, np.float32), 0.0)
        n = TOP + 4
        m.center, m.scale, m.final = np.zeros(n), np.ones(n), np.append(np.zeros(n), np.log((base + 1e-3) / (1 - base + 1e-3)))
        return m
    machine = _fit_words(words, docs, y, landmarks, rounds, seed, hard, easy)
    values = machine.words(words)
    summary = np.stack([summarise(values[d]) for d in docs])
    machine.center, machine.scale = summary.mean(0), summary.std(0) + 1e-6
    z = (summary - machine.center) / machine.scale
    coefficient, bias = _fit_svm(z, np.where(y == 1, 1.0, -1.0), np.ones(len(y)))
    slope, shift = _fit_logistic((z @ coefficient + bias)[:, None], y.astype(float), 1e-3)
    machine.final = np.append(slope * coefficient, slope * bias + shift)
    return machine


def _fit_words(words: list[str], docs: list[np.ndarray], y: np.ndarray, landmarks: int, rounds: int, seed: int, n_hard: int, n_easy: int) -> Machine:
    """The word machine, from documents as arrays of places in ``words``."""
    rng = np.random.default_rng(seed)
    # first guess: how much likelier a word's subsequences are in toxic documents than in clean ones
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs)
    n_docs = np.array([(y == 0).sum(), (y == 1).sum()], float)
    in_class = np.stack([np.bincount(flat, (y[doc] == c).astype(float), len(words)) for c in (0, 1)])
    del doc, flat
    blocks = list(_blocks(words, 1 << 16))
    slot = lambda key: ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)).astype(np.int64)
    seen = np.zeros((2, 1 << 23), np.float32)
    for start, end in blocks:
        w, key, value = _features(words[start:end])
        at, place = np.unique(slot(key), return_inverse=True)
        for c in (0, 1):
            seen[c, at] += np.bincount(place, in_class[c][w + start] * value) / n_docs[c]
    seen += 1e-3
    odds = np.log(np.divide(seen[1], seen[0], out=seen[1]), out=seen[1])
    values = np.zeros(len(words))
    for start, end in blocks:
        w, key, value = _features(words[start:end])
        part = np.bincount(w, odds[slot(key)] * value)
        values[start : start + len(part)] = part
    del seen, odds, w, key, value, at, place, part
    machine = None
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for r in range(rounds):
        positive = []
        for d in toxic:
            ids = docs[d]
            if len(ids):
                best = ids[np.argsort(-values[ids])[:5]]
                positive.extend(best[:3] if r == 0 else best[:1] if values[best[0]] < 0 else best[values[best] > 0])
        positive = np.array(positive, np.int64)
        hard = [docs[d][np.argsort(-values[docs[d]])[:10]] for d in clean if len(docs[d])]
        inside, often = np.unique(np.concatenate([*hard, np.zeros(0, np.int64)]), return_counts=True)
        best = np.argsort(-often, kind="stable")[:n_hard]
        inside, often = inside[best], often[best]
        clean_words = np.setdiff1d(np.flatnonzero(in_class[0] > 0), inside)
        more = rng.choice(clean_words, min(len(clean_words), n_easy), replace=False)
        negative, weight = np.concatenate((inside, more)), np.concatenate((often, np.full(len(more), 0.5)))
        distinct, times = np.unique(positive, return_counts=True)
        chance = times / times.sum()
        marks = np.concatenate((rng.choice(distinct, min(len(distinct), landmarks // 2), replace=False, p=chance), rng.choice(negative, min(len(negative), landmarks // 2), replace=False, p=weight / weight.sum())))
        names = [words[i] for i in marks]
        w, key, value = _features(names)
        keys, at = np.unique(key, return_inverse=True)
        rows = np.zeros((len(keys), len(names)), np.float32)
        np.add.at(rows, (at, w), value)
        gram = _kernel(names, keys, rows).astype(np.float64)
        spectrum, vectors = np.linalg.eigh((gram + gram.T) / 2)
        good = spectrum > 1e-4
        whiten = vectors[:, good] / np.sqrt(spectrum[good])
        used = np.concatenate((distinct, negative))
        x = (_kernel([words[i] for i in used], keys, rows) @ whiten.astype(np.float32))
        target = np.concatenate((np.ones(len(distinct)), -np.ones(len(negative))))
        cost = np.concatenate((times / times.sum(), 2.0 * weight / weight.sum())) * 300
        coefficient, bias = _fit_svm(x, target, cost)
        machine = Machine.fold(keys, (rows @ (whiten @ coefficient)).astype(np.float32), bias)
        values = machine.words(words)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 200_000) -> Machine:
    """Fit on at most ``max_rows`` labelled documents that aren't held out (a third of them toxic, if there are so many).

    Of these, documents of more than ``max_chars`` characters are left out, so that the bytes of the sample are bounded,
    too; they are scored like all others. The sample is the rows of smallest hash, the same whatever the partitioning. Conflicting labels of one id count as
    toxic; null labels, ids and texts are left out.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for toxic, share in ((1, max_rows // 3), (0, max_rows - max_rows // 3)):
        part = marked.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share)
        chosen = part if chosen is None else chosen.union(part)
    # at most max_rows ids; the sample is fitted in one task, whose memory that bounds
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= max_chars).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])

    def fitted(batches):
        resident("toxicity")
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, marks))], pa.binary())], names=["machine"])

    one = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    found = one.mapInArrow(fitted, "machine binary").first()
    return pickle.loads(found["machine"]) if found else fit([], [])


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; null texts count as empty, and score as such.

    ``keep``: text and others (all other columns, whatever their names, as a struct) follow. Null ids and repeated rows
    stay; an empty table gives an empty result. Texts of any length are scored whole, from all of their words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        resident("toxicity")
        machine = shared.value
        numbers, values, most = _Numbers(), np.zeros(0), 150_000

        for batch in batches:
            summaries, waiting, size = [], [], 0

            def flush():
                nonlocal values
                values = np.concatenate((values, machine.words(list(islice(numbers, len(values), None)))))
                summaries.extend(summarise(values[ids]) for ids in waiting)
                waiting.clear()
                if len(numbers) > most:  # keep the words that were met first: the frequent ones are among them
                    kept = list(islice(numbers.items(), most // 2))
                    numbers.clear()
                    numbers.update(kept)
                    values = values[: most // 2].copy()

            for text in each(batch.column(1)):
                waiting.append(np.fromiter({numbers[u] for u in units(text or "")}, np.int64))
                size += len(text or "")
                if size > 4 << 20 or len(numbers) > most:
                    flush()
                    size = 0
            flush()
            scores = machine.documents(np.stack(summaries)) if summaries else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), *batch.columns[1 if keep else 3:]], names=["doc_id", "score", *(["text", "others"] if keep else [])])

    rows = packed(docs, id_col, text_col)
    rows = rows if keep else rows.drop("others")
    kept = StructType([*rows.schema.fields[1:]]) if keep else StructType()
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *kept.fields])
    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *kept.names)
