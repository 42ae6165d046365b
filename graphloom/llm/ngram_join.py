"""N-gram Jaccard join with several global token orders, exact for the stated threshold.

Two documents that link have a common token among the first ``n - ceil(t n) + 1`` tokens of each, under every global
order of the tokens. Order one puts tokens first that a quarter of the token space (by hash) shows to be in one document
alone: documents whose prefix holds nothing else have no partner, and most documents leave the join here. Among the rest,
the postings of two orders, by document frequency and by hash, are chained: what shares a prefix token with compatible
sizes falls into one group of that order. The filters are intersected: only documents that are in one group under both
orders stay candidates, as a family. Inside a family, pairs must share prefix tokens under three orders (frequency, hash,
another hash) before their sets are compared.

A large family is split into blocks. Each block is verified with the next one; if that already joins all of the family,
no other pair of blocks has to be, and else all others are. Sets are kept as 64-bit hashes of their shingles; documents
with equal sets are one node of the join. A second hash of each set tells if two sets should share their first one.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, each, packed, resident, staged, unpacked
from .components import components, least_of_each

# Odd multipliers of the shingle hash, for the first four positions.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _multipliers(size: int) -> np.ndarray:
    """An odd multiplier for each position, no two alike: words that change places change the sum."""
    return np.array([int(_MIX[k % 4]) * pow(0xFF51AFD7ED558CCD, k // 4, 1 << 64) % (1 << 64) for k in range(size)], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, hashes: dict, size: int = 4) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of ``text``."""
    words = text.lower().split()  # both act on ASCII alone for bytes
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    if len(h) >= size:
        out, mix = np.zeros(len(h) - size + 1, np.uint64), _multipliers(size)
        for k in range(size):
            out += (h[k : len(h) - size + 1 + k] ^ np.uint64(k)) * mix[k]
    elif len(h):
        out = np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    else:
        return np.zeros(0, np.int64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; the first one names it."""
    raw = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (raw >> 64) - (1 << 63), (raw & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _texts(batch: pa.RecordBatch, at: int):
    return (t or b"" for t in each(batch.column(at).cast(pa.binary())))


def _sketch(size: int):
    """Per document: n, signature, its check, and the tokens of the sampled quarter of the token space."""

    def run(batches):
        resident("ngrams")
        hashes = _WordHashes()
        for batch in batches:
            n, sig, check, some = [], [], [], []
            for text in _texts(batch, 1):
                if len(hashes) > 200_000:
                    hashes.clear()
                tokens = shingles(text, hashes, size)
                n.append(len(tokens))
                first, second = _signature(tokens)
                sig.append(first)
                check.append(second)
                some.append(tokens[tokens & 3 == 0])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(check, pa.int64()), _lists(some), batch.column(2)], names=["doc_id", "n", "sig", "check", "some", "text_hash"])

    return run


def _sets(size: int):
    """Of the rows that represent a signature: the signature and the whole set."""

    def run(batches):
        resident("ngrams")
        hashes = _WordHashes()
        for batch in batches:
            sig, sets = [], []
            for want, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                if len(hashes) > 200_000:
                    hashes.clear()
                tokens = shingles(text, hashes, size)
                if _signature(tokens)[0] == want:
                    sig.append(want)
                    sets.append(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), _lists(sets)], names=["sig", "tokens"])

    return run


def least_overlap(n, percent: int):
    """ceil(percent n / 100): the overlap that a set of n tokens needs for a link."""
    return -(-n * percent // 100)


def _chain(percent: int):
    """In (token, n, node) order, links each run of one token and compatible neighbours to the first of the run.

    Also yields the ends of the partition, for the links across.
    """

    def run(batches):
        pid, last, leader, first = TaskContext.get().partitionId(), None, None, True
        names = ["u", "v", "token", "n", "node", "place"]
        kinds = [pa.int64()] * 6

        def end(row, place):
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, *row, 2 * pid + place], kinds)], names=names)

        for batch in batches:
            token, n, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(token):
                continue
            if first:
                yield end((token[0], n[0], node[0]), 0)
                first = False
            if last is not None:
                token, n, node = (np.concatenate(([a], b)) for a, b in zip(last, (token, n, node)))
            begins = np.concatenate(([True], (token[1:] != token[:-1]) | (n[1:] * percent > n[:-1] * 100)))
            run = np.cumsum(begins) - 1
            leaders = node[begins]
            if last is not None:
                leaders[0] = leader
            u, v = least_of_each(leaders[run][~begins], node[~begins])
            nulls = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), nulls, nulls, nulls, nulls], names=names)
            last, leader = (token[-1], n[-1], node[-1]), leaders[-1]
        if last is not None:
            yield end(last, 1)

    return run


class _Group:
    """The sets of one family block; finds links that join what no link joins yet."""

    def __init__(self, sigs: list[int], sets: list[np.ndarray], percent: int):
        order = sorted(range(len(sigs)), key=lambda i: (len(sets[i]), sigs[i]))
        self.sigs, self.percent = [sigs[i] for i in order], percent
        sets = [sets[i] for i in order]
        self.n = np.array([len(s) for s in sets], np.int64)
        tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(sets)), self.n)
        scrambled = (tokens.view(np.uint64) * _MIX[1]) ^ ((tokens.view(np.uint64) * _MIX[1]) >> np.uint64(31))
        ranks = [np.argsort(np.lexsort((tokens, df))), np.arange(len(tokens)), np.argsort(np.argsort(scrambled))]
        starts = np.concatenate(([0], np.cumsum(self.n)))
        prefix = self.n - least_overlap(self.n, percent) + 1
        self.prefixes, self.postings = [], []
        for rank in ranks:
            by = np.lexsort((rank[inverse], doc))
            near = np.arange(len(doc)) - starts[doc] < prefix[doc]
            shared = df[inverse[by]] > 1
            self._index(inverse[by][near & shared], doc[near & shared], len(tokens))
        keep = df[inverse] > 1
        self._index(inverse[keep], doc[keep], len(tokens))

    def _index(self, token: np.ndarray, doc: np.ndarray, n_tokens: int) -> None:
        """Tokens of each document, and documents of each token in ascending order."""
        at = np.searchsorted(doc, np.arange(len(self.n) + 1))
        self.prefixes.append((token, at))
        by = np.argsort(token, kind="stable")
        self.postings.append((doc[by], np.searchsorted(token[by], np.arange(n_tokens + 1))))

    def _with(self, order: int, i: int) -> np.ndarray:
        """Every document before ``i``, once for each token that it shares with ``i``."""
        (token, at), (docs, starts) = self.prefixes[order], self.postings[order]
        found = [docs[starts[t] : starts[t + 1]] for t in token[at[i] : at[i + 1]].tolist()]
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return found[found < i]

    def links(self) -> list[tuple[int, int]]:
        label = np.arange(len(self.n))
        members = {i: [i] for i in range(len(self.n))}
        for i in range(1, len(self.n)):
            low = np.searchsorted(self.n, least_overlap(int(self.n[i]), self.percent))
            found = None
            for order in range(3):  # the filters of the three orders are intersected
                c = np.unique(self._with(order, i))
                c = c[c >= low]
                found = c if found is None else np.intersect1d(found, c, assume_unique=True)
                if not len(found):
                    break
            if not len(found):
                continue
            common = np.bincount(self._with(3, i), minlength=i)[found]
            linked = found[100 * common >= self.percent * (self.n[i] + self.n[found] - common)]
            for root in np.unique(label[linked]).tolist():
                mine = int(label[i])
                if root != mine:
                    small, large = sorted((root, mine), key=lambda r: len(members[r]))
                    label[members[small]] = large
                    members[large] += members.pop(small)
        return [(self.sigs[i], self.sigs[r]) for i, r in enumerate(label.tolist()) if i != r]


def _verify(percent: int):
    """Rows sorted by (family, a, b): a group of rows is a block pair of one family."""

    def run(batches):
        key, sigs, sets = None, [], []

        def finish():
            out = _Group(sigs, sets, percent).links() if len(sigs) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(4)))
            column = batch.column(4)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            for r, (*k, sig) in enumerate(heads):
                if k != key:
                    if sigs:
                        yield finish()
                    key, sigs, sets = k, [], []
                sigs.append(sig)
                sets.append(values[offsets[r] : offsets[r + 1]].copy())
        if sigs:
            yield finish()

    return run


def _families(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """family and sig of the sets that may have a partner: one group under the order by frequency, and by hash.

    ``node`` is a signature whose lowest bit is the order, so that one pass over the postings serves both orders.
    """
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # order by hash: the tokens are hashes, and stand in their order
    token = sets.select("sig", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token")).select("sig", "token", (F.col("place") < need).alias("early"))
    # tokens of one document alone need no posting; under the order by frequency they come first
    df = token.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = token.join(df, "token").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "token", "early"))).alias("shared"))
    sized = shared.join(classes, "sig").withColumn("left", F.greatest(need - (F.col("n") - F.size("shared")), F.lit(0)).cast("int"))
    of = lambda tokens, order: F.transform(tokens, lambda t: F.struct(t["token"].bitwiseAND(~1).bitwiseOR(order).alias("token"), F.lit(order).alias("order")))
    both = F.concat(of(F.slice("shared", F.lit(1), F.col("left")), 0), of(F.filter("shared", lambda t: t["early"]), 1))
    postings = sized.select("sig", "n", F.explode(both).alias("t")).select("t.token", "n", F.col("sig").bitwiseAND(~1).bitwiseOR(F.col("t.order")).alias("node"))
    order = ("token", "n", "node")
    postings = staged(postings, "postings")
    chained = staged(postings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chain(percent), "u long, v long, token long, n long, node long, place long"), "chained")
    discard(postings)
    ends = chained.where("place is not null")
    # two rows for each partition
    lag = lambda c: F.lag(c).over(W.orderBy("place"))
    across = ends.select("token", "n", F.col("node").alias("v"), lag("token").alias("t"), lag("n").alias("m"), lag("node").alias("u")).where(f"t = token and n * {percent} <= m * 100").select("u", "v")
    groups = components(chained.where("place is null").select("u", "v").union(across))
    root = lambda order: F.max(F.when(F.col("node").bitwiseAND(1) == order, F.col("root")))
    of_both = groups.groupBy(F.col("node").bitwiseAND(~1).alias("half")).agg(root(0).alias("r0"), root(1).alias("r1")).where("r0 is not null and r1 is not null")
    named = sets.select("sig", F.col("sig").bitwiseAND(~1).alias("half")).join(of_both, "half")
    families = staged(named.select(F.xxhash64("r0", "r1").alias("family"), "sig"), "families")
    discard(chained)
    return families


def _links(sets: DataFrame, families: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """(u, v): links that join all sets of a component, verified inside families."""
    members = families.join(sets, "sig").select("family", "sig", "tokens")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum(F.size("tokens")) / block_tokens).cast("int").alias("blocks")).where("members > 1")
    sizes = staged(sizes.select("family", "blocks"), "blocks")
    placed = staged(members.join(sizes, "family").withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")), "members")

    def verified(rows: DataFrame, others) -> DataFrame:
        """``others``: the blocks that a row's own block meets; both blocks of a pair meet as (a, b), a <= b."""
        paired = rows.withColumn("other", F.explode(others)).select("family", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "sig", "tokens")
        groups = ("family", "a", "b")
        return staged(paired.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_verify(percent), "u long, v long"), "links")

    last = F.col("blocks") - 1
    beside = F.array_distinct(F.array(F.pmod(F.col("mine") + 1, "blocks"), F.pmod(F.col("mine") + last, "blocks")))
    links = verified(placed, beside)
    if (sizes.agg(F.max("blocks").alias("b")).first()["b"] or 1) > 3:  # else each block has met every other
        joined = components(links)
        large = placed.where("blocks > 3").join(joined, F.col("sig") == F.col("node"), "left")
        parts = large.groupBy("family").agg(F.count_distinct(F.coalesce("root", "sig")).alias("parts")).where("parts > 1").select("family")
        rest = F.filter(F.sequence(F.lit(0), last), lambda k: (k != F.col("mine")) & ~F.array_contains(beside, k))
        links = links.union(verified(placed.where("blocks > 3").join(parts, "family", "left_semi"), rest))
    return links


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), text_hash and root of every document.

    ``root`` is one value for each component (of documents with words), whatever the ids; ``text_hash`` is xxhash64.

    Two documents link if ``100 |A and B| >= percent |A or B|``. A document without words (or without text) links with
    nothing. Rows with null ids take part; a component of null ids alone has a null component_id. Repeated rows stay.
    An empty table gives an empty result; other columns, whatever their names, are ignored. Texts of any length count
    whole. Families of more than ``block_tokens`` tokens are verified in pairs of blocks. Should two different sets have
    one signature (64 bits), a check of other 64 bits fails the query rather than join them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    sketch = staged(hashed.mapInArrow(_sketch(size), "doc_id long, n long, sig long, check long, some array<long>, text_hash long"), "sketch")
    alike = F.when(F.min("check") == F.max("check"), F.first("n")).otherwise(F.raise_error(F.lit("two different sets have one signature")).cast("long"))
    classes = staged(sketch.groupBy("sig").agg(F.min("doc_id").alias("rep"), alike.alias("n")), "classes")
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1

    # order one: sampled tokens of one document alone come first. min = max: no other signature has the token
    alone = sketch.select("sig", F.explode("some").alias("token")).groupBy("token").agg(F.min("sig").alias("sig"), F.max("sig").alias("other")).where("sig = other")
    alone = alone.groupBy("sig").agg(F.count(F.lit(1)).alias("alone"))
    # sets of up to ``few`` tokens can only link with equal sets: few / (few + 1) is below the threshold
    few = (percent - 1) // (100 - percent)
    rest = classes.where(F.col("n") > few).join(alone, "sig", "left").where(F.coalesce("alone", F.lit(0)) < need).select("sig", "rep")
    chosen = rows.join(rest, rows.doc_id.eqNullSafe(rest.rep)).select("sig", "text")
    sets = staged(chosen.mapInArrow(_sets(size), "sig long, tokens array<long>").dropDuplicates(["sig"]), "sets")

    linked = components(_links(sets, _families(sets, classes, percent), percent, block_tokens))
    roots = classes.join(linked, classes.sig == linked.node, "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(smallest, "root").select("sig", "root", "component_id")
    return sketch.select("doc_id", "n", "sig", "text_hash").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash", "root")


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one document (the smallest id) of each component.

    Documents without words stay. Rows that repeat an id and a text are one document. All columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    none = -(1 << 63)
    groups = jaccard_components(docs, size, percent)
    first = groups.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")).select("first.doc_id", "first.text_hash")
    chosen = first.union(groups.where("n_shingles = 0").select("doc_id", "text_hash").distinct())
    chosen = chosen.select(F.coalesce("doc_id", F.lit(none)).alias("k"), F.col("text_hash").alias("h"))
    keyed = packed(docs).withColumns({"k": F.coalesce("doc_id", F.lit(none)), "h": F.xxhash64("text")})
    return unpacked(keyed.join(chosen, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]), docs.columns)
