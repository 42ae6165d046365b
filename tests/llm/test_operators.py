"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plain import plain_components, plain_hits

from graphloom.llm import bpe, common, components, decontaminate, fuzzy_hash, ngram_join, repeats, token_files, toxicity

SCHEMA = "doc_id long, text string, n long, sig long, key long, score double, others string, h1 long, `_` int, c0 int, `a.b` string, root long, text_hash long"


def docs(spark, rows, parts=3):
    """Extra columns have names that the operators use inside, or that are hard to name."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 0.5, "o", None, 4, 5, "d", 6, 7) for i, t in rows], SCHEMA).repartition(parts)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8))) for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n // 2)]
    out = []
    for _ in range(n):
        t = rng.choice(base)
        kind = rng.randrange(4)
        if kind == 1:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = t[: rng.randrange(len(t) + 1)] + rng.choice(base)
        elif kind == 3:
            t = t.upper()
        out.append(t)
    return list(enumerate(out)) + [(None, "null id"), (None, None), (1000, None), (1001, ""), (1002, ""), (5, "ab ab " * 3000), (5, "ab ab " * 3000)]


def covered(n, size, hits):
    gone = np.zeros(n + 1, bool)
    for k in hits:
        gone[k : k + size] = True
    return gone


@pytest.mark.parametrize("seed,most", [(1, 1 << 20), (2, 100)])
def test_repeats(spark, seed, most):
    """``most`` = 100 sends every shared minimizer through the counting of windows."""
    rows, length, passage = some_texts(seed), 40, 7
    rng = random.Random(seed)
    shared = " ".join(rng.choice(["ab", "c", "déf", "gh"]) for _ in range(passage))
    rows += [(3000 + k, f"own{k} {shared} tail{k % 3} " + "x " * k) for k in range(40)]  # one minimizer in many contexts
    rows += [(4000, " ".join(f"{k}a {' '.join(str(j) for j in range(90, 99))}" for k in range(5)))]  # repeats in itself alone
    counts, holders = {}, {}
    for d, (_, t) in enumerate(rows):
        b = (t or "").encode()
        w = b.split()
        for k in range(len(b) - length + 1):
            counts[b[k : k + length]] = counts.get(b[k : k + length], 0) + 1
        for k in range(len(w) - passage + 1):
            holders.setdefault(tuple(w[k : k + passage]), set()).add(d)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        w = b.split()
        gone = covered(len(b), length, [k for k in range(len(b) - length + 1) if counts[b[k : k + length]] > 1])
        passages = covered(len(w), passage, [k for k in range(len(w) - passage + 1) if len(holders[tuple(w[k : k + passage])]) > 1])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone[: len(b)].view(np.int8)))) == 1).sum())
        want.append((i, len(b), int(gone[: len(b)].sum()), spans, hashlib.sha256(kept).hexdigest(), int(passages[: len(w)].sum())))
    assert 0 < next(x for x in want if x[0] == 3001)[5] and next(x for x in want if x[0] == 4000)[5] == 0
    out = repeats.remove_repeats(docs(spark, rows), length=length, passage=passage, most=most, with_kept=True)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words") == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in out.collect())


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(9)
    long = bytes(rng.choice(b"abcdefgh ") for _ in range(1_500_000)).decode()
    rows = [(1, long), (2, "x" + long[500_000:500_399]), (3, "y" + long[700_000:700_400] + "z"), (4, "a" * 300_000)]
    got = rows_of(repeats.remove_repeats(docs(spark, rows)), "doc_id", "n_removed", "n_spans")
    assert got == [(1, 400, 1), (2, 0, 0), (3, 400, 1), (4, 300_000, 1)]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    assert rows_of(repeats.remove_repeats(docs(spark, [(1, None)])), "n_bytes", "n_removed", "n_spans") == [(0, 0, 0)]


def test_run_index():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    strings = [base, base[:150] + b"X" + base[150:], base[20:], b"q"]
    index = repeats.RunIndex([np.frombuffer(x, np.uint8) for x in strings])
    text = b"".join(s + bytes([1 + k]) for k, s in enumerate(strings))  # end marks of their own
    assert index.runs < index.n
    match, other = index.matching_statistics()
    for i in range(0, len(text), 7):
        common = lambda j: next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0)  # noqa: E731, B023
        if other[i] >= 0:
            assert match[i] == common(int(other[i]))
    marked = {(s, k) for s, a, b in index.long_matches(60) for k in range(a, b)}
    windows = [(s, k, x[k : k + 60]) for s, x in enumerate(strings) for k in range(len(x) - 59)]
    assert marked == {(s, k) for s, k, w in windows if sum(w == v for _, _, v in windows) > 1}


def test_fingerprints(spark):
    rows = [(i, t) for i, t in some_texts(4) if i != 5] + [(5, "ab ab " * 3000)] * 2
    out = fuzzy_hash.fingerprint_report(docs(spark, rows)).collect()
    # ids are unique but for None and 5, whose order is fixed by the hashes of their texts
    order = sorted({i for i, _ in rows if i is not None}, reverse=True)
    text = {i: t or "" for i, t in rows if i is not None}
    print_of = {}
    for r in out:
        t = text.get(r["doc_id"])
        if t is None:
            continue
        assert r["n_chars"] == len(t) and r["fingerprint"] == fuzzy_hash.fingerprint(t.encode())
        print_of.setdefault(t, r["fingerprint"])
        assert print_of[t] == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    got = {r["doc_id"]: r for r in out}
    for a, b in zip(order, order[1:]):
        if a != 5:
            half = len(text[a]) // 2
            e = (text[a][: len(text[a]) - half] + text[b][:half]).encode()
            assert got[a]["edited_sha256"] == hashlib.sha256(e).hexdigest() and got[a]["edited_fingerprint"] == fuzzy_hash.fingerprint(e)
            assert got[a]["near_next"] == fuzzy_hash.likeness([got[a]["fingerprint"]], [fuzzy_hash.fingerprint(text[b].encode())])[0]
    assert len(out) == len(rows)
    only = fuzzy_hash.fingerprint_report(docs(spark, [(1, "abcdé")])).first()
    assert only["edited_sha256"] == hashlib.sha256("abcab".encode()).hexdigest()
    assert fuzzy_hash.fingerprint_report(docs(spark, [])).count() == 0
    pair = {r["doc_id"]: r for r in fuzzy_hash.fingerprint_report(docs(spark, [(1, "abcd"), (2, "wxyz")])).collect()}
    assert pair[1]["edited_sha256"] == hashlib.sha256(b"abwx").hexdigest() and pair[2]["edited_sha256"] == hashlib.sha256(b"wxab").hexdigest()
    assert fuzzy_hash.fingerprints(docs(spark, [(1, None)])).first()["fingerprint"] == "0::"


def test_likeness():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    b = a[:2000] + "inserted" + a[2000:]
    c = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    f = [fuzzy_hash.fingerprint(x.encode()) for x in (a, b, c)]
    near = fuzzy_hash.likeness([f[0], f[0], f[0], "9:AAAA:BB"], [f[0], f[1], f[2], "3:AAAA:BB"])
    assert near[0] == 1 and 0.8 < near[1] < 1 and near[2] < 0.2 and near[3] == 0
    assert max(len(p) for p in f[0].split(":")) <= 64

    def lcs(x, y):
        d = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y):
                last, d[j + 1] = d[j + 1], last + 1 if p == q else max(d[j], d[j + 1])
        return d[-1]

    x, y = f[0].split(":")[1].encode(), f[1].split(":")[1].encode()
    assert fuzzy_hash._common([x, y], [y, x]).tolist() == [lcs(x, y)] * 2


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "dumbcluck"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled()
    d = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "n i t w i t here"), (9001, None), (9002, ""), (9003, "x" * 300_000), (9004, "such a n.i.t.w.i.t and a block-head, du*mbcluck"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (5, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(d, labels)
    out = {r["doc_id"]: r for r in toxicity.score(d, machine).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in set(held)) for i, _, _ in rows)
    right = sum(out[i]["predicted"] == rows[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert out[9004]["score"] > 0.5 > out[9001]["score"] == out[9002]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values()) and out[None]["held_out"] is False
    kept = toxicity.score(d, machine, keep=True)
    assert kept.columns[-2:] == ["text", "others"] and kept.count() == d.count()
    assert toxicity.score(docs(spark, []), machine).count() == 0
    nothing = toxicity.train(d, labels.where("false"))
    assert toxicity.score(d, nothing).count() == d.count()


def test_toxicity_keeps_every_weight():
    rng = random.Random(4)
    words = ["\x00\x00\x00", *["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(100)) for _ in range(30)]]
    _, keys, _ = toxicity._features(words)
    keys = np.unique(keys)
    weights = np.random.default_rng(5).normal(size=len(keys)).astype(np.float32)
    machine = toxicity.Machine.fold(keys, weights, 0.25)
    assert len(keys) > 25_000 and np.count_nonzero(machine.weights) == np.count_nonzero(weights)
    w, key, value = toxicity._features([*words, "unknown ünknown"])
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    want = 0.25 + np.bincount(w, np.where(keys[at] == key, weights[at], 0) * value, len(words) + 1)
    assert np.allclose(machine._values([*words, "unknown ünknown"]), want, atol=1e-6)


def test_toxicity_of_endless_words(spark):
    """One word of 1.5 million characters in a training text, and in a text to score."""
    endless = "".join(chr(0x4E00 + k * k % 5000) for k in range(1_500_000))
    rows = labelled(120)
    fitted = toxicity.fit([t for _, t, _ in rows] + [endless], [y for _, _, y in rows] + [0])
    values = fitted.words(["blockhead", endless, "aeiou"])
    assert values[0] > max(values[1:])
    d = docs(spark, [(i, t) for i, t, _ in rows] + [(1, endless)])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.train(d, labels)).count() == 121


def tokenizer_path(name):
    return pytest.importorskip("public_tokenizers").path(name)


ODD = [(1, "Hello  world's\n\n x <|endoftext|>é́ 😀"), (2, None), (3, ""), (None, "   "), (4, "a" * 3000), (4, "a" * 3000), (5, "ΑΣ İ \x1c\x85 12 3!!"), (6, "the of and " * 20_000)]


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = ODD + some_texts(6)
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    d = docs(spark, rows)
    for size in (1 << 16, 3):
        assert rows_of(bpe.encode_documents(d, path, size), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    full = {r["doc_id"]: r for r in bpe.encode_documents(d, path, with_ids=True).collect()}
    assert full[1]["decoded"] == ODD[0][1] and full[1]["ids"] == t.encode(ODD[0][1], add_special_tokens=False).ids
    assert bpe.encode_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("rows", [[(1, "hello world again")], [(1, "")], [(1, "a a b b c c"), (2, "a b c")]])
def test_bpe_with_an_empty_or_cut_lexicon(spark, rows):
    """No word occurs twice, or more words than there is room for occur equally often."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for size in (0, 1, 1 << 16):
        out = bpe.encode_documents(docs(spark, rows), path, size, with_ids=True)
        assert {r["doc_id"]: r["ids"] for r in out.collect()} == {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}


def test_bpe_knows_the_same_letters():
    """Every code point before and after a letter, a digit and a suffix is split as the library splits it."""
    from tokenizers import pre_tokenizers

    plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    at = 0
    for start in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(start, min(start + 4096, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}'s!{c}" for c in chars)
        want = [text[a:b] for _, (a, b) in plain.pre_tokenize_str(text)]
        assert bpe._WORDS.findall(text) == want
        at += len(want)
    assert at > 2_000_000


def test_lexicon():
    words = sorted({b"ab", b"abc", b"b", b"bc", b"xbc", "é".encode(), b"a"})
    lexicon = bpe.Lexicon.compile(words, [np.array([k, k + 1]) for k in range(len(words))])
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"abcd", b"c", b"x", b"xb"]).tolist() == [-1] * 5
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    assert bpe.Lexicon.compile([], []).find([b"a", b""]).tolist() == [-1, -1]


def test_lexicon_file(tmp_path):
    words = sorted({str(k).encode() for k in range(500)})
    made = bpe.Lexicon.compile(words, [np.array([k]) for k in range(500)])
    (tmp_path / "lexicon").write_bytes(made.to_bytes())
    assert bpe.Lexicon.mapped(str(tmp_path / "lexicon")).find(words).tolist() == list(range(500))


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = ODD + some_texts(7)
    manifest = token_files.write_token_files(docs(spark, rows), path, frame_bytes=2000)
    out = token_files.read_token_files(manifest)
    encoded = lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    want = [(i, len(encoded(x)), zlib.crc32(encoded(x).tobytes())) for i, x in rows]
    assert rows_of(out, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    by_start = out.orderBy("start").collect()
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in by_start]
    assert ids == sorted(ids)
    # one document alone, from its own frame, and a damaged frame
    import pyarrow as pa

    for r in manifest.collect():
        data = bytearray(open(r["path"].removeprefix("file:"), "rb").read())
        reader = token_files.TokenReader(pa.BufferReader(bytes(data)))
        if 6 in reader.ids:
            assert reader.document(6).tolist() == encoded(ODD[7][1]).tolist() and len(reader.seek) > 1
            data[reader.at[0] + reader.seek[0][0] - 3] ^= 255
            with pytest.raises(Exception):  # noqa: B017
                token_files.TokenReader(pa.BufferReader(bytes(data))).frame(0)
    empty = token_files.write_token_files(docs(spark, []), path)
    assert token_files.read_token_files(empty).count() == 0


def test_word_encoder():
    """Blocks, forgetting and rare white space change no ids, and stretches cost no calls of their own."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(17)
    signs = [*map(chr, range(0x180)), *"'sStTrRvV  \n\x1c\x1f\u0301\u03a3\u0130", "'Ll", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(2000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for block, most in [(1, 200), (3000, 50), (1 << 23, 600_000)]:
        got = token_files.WordEncoder(path, most).encode(pa.array(texts), block)
        assert [x.tolist() for x in got] == want
    assert [len(x) for x in token_files.WordEncoder(path).encode(pa.array([None, "", " a\tb "]))] == [0, 0, 2]
    assert list(token_files.WordEncoder(path).encode(pa.array([], pa.string()))) == []
    # 10,000 different stretches of 200 words
    encoder, calls = token_files.WordEncoder(path), []
    many = pa.array([" ".join(f"w{chr(97 + a)}q.{chr(97 + b)}w!{'?' * c}" for b in range(20) for c in range(25)) for a in range(20)])
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        n = sum(map(len, encoder.encode(many)))
    finally:
        sys.setprofile(None)
    assert n == sum(len(e.ids) for e in t.encode_batch(many.to_pylist(), add_special_tokens=False))
    assert sum(c in ("call", "c_call") for c in calls) < 5000
    # a tokenizer that cuts otherwise is refused
    other = Tokenizer.from_file(path)
    other.normalizer = None
    with pytest.raises(ValueError):
        token_files.WordEncoder(other.to_str())


@pytest.mark.parametrize("seed,size,percent,block", [(8, 4, 85, 1 << 21), (9, 2, 60, 300), (10, 1, 50, 100)])
def test_ngram_join(spark, seed, size, percent, block):
    rows = some_texts(seed, 90)
    rng = random.Random(seed)
    long = [f"w{rng.randrange(400)}" for _ in range(200)]
    for k in range(40):  # a group of near copies, not all of them linked with each other
        w = list(long)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((2000 + k, " ".join(w)))
    out = ngram_join.jaccard_components(docs(spark, rows), size, percent, block)
    key = lambda r: [(x is not None, x) for x in r]
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(plain_components(rows, size, percent), key=key)


@pytest.mark.parametrize("size", [5, 6, 9])
def test_ngram_join_tells_exchanged_words_apart(spark, size):
    rows = []
    for k in range(20):
        words = [f"x{k}y{i}" for i in range(size)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([words[-1], *words[1:-1], words[0]]))]
    out = ngram_join.jaccard_components(docs(spark, rows), size, 80)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == [(i, 1, i) for i in range(40)] == sorted(plain_components(rows, size, 80))
    assert ngram_join.keep_one_each(docs(spark, rows), size, 80).count() == 40


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    assert rows_of(ngram_join.jaccard_components(docs(spark, [(1, None), (2, "")])), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]


def test_keep_one_each(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text), (3, text), (2, text + " more"), (2, "another text"), (None, text), (None, "alone"), (4, None), (5, None), (6, "")]
    d = docs(spark, rows)
    out = ngram_join.keep_one_each(d)
    assert out.columns == d.columns
    assert rows_of(out, "doc_id", "text") == [(None, "alone"), (2, "another text"), (2, text + " more"), (4, None), (5, None), (6, "")] or rows_of(out, "doc_id", "text") == sorted([(None, "alone"), (2, "another text"), (2, text + " more"), (4, None), (5, None), (6, "")], key=lambda r: [(x is not None, x) for x in r])


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (200, 500), (500, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_decontaminate(spark):
    items = [(1, "One two THREE four five, six"), (2, "été 42"), (3, None), (4, ""), (None, "zero zero"), (10, "two three four five"), (10, "two three four five"), (11, "?!")]
    rows = [(1, "so one two-three four FIVE six"), (2, "one two three x four five six; ÉTÉ été 42!"), (3, None), (4, ""), (None, "zero zero zero"), (5, "été 421 one"), (5, "été 421 one"), (6, "two three four five " * 20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, rows), bench, size=4)
    want = [(i, *plain_hits(t[:200] if i == 6 else t, items, 4)) for i, t in rows]
    want[-1] = (6, 80_000, 80_000, *want[-1][3:])
    key = lambda r: [(x is not None, x) for x in r]
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=key)
    span = next(r for r in out.collect() if r["doc_id"] == 2)["spans"]
    assert [rows[1][1][s["start"] : s["end"]] for s in span] == ["été 42"]
    many = "one two three FOUR é, " * 60_000  # as many spans as passages
    out = decontaminate.decontaminate(docs(spark, [(1, many)]), spark.createDataFrame([(1, "two three")], bench.schema)).first()
    assert len(out["spans"]) == 60_000 and {many[s["start"] : s["end"]] for s in out["spans"]} == {"two three"}
    with pytest.raises(ValueError, match="states"):
        decontaminate.decontaminate(docs(spark, rows), bench, max_states=3)
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs(spark, rows), bench.where("false")).collect())
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs(spark, rows), bench, max_benchmark_bytes=3)


def _peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_toxicity_memory():
    """The fit holds the table of first guesses and no copies of it; words are scored in small blocks; rows in blocks."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(40_000)]
    clean = [" ".join(words[i : i + 100]) for i in range(0, 4000, 100)]
    machine, mb = _peak_mb(lambda: toxicity.fit([c + " awful insult" for c in clean[:20]] + clean, [1] * 20 + [0] * 40, rounds=1))
    assert mb < 110
    got, mb = _peak_mb(lambda: machine.words(words))
    assert mb < 15 and np.array_equal(got, np.concatenate([machine.words(words[i : i + 999]) for i in range(0, len(words), 999)]))
    x, y = rng.standard_normal((20_000, 100)).astype(np.float32), np.where(rng.random(20_000) < 0.3, 1.0, -1.0)
    cost = rng.random(20_000)
    (w, bias), mb = _peak_mb(lambda: toxicity._fit_svm(x, y, cost))
    assert mb < 10
    z = np.concatenate((x, np.ones((len(x), 1))), 1)
    v = np.append(w, bias)
    near = y * (z @ v) < 1
    slope = np.append(np.ones(100), 1e-6) * v - ((cost * (y - z @ v))[:, None] * z)[near].sum(0)
    assert np.abs(slope).max() < 1e-6 * near.sum()


def test_workers_hold_one_operator():
    """The pipeline's stages share their workers: what one keeps for its next task is gone when another begins."""
    made = decontaminate._automaton("key", ["ab"])
    assert decontaminate._automaton("key", ["ab"]) is made
    before = sys.getrefcount(made)
    assert list(ngram_join._sketch(4)(iter([]))) == []
    assert sys.getrefcount(made) == before - 1


def test_each():
    column = pa.array(["a", None, "", "b"] * 200).slice(1, 700)
    assert list(common.each(column)) == list(common.each(column, 1)) == column.to_pylist() and list(common.each(column.slice(0, 0))) == []
