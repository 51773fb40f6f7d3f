"""Encoding, language, toxicity, fingerprints, media: against libraries, brute force and held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import bpe, langid, queries, simhash, toxicity, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, score double, fingerprint string, n string, _toxicity int, component_id string, shard string, weight string"


def docs(spark, texts, schema=DOCS):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1.0, "x", "n", 1, "c", "h", "w") for i, t in enumerate(texts)], CLASH)


ODD = [None, "", " ", "\n\t ", "a", "🙂", "x" * 5000, "two  spaces", "same", "same", "�", "<|endoftext|>", "a <|endoftext|> b"]


# --- BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary(queries.BPE_VOCABULARY)


def test_bpe_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    mine, theirs = bpe.ByteBPE(vocabulary, cache_words=50), Tokenizer.from_file(vocabulary)
    rnd = random.Random(5)
    pool = [*"ab c'sdlt1 \n\t\x1c\x1d\x85\xa0 　é!?_<|>", "<|endoftext|>", "'ll", " 's", "  ", "​", "́", "漢", "😀", "²", "١", "the", " and"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 25)))
        want = theirs.encode(text, add_special_tokens=False).ids
        got = mine.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_long_pretoken_takes_the_leftmost_lowest_rank(vocabulary):
    from tokenizers import Tokenizer

    word = "".join(random.Random(2).choice("abcdeth") for _ in range(20_000))
    assert np.frombuffer(bpe.ByteBPE(vocabulary).encode(word), "<u4").tolist() == Tokenizer.from_file(vocabulary).encode(word, add_special_tokens=False).ids


def test_bpe_broken_bytes_decode_as_the_library_does(vocabulary):
    from tokenizers import Tokenizer

    mine, theirs = bpe.ByteBPE(vocabulary), Tokenizer.from_file(vocabulary)
    ids = np.frombuffer(mine.encode("漢字é"), "<u4")[::-1].copy()
    assert mine.decode(ids.astype("<u4").tobytes()) == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_rows(spark, vocabulary):
    from tokenizers import Tokenizer

    out = bpe.tokenize(clashing(spark, ODD), vocabulary, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    library = Tokenizer.from_file(vocabulary)
    assert len(out) == len(ODD)
    for r in out:
        text = ODD[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded) == (len(ids), library.decode(ids, skip_special_tokens=False))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.tokenize(docs(spark, []), vocabulary).collect() == []


# --- language -------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    path = queries.vocabulary(queries.PIECE_VOCABULARY)
    index = langid.pieces(path)
    rng = np.random.default_rng(1)
    table = rng.random((len(index) + 1, 2)) * 1e-3
    model = langid.Model(path, ["a", "b"], table)

    def brute(text):
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for j in range(1, len(text) + 1):
            k = index.get(text[:j])
            if k is not None:
                total += table[k] * brute(text[j:])
            elif j == 1:
                total += table[-1] * brute(text[1:])
        return total

    words = ["the", "and", "ü", "thing", "漢字", "ation"]
    for w, got in zip(words, model.words(words)):
        assert got == pytest.approx(np.log(brute(langid._START + w)))
    long = "ab" * 60
    assert np.isfinite(model.words([long, "a"])).all()


def test_language_held_out(spark):
    vocab = {"en": "the house is small and the dog was running over green fields".split(), "de": "das haus ist klein und der hund lief über grüne felder".split(), "fr": "la maison est petite et le chien courait dans les champs verts".split()}
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        lang = rnd.choice(list(vocab))
        rows.append((i, " ".join(rnd.choice(vocab[lang]) for _ in range(12)), lang, "s", None))
    rows += [(1000, None, "en", "s", None), (1001, "", None, "s", None), (1002, "123 !!", "de", "s", None), (1003, "x" * 3000, None, "s", None)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df, queries.vocabulary(queries.PIECE_VOCABULARY), sample_rows=40)
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 1000]
    assert held and sum(out[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(out[i].lang_pred == "und" and out[i].lang_score == 0 for i in (1000, 1001, 1002)) and out[1003].lang_pred in vocab
    assert all(0 <= r.lang_score <= 1 for r in out.values())


def test_language_without_labels(spark):
    df = docs(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(df, queries.vocabulary(queries.PIECE_VOCABULARY))
    assert {r.lang_pred for r in langid.identify(df, model).collect()} == {"und"}


# --- toxicity -------------------------------------------------------------------


def toxic_rows(n, seed=0):
    rnd = random.Random(seed)
    plain = "the quick brown fox jumps over many lazy dogs near old quiet rivers today".split()
    rows, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.3
        words = [rnd.choice(plain) for _ in range(20)] + ([rnd.choice(["idiotic", "vermin"])] if bad else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(600)
    df = spark.createDataFrame(rows, DOCS)
    machine = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r.toxicity for r in toxicity.score(df, machine).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((out[i] >= toxicity.THRESHOLD) == bool(t) for i, t in held)
    odd = {r.doc_id: r.toxicity for r in toxicity.score(clashing(spark, ODD), machine).collect()}
    assert len(odd) == len(ODD) and odd[0] == odd[1] < toxicity.THRESHOLD and odd[8] == odd[9]


def test_toxicity_learns_pairs():
    """Each of two terms is in half of both classes; only both together mean label 1."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(1200):
        a, b = k % 2, (k // 2) % 2
        noise = rng.integers(100, 120, 3)
        texts.append(np.array([*([1] * a), *([2] * b), *noise.tolist()]))
        labels.append(a & b)
    machine = toxicity.fit(texts, np.array(labels))
    score = lambda *t: machine.score([machine.index[x] for x in t if x in machine.index])
    assert score(1, 2) > 0.8 and max(score(1), score(2), score()) < 0.5
    additive = machine.w0 + machine.w[machine.index[1]] + machine.w[machine.index[2]]
    assert np.log(score(1, 2) / (1 - score(1, 2))) > additive + 0.1


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs(spark, ["a"]), empty)
    assert toxicity.score(docs(spark, ["a", None]), machine).agg(F.max("toxicity")).head()[0] < 1e-6
    assert toxicity.score(docs(spark, []), machine).collect() == []


def test_score_is_the_sum_over_terms_and_pairs():
    rng = np.random.default_rng(9)
    machine = toxicity.Machine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    for at in ([], [3], [0, 5, 7], list(range(12))):
        z = machine.w0 + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for i in at for j in at if i < j)
        assert machine.score(at) == pytest.approx(1 / (1 + math.exp(-z)))


def test_fit_follows_the_gradient():
    """The fit lowers the weighted log-loss, computed by explicit sums, below that of weights alone at the start."""
    rng = np.random.default_rng(2)
    # Label 1 where both of two terms are there, which no sum of weights can tell.
    rows = [set(rng.choice(8, size=4, replace=False).tolist()) for _ in range(600)]
    labels = np.array([int(len({0, 1} & r) != 1) for r in rows])
    texts = [np.array(sorted(r), np.int64) for r in rows]
    chosen = toxicity.fit([np.append(t, 100 + k % 2 * y) for k, (t, y) in enumerate(zip(texts, labels))], labels)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    loss = 0.0
    for t, y, w, k in zip(texts, labels, weight, range(600)):
        at = [chosen.index[x] for x in [*t.tolist(), 100 + k % 2 * int(y)] if x in chosen.index]
        z = chosen.w0 + sum(chosen.w[i] for i in at) + sum(float(chosen.v[i] @ chosen.v[j]) for i in at for j in at if i < j)
        loss += w * math.log1p(math.exp(-z if y else z))
    assert loss < 0.9 * math.log(2)


def test_expectation_maximisation_against_all_segmentations(monkeypatch):
    index = {x: k for k, x in enumerate(["a", "ab", "b", "ba", "▁", "▁a"])}
    monkeypatch.setattr(langid, "pieces", lambda path: index)
    counts = {"x": Counter({"ab": 3, "aba": 1, "b": 2})}

    def segmentations(text):
        if not text:
            return [[]]
        return [[text[:j], *rest] for j in range(1, len(text) + 1) if text[:j] in index for rest in segmentations(text[j:])]

    start = {x: 1e-3 for x in index}
    for word, n in counts["x"].items():
        text = "▁" + word
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in index:
                    start[text[i:j]] += n
    p = {x: v / sum(start.values()) for x, v in start.items()}
    for _ in range(2):
        expected = dict.fromkeys(index, 0.0)
        for word, n in counts["x"].items():
            ways = [(s, math.prod(p[x] for x in s)) for s in segmentations("▁" + word)]
            for s, w in ways:
                for x in s:
                    expected[x] += n * w / sum(w for _, w in ways)
        p = {x: (v + 1e-12) / (sum(expected.values()) + 1e-12 * len(index)) for x, v in expected.items()}
    got = langid.fit("none", counts, rounds=2).table[:-1, 0]
    want = np.array([p[x] for x in index]) + 1e-8
    assert got == pytest.approx(want / want.sum(), rel=1e-9)


# --- SimHash ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [*ODD, "One TWO three É four five", "a\x1cb c\x0bd", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 91}" for i in range(400))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 17)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text)


def brute_components(prints, ids, tau):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= tau:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("m", "tau", "block"), [(3, 2, 2048), (2, 2, 7), (3, 2, 5), (4, 3, 16), (1, 1, 64)])
def test_links_against_brute_force(spark, m, tau, block):
    from folioscope.llm.common import Scratch, components

    rnd = random.Random(m * 10 + tau)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(140):  # chains and clusters of near ones
        x = rnd.choice(prints)
        for _ in range(rnd.randrange(1, tau + 2)):
            x ^= 1 << rnd.randrange(64)
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    ids = rnd.sample(range(10_000), len(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i, 1) for p, i in zip(prints, ids)], "fingerprint long, rep long, n long")
    scratch = Scratch(spark, "test")
    found = components(scratch, simhash.linked(scratch, df, tau, m, block))
    got = {i: i for i in ids} | {r.node: r.root for r in found.collect()}
    assert got == brute_components(prints, ids, tau)


def test_allocation():
    assert simhash.allocate([[0, 5, 50, 500]] * 3, 2) == [0, 0, 0] or sum(simhash.allocate([[0, 5, 50, 500]] * 3, 2)) == 0
    # A part that is useless at 0 is left out for a second bit elsewhere.
    assert simhash.allocate([[0, 1e9, 1e9, 1e9], [0, 1, 2, 9], [0, 1, 2, 9]], 2)[0] == -1


def test_simhash_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [*ODD, base, base.replace("word150", "changed"), base.upper(), "unrelated text of other words entirely", base]
    out = simhash.near_duplicates(clashing(spark, texts)).collect()
    got = {r.doc_id: r.component_id for r in out}
    prints = [plain_fingerprint(t) for t in texts]
    assert got == brute_components(prints, list(range(len(texts))), 2)
    assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in out} == dict(enumerate(prints))
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_hot_copies_and_repeated_ids(spark):
    df = docs(spark, ["hot group of copies"] * 500 + ["other words here"]).unionByName(docs(spark, ["hot group of copies"]))
    out = simhash.near_duplicates(df).groupBy("component_id").count().collect()
    assert {r.component_id: r["count"] for r in out} == {0: 501, 500: 1}


# --- media --------------------------------------------------------------------------


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 200, 5000])
@pytest.mark.parametrize(("height", "width"), [(1, 1), (1, 9), (7, 1), (23, 37)])
def test_webp_round_trip(height, width, colours):
    rng = np.random.default_rng(colours * height + width)
    x = rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (height, width))]
    chains = [(), ("subtract_green",), ("cross_colour",), ("predictor",), ("predictor", "cross_colour", "subtract_green"), ("subtract_green", "predictor")]
    chains += [("palette",), ("palette", "predictor")] if colours <= 200 else []
    for transforms in chains:
        for cache_bits in (0, 1, 11):
            for mode in range(14) if "predictor" in transforms and cache_bits == 0 else (11,):
                assert (webp.decode(webp.encode(x, transforms, cache_bits, 3, mode)) == x).all()


def test_webp_reads_groups_and_references():
    """A picture written by hand: two groups of prefix codes by tile, and a reference to the row above."""
    w = webp.Writer()
    for value, n in ((0x2F, 8), (7, 14), (1, 14), (0, 1), (0, 3)):  # 8 by 2
        w.put(value, n)
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no cache
    w.put(1, 1)  # groups by tile
    w.put(0, 3)  # tiles of 4
    webp._put_image(w, np.array([0xFF000000, 0xFF000100], np.uint32), 2, False)
    lengths = np.zeros(280, np.int64)
    lengths[[10, 258]] = 1  # a literal, and a length of 3
    for group in range(2):
        webp._put_code(w, lengths if group == 0 else np.eye(1, 280, 77, dtype=np.int64)[0])
        for k in range(3):
            webp._put_code(w, np.eye(1, 256, (5, 6, 255)[k], dtype=np.int64)[0])
        webp._put_code(w, np.eye(1, 40, 0, dtype=np.int64)[0])  # distance code 1: the pixel above
    for bit in (0, 0, 0, 0):
        w.put(bit, 1)  # row 0: four literals of group 0; then four of group 1 without bits
    w.put(0, 1)  # row 1: a literal
    w.put(1, 1)  # then three from above
    body = w.bytes()
    stored = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    a, b = 0xFF050A06, 0xFF054D06
    assert webp.decode(stored).tolist() == [[a] * 4 + [b] * 4] * 2


def test_webp_reads_a_file_of_another_encoder():
    """A public one-pixel file that browsers are tested with."""
    import base64

    pixels = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert pixels.shape == (1, 1) and int(pixels[0, 0]) == 0


def test_stored_pictures_use_what_takes_fewest_bits():
    row = np.random.default_rng(3).integers(0, 256, 576).astype(np.uint8).tobytes()
    ramp = bytes(k * 7 % 256 for k in range(5760))
    text = "".join(random.Random(1).choices("etaoin shrdlu,.ABCDEFGHIJK", k=5760)).encode()
    few = bytes(k % 5 for k in range(576))
    kinds = [webp.choose(np.frombuffer(x, np.uint8).reshape(-1, 576)) for x in (row * 9, ramp, text, few)]
    assert kinds == [(("predictor", "subtract_green"), 2), (("predictor", "subtract_green"), 1), (("subtract_green",), 0), (("palette",), 0)]
    for x in (row * 9, ramp, text, few):
        assert webp.load(webp.store(x)) == x
    plain = webp.encode(np.frombuffer(row * 9, np.uint8).reshape(-1, 576).astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000), ("subtract_green",))
    assert len(webp.store(row * 9)) < len(plain)


@pytest.mark.parametrize("cut", [25, 60])
def test_webp_truncated(cut):
    stored = webp.store(b"some payload of letters " * 48)
    with pytest.raises((ValueError, IndexError)):
        webp.decode(stored[:cut])


def test_media_rows(spark):
    texts = [*ODD, "long text " * 150_000, "y" * 576, "y" * 575, "y" * 577]
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "payload")
    out = {r.doc_id: r for r in webp.media(clashing(spark, texts), outputs=names).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        want = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload)) == (len(data), len(want), want)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and webp.load(bytes(r.media)) == want
    assert out[8].feature == out[9].feature and out[8].media_sha256 == out[9].media_sha256
    assert webp.media(docs(spark, [])).collect() == []
