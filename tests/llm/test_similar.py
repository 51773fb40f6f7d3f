"""Near-duplicates by word shingles, against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def components(rows):
    sets, root = [grams(t) for _, t in rows], {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[rows[a][0]], root[rows[b][0]]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def edited(rnd, words, n):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"new{rnd.random()}"
    return out


@pytest.mark.parametrize("block", [2048, 5])
def test_groups_against_brute_force(spark, block):
    rnd = random.Random(7)
    texts = [None, "", "one two", "One  TWO", "a b c d e"]
    for _ in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 400))]
        for _ in range(7):
            texts.append(" ".join(edited(rnd, words, rnd.randrange(0, max(2, len(words) // 35)))))
    rows = list(zip(rnd.sample(range(9999), len(texts)), texts))
    out = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r.doc_id: r.component_id for r in out} == components(rows) and len(out) == len(rows)


def test_stage_drops_edited_copies(spark, sf_dir):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rnd, words, 4))), (3, " ".join(edited(rnd, words, 60)))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, rows without id, wholly equal rows and clashing columns."""
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    near = " ".join(edited(rnd, words, 1))
    rows = [(1, "a b c d", "x"), (5, "a b c d", "x"), (5, "totally other words here now", "x"), (5, "totally other words here now", "x"), (5, "totally other words here now", "y")]
    rows += [(None, " ".join(words), "x"), (9, near, "x"), (None, "only without id at all", "x"), (None, "only without id at all", "y"), (None, None, "x"), (7, "", "x")]
    rows += [(20, "hot row of equal columns", "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = sorted(tuple(r)[:2] for r in simhash.keep_one(df).collect() if r.doc_id is not None)
    assert out == [(1, "a b c d"), (5, "totally other words here now"), (7, ""), (9, near), (20, "hot row of equal columns")]
    assert [r.text for r in simhash.keep_one(df).where("doc_id is null").collect()] == ["only without id at all"]
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [10_000, 10**7])
def test_pairs_at_the_threshold_agree_in_a_part(n):
    words, parts, bound = simhash.shape(n, 0.8)
    rng = np.random.default_rng(0)
    met, pairs = 0, 1500
    cut = [list(x) for x in np.array_split(rng.permutation(64 * words), parts)]
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (np.array(simhash.set_fingerprint(np.sort(y), words), np.uint64) for y in (x[:270], x[30:]))
        bits = np.unpackbits((a ^ b).view(np.uint8), bitorder="little")
        met += any(not bits[p].any() for p in cut) and int(bits[:128].sum()) <= bound
    assert met >= (1 - 2 * simhash.MISS) * pairs - 3


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash.similar(docs).collect()
    assert {r.doc_id: r.component_id for r in out} == components([tuple(r) for r in docs.collect()])
