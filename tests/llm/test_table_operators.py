"""Archives, vectors, pages, mixing, shards and the pipeline: against brute force on small tables."""

import base64
import gzip
import hashlib
import io
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import bpe, embed_dedup, html_extract, langid, mixing, queries, reshard, toxicity, warc
from folioscope.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- WARC -------------------------------------------------------------------------


PAGES = [(3, "http://a", "x"), (1, "http://b", "x"), (2, None, None), (7, "u", ""), (5, "u", "é" * 3_000_000), (6, "u", "é" * 3_000_000), (8, "u\r\nX: y", "<p>one</p>"), (9, "u", "x")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, refers_to string, payload string")


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_warc_round_trip(spark, min_bytes):
    out = {r.page_id: r for r in warc.round_trip(pages(spark, PAGES), min_bytes).collect()}
    assert len(out) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = sorted(j for j, _, h in PAGES if (h or "") == (html or ""))
        first = same[0] if len(data) >= min_bytes else i
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload is None if first != i else bytes(r.payload) == data
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_warc_many_copies_and_null_id(spark):
    rows = [(i, "u", "copy") for i in range(1, 400)] + [(None, "u", "copy"), (0, "u", "own")]
    out = warc.round_trip(pages(spark, rows)).collect()
    assert len(out) == len(rows) and sum(r.record_type == "revisit" and r.refers_to == 1 for r in out) == 398


def test_warc_reader_verifies():
    good = warc.member(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    both = list(warc.read_records(io.BytesIO(good + warc.member(2, "u", b"payload", 1, "1970-01-01T00:00:00Z"))))
    assert [r.headers["warc-type"] for r in both] == ["response", "revisit"] and both[0].payload == b"payload" and both[1].payload == b""
    raw = zlib.decompress(good, 31)
    broken = zlib.compressobj(9, zlib.DEFLATED, 31)
    data = broken.compress(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")) + broken.flush()
    with pytest.raises(warc.DigestError):
        list(warc.read_records(io.BytesIO(data)))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    short = zlib.compressobj(9, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="content length"):
        list(warc.read_records(io.BytesIO(short.compress(raw[:-3]) + short.flush())))


def foreign(kind, block, *fields):
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), *fields, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def test_warc_reads_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    hexed = hashlib.sha256(b"body").hexdigest()
    data = foreign("warcinfo", b"software: x\r\n", ("Content-Type", "application/warc-fields"))
    data += foreign("request", b"GET / HTTP/1.1\r\n\r\n", ("Content-Type", "application/http; msgtype=request"))
    data += foreign("response", http, ("Content-Type", "application/http; msgtype=response"), ("WARC-Target-URI", "http://a"))
    data += foreign("response", http, ("Content-Type", "application/http"), ("WARC-Payload-Digest", f"sha256:{hexed}"), ("WARC-Block-Digest", "rare9:zz"))
    data += foreign("revisit", b"", ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:" + warc.sha1(b"body").lower()))
    (tmp_path / "a.warc.gz").write_bytes(data)
    out = warc.read(spark, spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).collect()
    assert [(r.record_type, r.url, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in out] == [
        ("warcinfo", None, 13, None, b"software: x\r\n"),
        ("request", None, 0, None, b""),
        ("response", "http://a", 4, None, b"body"),
        ("response", None, 4, f"sha256:{hexed}", b"body"),
        ("revisit", None, None, warc.sha1(b"body").lower(), None),
    ]
    with pytest.raises(warc.DigestError):
        list(warc.read_records(io.BytesIO(foreign("resource", b"other", ("WARC-Block-Digest", "md5:" + hashlib.md5(b"x").hexdigest())))))


def test_revisits_name_the_record_that_they_refer_to(spark):
    scratch = Scratch(spark, "test")
    archives = warc.write(pages(spark, PAGES), scratch, f"{scratch.root}/archives")
    records = [r for row in archives.collect() for r in warc.read_records(open(row.path.removeprefix("file://"), "rb"))]
    ids = {r.headers["warc-record-id"]: r.headers for r in records}
    assert len(ids) == len(records)
    for h in ids.values():
        if h["warc-type"] == "revisit":
            first = ids[h["warc-refers-to"]]
            assert first["warc-type"] == "response" and first["warc-target-uri"] == h.get("warc-refers-to-target-uri", "") and first["warc-payload-digest"] == h["warc-payload-digest"]


# --- vectors -----------------------------------------------------------------------


def brute_links(rows, threshold):
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(c is not None and np.isfinite(c) for c in v) and np.any(v):
            x = np.array(v, float)
            unit[i] = x / np.linalg.norm(x), label
    links = {i: set() for i, *_ in rows}
    for a, (x, s) in unit.items():
        for b, (y, t) in unit.items():
            if a < b and s == t and len(x) == len(y) and x @ y >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return {i: (len(links[i]), root[i]) for i in links}


def vector_rows(n=500, dim=32, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and i > 10:
            base = np.array(rows[rng.integers(0, len(rows))][1])
            v = base + spread * rng.normal(size=dim) * np.linalg.norm(base) / np.sqrt(dim)
        else:
            v = rng.normal(size=dim)
        rows.append((i * 7 % 10_007, [float(np.float32(c)) for c in v], int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("block", [512, 12])
def test_vector_links_against_brute_force(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, 0.93, block=block).collect()}
    want = brute_links(rows, 0.93)
    # Recall is by chance of the filters: nearly all links, and none that is not one.
    assert all(out[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in out.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_tight_groups_are_whole(spark):
    rows = vector_rows(300, spread=0.02, seed=5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, 0.93, block=16).collect()}
    assert out == brute_links(rows, 0.93)


def test_odd_vectors(spark):
    one = [1.0] + [0.0] * 7
    rows = [(1, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0] * 8, 0), (7, [float("nan"), *one[1:]], 0), (8, [None, *one[1:]], 0), (9, [], 0), (10, [5.0, 0.0], 0), (11, [1e-30] + [0.0] * 7, 0), (12, [1.0], 0), (13, [2.0], 0)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, filters string, unit int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    want = brute_links(rows, 0.93)
    assert out == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_repeated_and_missing_ids(spark):
    """n_links counts rows; a row without id is linked and not kept."""
    rng = np.random.default_rng(4)
    x, y = ([float(np.float32(c)) for c in rng.normal(size=16)] for _ in range(2))
    rows = [(1, x, 0), (1, x, 0), (2, x, 0), (3, y, 0), (3, x, 1), (None, y, 0), (None, [1.0] * 16, 0), (9, y, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embed_dedup.near_duplicates(df).collect()))
    assert out == [(-1, 0, -1, False), (-1, 1, 3, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 1, 3, True), (9, 0, 9, True)]
    hot = spark.createDataFrame([(i, x, 0) for i in range(3000)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r)[1:3] for r in embed_dedup.near_duplicates(hot).collect()} == {(2999, 0)}


@pytest.mark.parametrize(("dim", "n"), [(64, 6_000), (64, 1_000_000), (16, 50_000)])
def test_pairs_at_the_threshold_share_a_filter(dim, n):
    code = embed_dedup.ProductCode(dim, *embed_dedup.ProductCode.shape(dim, n, 0.93))
    assert code.missed(0.93, 1000) <= 2.5 * embed_dedup.MISS


def test_list_decoding_finds_all_filters():
    code = embed_dedup.ProductCode(16, 24, 20.0)
    x = np.random.default_rng(3).normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = code._products(x)
    for row, got in enumerate(code.decode(x, least=1)):
        sums = (a[row][:, None] + b[row][None, :]).ravel()
        want = np.flatnonzero(sums >= code.alpha)
        assert (got == want).all() if len(want) else len(got) >= 1


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    got = {r.node: r.root for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    rows = [(i, None, None) for i in range(300)]
    links = {i: set() for i, *_ in rows}
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    seen = {}
    for i in range(300):
        todo = [] if i in seen else [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = i
                todo += links[k]
    assert all(seen[k] == r for k, r in got.items()) and {k for k in links if links[k] - {k}} == set(got)
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


# --- pages --------------------------------------------------------------------------


LONG = "This sentence is part of the article and says a good deal about its subject. " * 3


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; us</footer></body></html>", f"Head & line\n{LONG.strip()}\nShort."),
        (f"<div id=header>Site</div><div class='content'><h2>H</h2><p>{LONG}<p>a<b>b</b>\n  c<br>d</div><div class='sidebar'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div>", f"H\n{LONG.strip()}\nab c d"),
        (f"<body><ul class=menu><li><a>One</a><li><a>Two</a></ul><p>{LONG}</p><form>Name <input></form><div class='ad-box'>{LONG}</div><p>{LONG}</p><script>var t='</p>';</script></body>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<main><p>{LONG}</p><aside>{LONG}</aside><div class=cookieBanner>{LONG}</div><p>&lt;end&gt; &#233;</p></main>", f"{LONG.strip()}\n<end> é"),
        (f"<div class='page has-sidebar'><header class=top><h2>Site</h2></header><div class=post-header><h1>Head</h1></div><p>{LONG}</p></div>", f"Head\n{LONG.strip()}"),
        (f"<article><header><h1>Own head</h1></header><p>{LONG}</p><section class=reader-comments><p>{LONG}</p></section></article>", f"Own head\n{LONG.strip()}"),
        (f"<p>{LONG}<script>x('<p>')</script> tail</p>", f"{LONG.strip()} tail"),
        ("", ""),
        (None, ""),
        ("<p>", ""),
        ("<script>only()</script>", ""),
        ("plain words only", "plain words only"),
        ("<article><p>unclosed <b>tags &amp", "unclosed tags &"),
    ],
)
def test_main_text(html, expected):
    assert html_extract.main_text(html) == expected


def test_smoothing_and_threshold():
    x = np.array([0.0, 0, 100, 90, 0, 110, 0, 0, 0])
    level = html_extract.smooth(x)
    assert level[4] > level[0] and html_extract.smooth(np.full(5, 3.0)) == pytest.approx(np.full(5, 3.0))
    assert level[0] < html_extract.threshold(level) < level[3]


def plain_main_text(html):
    """The same by loops over the parser's lines."""
    lines = html_extract.lines_of(html)
    if all(x.barred for x in lines):
        return ""
    ratios = [0.0 if x.barred else len(x.text) * (1 - x.linked) / max(1, x.tags) for x in lines]
    level = []
    for i in range(len(lines)):
        near = [(math.exp(-((i - j) ** 2) / 2), r) for j, r in enumerate(ratios) if abs(i - j) <= 3]
        level.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    roots = [x**0.5 for x in level]
    low, high, cut = min(roots), max(roots), 0.0
    if high - low >= 1e-9:
        for _ in range(20):
            mid = (low + high) / 2
            a, b = [x for x in roots if x < mid], [x for x in roots if x >= mid]
            now = (sum(a) / len(a) if a else low, sum(b) / len(b) if b else high)
            if now == (low, high):
                break
            low, high = now
        cut = ((low + high) / 2) ** 2
    core = {i for i in range(len(lines)) if level[i] >= cut - 1e-9 * cut and ratios[i] > 0}
    taken = set(core)
    for i in sorted(core):
        later = [j for j in core if j > i]
        if later and not any(lines[k].barred for k in range(i, min(later))):
            taken |= set(range(i, min(later)))
    for i in core:
        for way in (-1, 1):
            for k in range(i + way, len(lines) if way > 0 else -1, way):
                x = lines[k]
                if k in core or not (x.article and lines[i].article if x.barred else k in taken or (x.linked < 0.5 and x.block in html_extract.RUNNING)):
                    break
                taken |= set() if x.barred else {k}
    return "\n".join(lines[i].text for i in sorted(taken) if not lines[i].barred)


def test_selection_against_a_plain_version():
    rnd = random.Random(12)
    words = "some words of a text that goes on and on".split()
    for _ in range(300):
        body = ""
        for _ in range(rnd.randrange(1, 14)):
            text = " ".join(rnd.choices(words, k=rnd.choice([1, 3, 12, 60])))
            tag = rnd.choice(["p", "p", "p", "li", "div", "h2", "span"])
            more = rnd.choice(["", "", "", " class=ad", " id=discussion", " class=sidebar"])
            body += f"<{tag}{more}>{f'<a href=x>{text}</a>' if rnd.random() < 0.2 else text}</{tag}>"
        page = f"<article>{body}</article>" if rnd.random() < 0.4 else f"<div>{body}</div>"
        assert html_extract.main_text(page) == plain_main_text(page)


def test_marked_articles_and_plain_ones_are_the_same():
    page = f"<nav>Home</nav><article><h1>Head</h1><p>{LONG}</p><div class=ad>{LONG}</div><p>Short.</p><h2 id='related-work'>Related work</h2><p>{LONG}</p><section id='discussion'><p>{LONG}</p></section></article><footer>x</footer>"
    want = "\n".join(["Head", LONG.strip(), "Short.", "Related work", LONG.strip(), LONG.strip()])
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(page.replace(" id='discussion'", "").replace(" id='related-work'", "").replace("<article", "<div").replace("</article", "</div")) == want


def test_hostile_markup_takes_linear_time():
    took = []
    for n in (4000, 16000):
        page = "<div>" * n + "</span></i></b>" * n + f"<p>{LONG}</p>"
        start = time.process_time()
        assert html_extract.main_text(page) == LONG.strip()
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.2


def test_page_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "c"), (2, None, None, "c"), (2, "v", "", "c"), (3, "u", f"<p>{LONG}</p>" * 4000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extract(df).collect()
    assert sorted((r.page_id, len(r.text)) for r in out) == [(1, len(LONG) - 1), (2, 0), (2, 0), (3, 4000 * len(LONG) - 1)]
    assert html_extract.extract(df.limit(0)).collect() == []


# --- mixing -----------------------------------------------------------------------


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(2)
    cells = np.array([(i, j, k) for i in range(4) for j in range(3) for k in range(2)])
    mass = rng.random(len(cells)) * 100 + 1
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    w = mixing.rake(cells, mass, targets)
    for d, t in enumerate(targets):
        got = np.bincount(cells[:, d], weights=mass * w)
        assert got / got.sum() == pytest.approx(t, abs=1e-6)
    p = mixing.calibrate(mass, w, 0.3)
    assert (mass * p).sum() == pytest.approx(0.3 * mass.sum(), rel=1e-6) and p.max() <= 1


def test_mix_rows(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(1, 60), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), None) for i in range(1500)]
    rows += [(2000, None, "en", "a", None), (2001, "", "en", "a", None), (2002, "x", "en", "a", None), (2002, "x", "en", "a", None)]
    df = spark.createDataFrame([(*r, "w", True) for r in rows], DOCS + ", weight string, kept boolean")
    targets = {"source": {"a": 0.5, "b": 0.25, "(none)": 0.25}, "lang": {"en": 0.6, "de": 0.3, "(none)": 0.1}}
    out = mixing.mix(df, targets, budget=0.5).toPandas()
    assert len(out) == len(rows) and out.probability.between(0, 1).all()
    assert dict(zip(out.doc_id, out.tokens))[2000] == 0 and out[out.doc_id == 2002].kept.nunique() == 1
    weighted = out.assign(m=out.tokens * out.weight)
    for column, want in targets.items():
        share = weighted.groupby(column).m.sum() / weighted.m.sum()
        assert {k: round(v, 4) for k, v in share.items()} == pytest.approx(want, abs=1e-3)
    assert (out.tokens * out.probability).sum() == pytest.approx(0.5 * out.tokens.sum(), rel=1e-6)
    kept = out[out.kept].tokens.sum() / out.tokens.sum()
    assert abs(kept - 0.5) < 0.05
    again = mixing.mix(df.repartition(3), targets, budget=0.5).toPandas()
    assert set(again[again.kept].doc_id) == set(out[out.kept].doc_id)
    assert mixing.mix(df.limit(0)).count() == 0


def test_tokens_and_topics(spark):
    texts = ["a b  c", "  x\ny ", "", None, "\t \n", "sharks Sharks sharks swim often", "planets orbit planets planets", "a\n\nb"]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r for r in mixing.mix(df, budget=1.0).collect()}
    assert [out[i].tokens for i in range(len(texts))] == [len((t or "").split()) for t in texts] == [3, 2, 0, 0, 0, 5, 4, 2]
    counts = [np.bincount([mixing._bucket(w) for w in (t or "").split()], minlength=mixing.TOPICS + 1)[: mixing.TOPICS] for t in texts]
    share = sum(counts) / sum(c.sum() for c in counts)
    for i, c in enumerate(counts):
        score = [(n - c.sum() * q) / max(c.sum() * q, 1e-9) ** 0.5 for n, q in zip(c, share)]
        assert out[i].topic == (f"t{score.index(max(score)):02d}" if c.sum() else mixing.NONE)


def test_expected_sample_has_the_targets_under_the_bound():
    """At a budget where plain scaling takes many cells over 1."""
    rng = np.random.default_rng(6)
    cells = np.array([(i, j, k) for i in range(8) for j in range(4) for k in range(5)])
    mass = rng.lognormal(3, 0.8, len(cells)) * 0.6 ** cells[:, 0] * 0.5 ** cells[:, 1]
    targets = []
    for d in range(3):
        share = (np.bincount(cells[:, d], weights=mass) / mass.sum()) ** 0.7
        targets.append(share / share.sum())
    budget = 0.8
    w = mixing.rake(cells, mass, targets)
    plain = mixing.calibrate(mass, w, budget)
    assert (plain == 1).mean() > 0.2
    p = mixing.rake_bounded(cells, mass, w, targets, budget)
    assert p.max() <= 1 and (mass * p).sum() == pytest.approx(budget * mass.sum(), rel=1e-6)
    for d, t in enumerate(targets):
        held = np.bincount(cells[:, d], weights=mass) / mass.sum()
        want = mixing.fillable(t, held, budget)
        got = np.bincount(cells[:, d], weights=mass * p) / (mass * p).sum()
        assert got == pytest.approx(want, rel=0.01) and want.sum() == pytest.approx(1) and (want * budget <= held + 1e-12).all()
        short = t * budget > held
        assert want[short] * budget == pytest.approx(held[short]) and (want[~short] / t[~short]).max() >= 1 - 1e-9


def test_marginals_of_a_plan(spark):
    rnd = random.Random(8)
    words = [f"term{k}" for k in range(300)]
    rows = [(i, " ".join(rnd.choices(words[: rnd.choice([20, 300])], k=rnd.randrange(1, 60))), rnd.choices(["en", "de", "es", None], [60, 25, 12, 3])[0], rnd.choices(["a", "b", "c"], [70, 25, 5])[0], None) for i in range(6000)]
    celled, _ = mixing.cells_of(spark.createDataFrame(rows, DOCS))
    _, table = mixing.plan(celled)
    out = mixing.marginals(table).toPandas()
    assert {"en", "de", "es", mixing.NONE} == set(out[out.dimension == "lang"].value) and out[out.dimension == "topic"].value.nunique() > 10
    assert (out.target * mixing.BUDGET > out.tokens / (out.tokens.sum() / 3)).any()
    for d, rows in out.groupby("dimension"):
        want = mixing.fillable(rows.target.to_numpy(), (rows.tokens / rows.tokens.sum()).to_numpy(), mixing.BUDGET)
        assert rows.expected.to_numpy() == pytest.approx(want, rel=0.01), d


# --- shards -----------------------------------------------------------------------


def test_min_cost_flow_against_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        supply, room = [rng.randrange(0, 3) for _ in range(2)], [rng.randrange(0, 3) for _ in range(2)]
        cost = [[rng.randrange(0, 5) for _ in range(2)] for _ in range(2)]
        arcs = [(4, i, supply[i], 0.0) for i in range(2)] + [(i, 2 + j, 9, float(cost[i][j])) for i in range(2) for j in range(2)] + [(2 + j, 5, room[j], 0.0) for j in range(2)]
        flow = reshard.min_cost_flow(6, arcs, 4, 5)
        got = (-sum(flow[:2]), sum(f * a[3] for f, a in zip(flow, arcs)))
        best = min((-sum(f), sum(f[2 * i + j] * cost[i][j] for i in range(2) for j in range(2))) for f in np.ndindex(3, 3, 3, 3) if all(f[2 * i] + f[2 * i + 1] <= supply[i] and f[i] + f[2 + i] <= room[i] for i in range(2)))
        assert got == best


def shard_rows(spark, n, old=5):
    rnd = random.Random(7)
    rows = [(i, 16 + rnd.randrange(0, 5000), i % old if i % 3 else 0, "c") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, size long, old_shard int, slot string"), rows


@pytest.mark.parametrize(("n", "shards"), [(1003, 8), (7, 40), (200, 3)])
def test_shards_are_even_and_gapless(spark, n, shards):
    df, rows = shard_rows(spark, n)
    out = reshard.assign(df, shards=shards).toPandas()
    counts = out.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(out) == n and counts.max() - counts.min() <= 1 and out.doc_id.is_unique
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    # As few rows move as the row counts allow.
    held = {s: sum(r[2] == s for r in rows) for s in range(5)}
    room = reshard.capacities(n, shards)
    least = sum(max(0, held[s] - (room[s] if s < shards else 0)) for s in held)
    assert (out.old_shard != out.shard).sum() <= least + shards


def test_moved_rows_are_the_smallest(spark):
    df = spark.createDataFrame([(i, 16 if i < 50 else 4096, 0) for i in range(100)], "doc_id long, size long, old_shard int")
    out = reshard.assign(df, shards=2).toPandas()
    assert set(out[out.shard == 1].doc_id) == set(range(50))


def test_equal_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, 20, 0)] * 9 + [(None, 16, 0), (None, 16, None)], "doc_id long, size long, old_shard int")
    out = reshard.assign(df, shards=4).toPandas()
    assert sorted(out.groupby("shard").size()) == [2, 3, 3, 3]
    assert reshard.assign(df.limit(0), shards=4).count() == 0


def fewest_bytes(rows, shards):
    """Smallest bytes that leave their shard, over all ways to deal the one row more."""
    held = {}
    for _, size, old in rows:
        held.setdefault(old, []).append(size)
    n, extra = len(rows) // shards, len(rows) % shards
    cost = lambda j, room: sum(sorted(held.get(j, []))[: max(0, len(held.get(j, [])) - room)])
    lost = sum(sum(x) for j, x in held.items() if j is None or j >= shards)
    gain = sorted((cost(j, n + 1) - cost(j, n) for j in range(shards)))
    first = sum((cost(j, n + (j < extra)) for j in range(shards)))
    assert first >= sum(cost(j, n) for j in range(shards)) + sum(gain[:extra])
    return lost + first


@pytest.mark.parametrize(("n", "shards", "old"), [(997, 7, 5), (400, 3, 6), (60, 9, 2)])
def test_fewest_bytes_move(spark, n, shards, old):
    """Against brute force: with the capacities given, each shard gives its smallest rows."""
    rnd = random.Random(n)
    rows = [(i, 16 + int(rnd.lognormvariate(5, 1.5)), rnd.choice([None, *range(old)]) if i % 3 else 0) for i in range(n)]
    out = reshard.assign(spark.createDataFrame(rows, "doc_id long, size long, old_shard int"), shards=shards).toPandas()
    moved = out[out.old_shard.isna() | (out.old_shard != out.shard)]["size"].sum()
    assert moved == fewest_bytes(rows, shards)


@pytest.mark.parametrize("hot", [50_000, 20])
def test_rewrite(spark, tmp_path, monkeypatch, hot):
    """All rows come back with their texts, whatever their ids; only affected files are written."""
    monkeypatch.setattr(reshard, "PART_ROWS", hot)
    rnd = random.Random(3)
    rows = [(i, "t" * rnd.randrange(1, 400), 0 if i < 240 else 1 + i % 2) for i in range(400)]
    rows += [(5, "other text of a repeated id", 0), (5, "t", 0), (5, "t", 0), (None, "none", 1), (None, None, None), (None, None, 7)] + [(9, "h" * 84, 0)] * 90
    full = spark.createDataFrame([(i, t, len(t or "") + 16, o, "c") for i, t, o in rows], "doc_id long, text string, size long, old_shard int, slot string")
    stay, written = reshard.rewrite(full, str(tmp_path / "out"), shards=4)
    kept, back = stay.collect(), written.collect()
    placed = [(r.doc_id, r["size"], r.old_shard) for r in [*kept, *back]]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(placed, key=key) == sorted(((i, len(t or "") + 16, o) for i, t, o in rows), key=key)
    assert "text" not in stay.columns and all(r.shard == r.old_shard for r in kept)
    texts = sorted((r.text or "") for r in back)
    assert len(back) < len(rows) and all(len(r.text or "") + 16 == r["size"] for r in back) and "other text of a repeated id" in texts
    slots = {}
    for r in [*kept, *back]:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, slots.values())) == [124, 124, 124, 124] and all(sorted(x) == list(range(124)) for x in slots.values())
    moved = sum(r["size"] for r in back if r.old_shard != r.shard)
    assert moved == fewest_bytes([(i, len(t or "") + 16, o) for i, t, o in rows], 4)


def test_rewrite_of_nothing(spark, tmp_path):
    full = spark.createDataFrame([], "doc_id long, text string, size long, old_shard int")
    stay, written = reshard.rewrite(full, str(tmp_path / "out"), shards=4)
    assert stay.collect() == [] and written.collect() == []


# --- pipeline -----------------------------------------------------------------------


def test_pipeline_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    machine = toxicity.train(docs, labels)
    clean = [r for r in rows if machine.score(sorted(machine.index[t] for t in toxicity.terms_of(r["text"]) if t in machine.index)) < toxicity.THRESHOLD]
    model = langid.train(spark.createDataFrame(clean, docs.schema), queries.vocabulary(queries.PIECE_VOCABULARY))

    def language(text):
        words = langid.words_of(text or "")
        if not words:
            return langid.UND, 0.0
        log = model.words(words).sum(axis=0)
        return model.langs[int(log.argmax())], float(1 / np.exp(log - log.max()).sum())

    known = [r for r in clean if language(r["text"])[0] != langid.UND and language(r["text"])[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    grams = []
    for r in known:
        words = (r["text"] or "").encode().lower().split()
        grams.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    root = list(range(len(known)))
    for a in range(len(known)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = root[a], root[b]
                low, high = (x, y) if known[x]["doc_id"] < known[y]["doc_id"] else (y, x)
                root = [low if k == high else k for k in root]
    single = [r for k, r in enumerate(known) if root[k] == k]

    out = spark.createDataFrame(single, docs.schema)
    celled, _ = mixing.cells_of(out)
    cells, _ = mixing.plan(celled)
    p = {(r.source, r.lang, r.topic): r.probability for r in cells.itertuples()}
    chance = {r.doc_id: (r.u, r._source, r._lang, r._topic) for r in celled.select("doc_id", mixing.chance("doc_id").alias("u"), "_source", "_lang", "_topic").collect()}
    kept = {r["doc_id"] for r in single if chance[r["doc_id"]][0] < p[chance[r["doc_id"]][1:]]}
    encoder = bpe.ByteBPE(queries.vocabulary(queries.BPE_VOCABULARY))
    want = {r["doc_id"]: hashlib.sha256(encoder.encode(r["text"] or "")).hexdigest() for r in single if r["doc_id"] in kept}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_keep_the_columns(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mix", "tokens"]
    docs = spark.createDataFrame([], DOCS + ", toxicity string, weight string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
