"""SimHash near-dedup with the generalised pigeonhole principle.

Two fingerprints that differ in at most ``tau`` bits, cut into m parts, differ
in at most t_i bits in some part i for any thresholds with
sum(t_i) = tau - m + 1 (a part with t_i = -1 is not probed).  Correlated bits
are grouped into one part, so that the other parts are close to uniform; the
number of parts and their unequal thresholds are found by dynamic programming
on estimated candidate counts; probing is an equi-join on masked part values.

``near_duplicates`` links 64-bit fingerprints by exact Hamming distance.
``similar`` links texts by the Jaccard similarity of their shingle sets: the
fingerprints are as long as the similarity asks for (two texts at the threshold
agree in a whole part with a chance of 1 - MISS), candidates are compared by
128 bits, and what is left is verified exactly on the sets.

Equal fingerprints (or sets) are merged before anything is joined, so a group
of copies costs one row, however large.  Groups of one part value are cut into
blocks, none is capped.  Inside a block only a spanning forest of the links
found is kept: the components are the same, and the output stays linear.

Edge cases: null and empty texts, and texts without a word, have fingerprint 0
(and equal, empty sets) and link like any other; a text of fewer words than a
shingle is one shingle; repeated rows keep their own output row; an empty table
gives an empty table; other columns are ignored; a row without id gets a
fingerprint and no component of its own making.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, Scratch, blocked, components, forest, lookup, small_batches, sorted_groups

SEED = 42
#: So many shingles are hashed at a time, which bounds the memory of a long text.
CHUNK = 200_000
#: Share of the pairs just at the threshold of ``similar`` that may agree in no part.
MISS = 0.002
#: A shuffled row costs about as much as so many comparisons of two fingerprints.
ROW_COST = 200
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles, repeats included, some at a time.

    bytes.lower() changes A-Z only and bytes.split() cuts at 0x20 and 0x09 to
    0x0D only, which is the operator's definition of words.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return
    last = max(len(words) - shingle + 1, 1)
    for start in range(0, last, CHUNK):
        part = words[start : min(start + CHUNK, last) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED)), np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    by_byte = hashes.view(np.uint8).reshape(-1, 8).astype(np.intp)
    by_byte += np.arange(8, dtype=np.intp) * 256
    return (np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit majority fingerprint of the text's word shingles, repeats included."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, shingle):
        total += len(hashes)
        ones += _ones(hashes)
    return _majority(ones, total)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    parts = [np.unique(x) for x in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def node_of(found: np.ndarray) -> int:
    """A signed number for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED + 1)).view(np.int64))


def set_fingerprint(found: np.ndarray, words: int) -> list[int]:
    """The fingerprint of 64 * words bits of a set: each word by another mix of the hashes."""
    out = []
    for k in range(words):
        mixed = found
        if k:
            mixed = found * _MIX[k]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
            mixed ^= mixed >> np.uint64(32)
        ones = sum((_ones(mixed[i : i + CHUNK]) for i in range(0, len(mixed), CHUNK)), np.zeros(64, np.int64))
        out.append(_majority(ones, len(found)))
    return out


#: Odd multipliers.
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as signed long) for every row."""
    small_batches(df.sparkSession)
    src = df.select(id_col, df[text_col].alias("__text"))
    schema = T.StructType([T.StructField(id_col, src.schema[0].dataType, True), T.StructField("fingerprint", T.LongType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[id_col, "fingerprint"])

    return src.mapInArrow(run, schema)


def _columns(words: int) -> list[str]:
    return ["fingerprint", *(f"f{k}" for k in range(1, words))]


def bit_counts(prints: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: sums over all rows."""
    size = 64 * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((size, size), np.int64)
        for batch in batches:
            bits = _bits([c.to_numpy() for c in batch.columns])
            n += len(bits)
            both += (bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
        at = np.arange(size * size + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n))], names=["at", "n"])

    rows = prints.select(*_columns(words)).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(size * size + 1, np.int64)
    for r in rows.where("n > 0").collect():
        flat[r[0]] = r[1]
    return int(flat[-1]), flat[:-1].reshape(size, size)


def _bits(prints: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for x in prints], axis=1)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of the bits; a part starts at the bit most correlated with the free ones and takes its closest."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = np.arange(len(p)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [int(free[np.argmax(corr[np.ix_(free, free)].sum(axis=1))])]
        closeness = corr[:, part[0]].copy()
        open_ = np.zeros(len(p), bool)
        open_[free] = True
        open_[part] = False
        while len(part) < size:
            b = int(np.argmax(np.where(open_, closeness, -1)))
            part.append(b)
            open_[b] = False
            closeness += corr[:, b]
        free = np.flatnonzero(open_)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """Thresholds t_i >= -1 with sum tau - m + 1 and the least sum of costs[i][t_i + 1], by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(tau, len(row) - 2, tau - used) + 1):
                now = (cost + row[t + 1], [*chosen, t])
                if used + t + 1 not in step or now < step[used + t + 1]:
                    step[used + t + 1] = now
        best = step
    return best[tau + 1][1]


def part_values(prints: list[np.ndarray], part: list[int]) -> np.ndarray:
    out = np.zeros(len(prints[0]), np.int64)
    for k, b in enumerate(part):
        out |= ((prints[b >> 6] >> np.int64(b & 63)) & np.int64(1)) << np.int64(k)
    return out


def candidate_costs(prints: DataFrame, n: int, parts: list[list[int]], p: np.ndarray, tau: int, words: int = 1) -> list[list[float]]:
    """Estimated cost of probing each part at thresholds -1 to tau: comparisons of candidates, and shuffled rows.

    Pairs with equal values are counted over all fingerprints; pairs within t
    bits follow from it by the odds that a bit differs, from the bit shares p.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c.to_numpy() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), len(x[0]))), pa.array(np.concatenate([part_values(x, part) for part in parts]))], names=["part", "value"])

    c = F.count(F.lit(1)).alias("c")
    rows = prints.select(*_columns(words)).mapInArrow(run, "part int, value long").groupBy("part", "value").agg(c).groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    pairs = {r[0]: r[1] for r in rows}
    costs = []
    for i, part in enumerate(parts):
        odds = [2 * p[b] * (1 - p[b]) / max(1 - 2 * p[b] * (1 - p[b]), 1e-9) for b in part]
        most = min(tau, len(part))
        within, symmetric = 0.0, [1.0] + [0.0] * most  # elementary symmetric sums: choices of differing bits
        for o in odds:
            for t in range(most, 0, -1):
                symmetric[t] += symmetric[t - 1] * o
        row = [0.0]
        for t in range(most + 1):
            within += symmetric[t] * (pairs.get(i, 0.0) + 1.0)
            row.append(within * (t + 1) + ROW_COST * n * math.comb(len(part), t))
        costs.append(row)
    return costs


def plan_probes(prints: DataFrame, tau: int, choices: tuple[int, ...], words: int = 1) -> list[tuple[list[int], int]]:
    """(part, threshold) of the parts to probe, for the number of parts among ``choices`` that costs least."""
    n, both = bit_counts(prints, words)
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in choices:
        parts = group_bits(n, both, m)
        costs = candidate_costs(prints, n, parts, p, tau, words)
        chosen = allocate(costs, tau)
        cost = sum(row[t + 1] for row, t in zip(costs, chosen))
        if best is None or cost < best[0]:
            best = cost, [(part, t) for part, t in zip(parts, chosen) if t >= 0]
    return best[1]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2, m: int | tuple[int, ...] | None = None, block: int = 2048) -> DataFrame:
    """(id, fingerprint as signed long, component_id) for every row; component_id the smallest id reachable by links.

    ``m`` is the number of parts; by default it is chosen by cost, of tau and tau + 1.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.cut(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    prints = scratch.cut(docs.groupBy("fingerprint").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    links = linked(scratch, prints.where("rep is not null"), tau, m or (max(tau, 1), tau + 1), block)
    parts = components(scratch, links)
    mapping = prints.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", "n", F.coalesce("root", "rep").alias("component_id"))
    mapping = scratch.cut(mapping, "mapping")
    return lookup(docs, "fingerprint", mapping, docs.count()).select(id_col, "fingerprint", "component_id")


def linked(scratch: Scratch, prints: DataFrame, tau: int, m: int | tuple[int, ...], block: int, words: int = 1, bound: int | None = None, ratio: float = 0.0) -> DataFrame:
    """Links (a, b) between reps of close fingerprints: a forest in each probed block.

    Close are those that differ in at most ``bound`` (or ``tau``) of the first
    128 bits, and whose ``size`` has at least the given ratio.
    """
    probes = plan_probes(prints, tau, (m,) if isinstance(m, int) else m, words)
    shown = _columns(min(words, 2))
    size = F.col("size") if ratio else F.lit(0)
    most = tau if bound is None else bound

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c.to_numpy() for c in batch.columns[2:]]
            for i, (part, t) in enumerate(probes):
                value = part_values(x, part)
                for k, bits in enumerate(itertools.combinations(range(len(part)), t)):
                    mask = ~np.array(sum(1 << b for b in bits), np.uint64).view(np.int64)
                    code = np.full(len(value), i << 20 | k, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(value & mask), *batch.columns[: 2 + len(shown)]], names=["probe", "value", "rep", "size", *shown])

    schema = "probe long, value long, rep long, size long, " + ", ".join(f"{c} long" for c in shown)
    rows = prints.select("rep", size.cast("long").alias("size"), *_columns(words)).mapInArrow(keys, schema)
    rows = blocked(scratch, rows, ["probe", "value"], "rep", block)
    group = ["probe", "value", "_bi", "_bj"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cols in sorted_groups(batches, group, ["rep", "size", "_b", *shown]):
            prints = np.stack([cols[c].view(np.uint64) for c in shown])
            left, right = _close(prints, cols["_b"] if key["_bi"] != key["_bj"] else None, most, cols["size"] if ratio else None, ratio)
            if len(left):
                a, b = forest(left, right, cols["rep"])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return scratch.cut(dealt.select(*group, "rep", "size", *shown, "_b").mapInArrow(verify, "a long, b long"), "found")


def _close(x: np.ndarray, side: np.ndarray | None, most: int, size: np.ndarray | None = None, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that differ in at most ``most`` bits; x has a row for each word."""
    n, order = x.shape[1], None
    if size is not None:
        order = np.argsort(size, kind="stable")
        x, size, side = x[:, order], size[order], None if side is None else side[order]
    left, right = [], []
    for start in range(0, n, 512):
        stop = min(start + 512, n)
        end = n if size is None else int(np.searchsorted(size, size[stop - 1] / ratio + 1e-9, side="right"))
        bits = np.bitwise_count(x[0, start:stop, None] ^ x[0, None, start:end])
        for word in x[1:]:
            bits += np.bitwise_count(word[start:stop, None] ^ word[None, start:end])
        i, j = np.nonzero(bits <= most)
        i, j = i + start, j + start
        ok = i < j
        if side is not None:
            ok &= side[i] != side[j]
        if size is not None:
            ok &= size[i] >= ratio * size[j] - 1e-9
        left.append(i[ok])
        right.append(j[ok])
    a, b = np.concatenate(left), np.concatenate(right)
    return (a, b) if order is None else (order[a], order[b])


# --- by similarity of sets -----------------------------------------------------


def shape(n: int, threshold: float) -> tuple[int, int, int]:
    """(words, parts, most differing bits of 128) for n texts and a Jaccard similarity.

    Bits of two sets differ with a chance of angle / pi.  Parts have as many
    bits as leave some 256 texts to a value; there are as many parts as it
    takes to agree in one.
    """
    differ = math.acos(2 * threshold / (1 + threshold)) / math.pi
    bits = min(16, max(6, math.ceil(math.log2(max(n, 1) / 256))))
    parts = math.ceil(math.log(MISS) / math.log(1 - (1 - differ) ** bits)) if differ else 1
    words = max(2, -(-parts * bits // 64))
    parts = 64 * words // bits
    return words, parts, math.ceil(128 * differ + 4.5 * math.sqrt(128 * differ * (1 - differ)))


def who(df: DataFrame, id_col: str) -> Column:
    """What tells rows apart: the id, rows without one last, and a hash of all columns."""
    columns = (F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema)
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("key"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, block: int = 2048) -> DataFrame:
    """(id, node, component_id) for every row: texts linked by the Jaccard similarity of their shingle sets.

    ``node`` numbers the row's set (by a 64-bit hash); component_id is the
    smallest id reachable by links of ``threshold`` or more, null in a group
    without any id.  A pair at the threshold is missed with a chance of MISS, a
    closer one with less.
    """
    scratch = Scratch(df.sparkSession, "similar")
    out = _similar(scratch, df.select(id_col, text_col), id_col, text_col, shingle, threshold, block)
    return out.select(F.col("who.id").alias(id_col), "node", F.col("least.id").alias("component_id"))


def _similar(scratch: Scratch, df: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, block: int = 2048) -> DataFrame:
    """(who, node, root, least) for every row: itself, its set, and its component's number and least row."""
    small_batches(df.sparkSession)
    n_rows = df.count()
    words, parts, bound = shape(n_rows, threshold)
    names = _columns(words)
    src = df.select(who(df, id_col).alias("who"), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema[0], T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), *(T.StructField(c, T.LongType()) for c in names)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x, shingle) for x in batch.column(1).to_pylist()]
            prints = np.array([set_fingerprint(x, words) for x in found], np.uint64).reshape(-1, words).view(np.int64)
            numbers = [pa.array([node_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *numbers, *(pa.array(prints[:, k]) for k in range(words))], names=schema.names)

    docs = scratch.cut(src.mapInArrow(sketch, schema), "sketches")
    first = [F.first(c).alias(c) for c in ("size", *names)]
    nodes = scratch.cut(docs.groupBy("node").agg(F.min("who").alias("who"), F.count(F.lit(1)).alias("n"), *first), "nodes")
    candidates = linked(scratch, nodes.where("size > 0").withColumnRenamed("node", "rep"), parts - 1, parts, block, words, bound, threshold)
    families = components(scratch, candidates).withColumnRenamed("root", "family")
    # One row stands for each wanted set; the texts are streamed past these rows, dealt by who they are and not sorted.
    wanted = scratch.cut(families.join(nodes.select("node", "who"), "node"), "wanted")
    texts = src.join(wanted.hint("shuffle_hash"), "who").select("family", "node", "__text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x, shingle).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["family", "node", "found"])

    members = texts.mapInArrow(sets, "family long, node long, found binary").groupBy("family", "node").agg(F.first("found").alias("found"))
    rows = blocked(scratch, scratch.cut(members, "sets"), ["family"], "node", 512)
    group = ["family", "_bi", "_bj"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, some in itertools.groupby((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(6)))), key=lambda r: r[:3]):
            some = list(some)
            found = [np.frombuffer(r[5], np.uint64) for r in some]
            a, b = set_links(found, threshold, np.array([r[3] for r in some]) if key[1] != key[2] else None)
            number = np.array([r[4] for r in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number[a]), pa.array(number[b])], names=["a", "b"])

    dealt = rows.select(*group, "_b", "node", "found").repartition(*group).sortWithinPartitions(*group)
    true = components(scratch, scratch.cut(dealt.mapInArrow(verify, "a long, b long"), "links"))
    rooted = scratch.cut(nodes.select("node", "who", "n").join(true, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("who").alias("least"), F.count(F.lit(1)).alias("m"))
    mapping = lookup(rooted.drop("who"), "root", scratch.cut(least, "least"), rooted.count(), "m").select("node", "n", "root", "least")
    return lookup(docs.select("who", "node"), "node", scratch.cut(mapping, "mapping"), n_rows).select("who", "node", "root", "least")


def set_links(found: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of ``threshold`` or more that connect all that are so connected; with sides, pairs across only."""
    n, left, right = len(found), [], []
    size = np.array([len(x) for x in found])
    part = np.arange(n)
    for i in range(n):
        fits = np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) - 1e-9
        fits &= np.arange(n) > i
        if side is not None:
            fits &= side != side[i]
        todo, step = np.flatnonzero(fits), 1
        # Growing steps: a text that links to the first of a large part is not compared with the rest.
        while len(todo := todo[part[todo] != part[i]]):
            now, todo, step = todo[:step], todo[step:], step * 2
            flat = np.concatenate([found[j] for j in now])
            at = np.minimum(np.searchsorted(found[i], flat), size[i] - 1)
            both = np.add.reduceat((found[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[now])[:-1]]))
            for j in now[both >= threshold * (size[i] + size[now] - both) - 1e-9].tolist():
                left.append(i)
                right.append(j)
                part[part == part[j]] = part[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """df with one row of each group of ``similar``: that of the smallest id, whatever else the id's other rows are.

    Rows are told apart by their id and a hash of all their columns; of rows
    equal in both one stays.  A group without any id keeps one row as well.
    """
    scratch = Scratch(df.sparkSession, "keep-one")
    found = scratch.cut(_similar(scratch, df, id_col, text_col, shingle, threshold), "found")
    n_rows = found.count()
    marked = found.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("who") == F.col("least")).alias("first")).where("n > 1 or not first")
    marked = scratch.cut(marked, "marked")
    hot = (F.col("n") * HOT_SHARE >= F.lit(n_rows)) & (F.col("n") > 64)
    keyed = df.withColumn("__who", who(df, id_col))
    names = marked.select(F.col("who").alias("__who"), hot.alias("hot"), "first")
    # Dealt by who they are, which is even: rows that many are equal to leave before.
    out = keyed.join(F.broadcast(names.where("hot").select("__who")), "__who", "left_anti").join(names.where("not hot").select("__who").hint("shuffle_hash"), "__who", "left_anti")
    twins = names.where("first")
    if not twins.isEmpty():
        again = keyed.join(F.broadcast(twins.where("hot").select("__who")), "__who", "left_semi").unionByName(keyed.join(twins.where("not hot").select("__who").hint("shuffle_hash"), "__who", "left_semi"))
        rest = [F.first(c).alias(c) for c in df.columns]
        out = out.unionByName(again.groupBy("__who").agg(*rest))
    return out.select(*df.columns)
