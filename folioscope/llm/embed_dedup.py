"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction made of one random unit codeword per block of the
(rotated) vector; a vector belongs to all filters whose product with it is at
least alpha.  They are list-decoded: the codewords' products are sorted in each
block, and only combinations that can still reach alpha are expanded.  Vectors
meet in the filters that they share and are verified by exact cosine in double
precision.  A vector that reaches no filter takes its best ones, so every
vector is indexed.

Equal vectors of a label are merged first and counted, so a group of copies
costs one vector, however large.  The number of filters follows the number of
distinct vectors in the largest label, without bound, so filters keep about as
many vectors each.  How many filters a vector reaches is chosen so that pairs
just at the threshold share none with a chance of MISS at most (simulated for
the dimension and the number of filters); closer pairs are missed less.  A
filter that holds a large group of near copies is cut into blocks, and no pair
is written: a block gives each of its vectors a count of links and one link of
a spanning forest.  A pair that meets in several filters is counted in the
first that both have.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label, link with nothing and stay as rows of
their own component; vectors of different length never link; repeated rows and
ids link like others with equal vectors, n_links counts rows; a row without id
links like any other, its component is the smallest id in it (null if there is
none) and it is not kept; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocked, components, forest, lookup, small_batches, sorted_groups

#: Share of the pairs just at the threshold that may share no filter.
MISS = 0.01
#: Vectors of one label that a filter holds on average.
VECTORS_PER_FILTER = 96
#: Numbers of filters that a vector may reach on average.
FILTERS = (12, 16, 24, 32, 44, 60, 80, 110, 150, 200, 280)
#: Dimensions that are planned for, the most frequent; others take the plan of the first.
DIMENSIONS = 16


class ProductCode:
    """Random directions of dimension ``dim``: ``words`` codewords in each of two blocks after a random rotation."""

    def __init__(self, dim: int, words: int, mean: float, seed: int = 11):
        rng = np.random.default_rng(seed + dim)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        cut = (dim + 1) // 2
        self.blocks = [(0, cut), (cut, dim)] if dim > 1 else [(0, 1)]
        self.words = words
        codes = [rng.normal(size=(words, b - a)) for a, b in self.blocks]
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(self.blocks)) for c in codes]
        self.size = words ** len(self.blocks)
        # alpha: the threshold that random directions exceed in ``mean`` filters of all on average.
        probe = rng.normal(size=(128, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        sums = [-np.sort(-x, axis=1) for x in self._products(probe)]
        low, high = -1.0, 1.0
        for _ in range(30):
            self.alpha = (low + high) / 2
            if len(sums) == 1:
                reached = (sums[0] >= self.alpha).sum()
            else:
                reached = sum(int(np.searchsorted(-y, x - self.alpha, side="right").sum()) for x, y in zip(*sums))
            low, high = (self.alpha, high) if reached > mean * len(probe) else (low, self.alpha)

    def missed(self, threshold: float, pairs: int = 400) -> float:
        """Share of random pairs at the threshold that share no filter."""
        rng = np.random.default_rng(5)
        x, z = rng.normal(size=(2, pairs, self.rotation.shape[0]))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (x * z).sum(axis=1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z
        return float(np.mean([not len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(self.decode(x), self.decode(y))]))

    def _products(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.rotation
        return [y[:, a:b] @ c.T for (a, b), c in zip(self.blocks, self.codes)]

    @staticmethod
    def shape(dim: int, n: int, threshold: float) -> tuple[int, int]:
        """(words, filters a vector reaches) for n vectors of a label, with at most MISS of the pairs at the threshold missed."""
        for mean in FILTERS:
            words = max(16, int(np.ceil(np.sqrt(n * mean / VECTORS_PER_FILTER))))
            if dim < 3 or ProductCode(dim, words, mean).missed(threshold) <= MISS:
                break
        return words, mean

    def decode(self, x: np.ndarray, least: int = 4) -> list[np.ndarray]:
        """The filters of each unit vector, ascending: all that reach alpha, at least its ``least`` best."""
        products = self._products(x)
        if len(products) == 1:
            return [np.flatnonzero(p >= min(self.alpha, np.sort(p)[-min(least, len(p))])).astype(np.int64) for p in products[0]]
        order = [np.argsort(-p, axis=1) for p in products]
        ranked = [np.take_along_axis(p, o, axis=1) for p, o in zip(products, order)]
        out = []
        for first, second, o1, o2 in zip(ranked[0], ranked[1], order[0], order[1]):
            limit = self.alpha
            # For each first word, the second words down to the limit are a prefix of the ranked list.
            reach = np.searchsorted(-second, first - limit, side="right")
            if reach.sum() < least:
                top = min(len(first), least)
                limit = np.sort((first[:top, None] + second[None, :top]).ravel())[-min(least, top * top)] - 1e-12
                reach = np.searchsorted(-second, first - limit, side="right")
            found = [o1[k] * self.words + o2[:r] for k, r in enumerate(reach.tolist()) if r]
            out.append(np.sort(np.concatenate(found)).astype(np.int64))
        return out


def unit_rows(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors, and these scaled to length one in double precision."""
    at, rows = [], []
    for k, v in enumerate(vectors):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        x = np.array(v, np.float64)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top == 0:
            continue
        x /= top
        at.append(k)
        rows.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), rows


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 512) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; links join rows of equal label at ``threshold`` or more."""
    small_batches(df.sparkSession, 5000)
    scratch = Scratch(df.sparkSession, "embed")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    schema = T.StructType([rows.schema["id"], T.StructField("label", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("vector", T.BinaryType())])

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            # Vectors travel in the precision that they came in, and are scaled again where they are compared.
            kind = "<f4" if pa.types.is_float32(batch.column(2).type.value_type) else "<f8"
            at, units = unit_rows(vectors)
            found: list[bytes | None] = [None] * len(vectors)
            size = [0] * len(vectors)
            for k, u in zip(at.tolist(), units):
                found[k], size[k] = np.array(vectors[k], kind).tobytes(), len(u)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(found, pa.binary())], names=schema.names)

    key = ["label", "dim", "h1", "h2"]
    hashed = F.when(F.col("vector").isNotNull() & F.col("label").isNotNull(), F.xxhash64("vector"))
    read = rows.mapInArrow(tidy, schema).withColumns({"h1": hashed, "h2": F.when(hashed.isNotNull(), F.xxhash64(F.lit(1), "vector"))})
    groups = read.where("h1 is not null").groupBy(*key).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    # Written with its number, which is then fixed.
    groups = scratch.cut(groups.withColumn("node", F.monotonically_increasing_id()), "distinct")
    sizes = groups.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("largest"), F.sum("count").alias("n")).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()
    shapes = {r["dim"]: ProductCode.shape(r["dim"], r["largest"], threshold) for r in sizes}
    usual = next(iter(shapes.values()), (16, FILTERS[0]))
    numbers = scratch.cut(groups.select("label").distinct().withColumn("number", F.monotonically_increasing_id()), "labels")
    label_counts = scratch.cut(groups.groupBy("label").agg(F.count(F.lit(1)).alias("m")).join(numbers, "label"), "label-counts")
    numbered = lookup(groups.select("node", "n", "label", "dim", "vector"), "label", label_counts, groups.count(), "m").select("node", "n", "number", "dim", "vector")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            filters: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            vectors, dims = batch.column(4).to_pylist(), batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim).tolist()
                code = codes[dim] = codes.get(dim) or ProductCode(dim, *shapes.get(dim, usual))
                kind = "<f4" if len(vectors[some[0]]) == 4 * dim else "<f8"
                for k, f in zip(some, code.decode(_scaled(np.stack([np.frombuffer(vectors[k], kind) for k in some])))):
                    filters[k] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

    indexed = scratch.cut(numbered.mapInArrow(index, "node long, n long, number long, dim int, vector binary, filters array<long>"), "indexed")
    spread = indexed.select("*", F.explode("filters").alias("filter"))
    spread = blocked(scratch, spread, ["number", "dim", "filter"], "node", block)
    group = ["number", "dim", "filter", "_bi", "_bj"]
    dealt = spread.repartition(*group).sortWithinPartitions(*group)
    packed = dealt.select(*group, "_b", "node", "n", "vector", "filters")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, found in _groups(batches, group):
            nodes, n, unit, side, filters = found
            counts, left, right = _links(unit, n, filters, int(at["filter"]), side if at["_bi"] != at["_bj"] else None, threshold)
            hit = np.flatnonzero(counts)
            if len(left):
                yield _out(np.zeros(len(hit), np.int32), nodes[hit], counts[hit])
                a, b = forest(left, right, nodes)
                yield _out(np.ones(len(a), np.int32), a, b)

    found = scratch.cut(packed.mapInArrow(verify, "kind int, a long, b long"), "found")
    degrees = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("other"))
    parts = components(scratch, found.where("kind = 1").select("a", "b"))
    rooted = groups.select(*key, "node", "least", "n").join(parts, "node", "left").join(degrees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = scratch.cut(rooted.withColumn("n_links", F.col("n") - 1 + F.coalesce("other", F.lit(0))), "rooted")
    least = scratch.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")), "least")
    mapping = scratch.cut(lookup(rooted.drop("least"), "root", least, rooted.count(), "m").select(*key, "n", "n_links", "component_id"), "mapping")
    slim = scratch.cut(read.select("id", *key), "rows")
    linked = lookup(slim.where("h1 is not null"), key, mapping, slim.count()).select("id", "n_links", "component_id")
    out = linked.unionByName(slim.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept)


def _out(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, tuple]]:
    """Groups with their vectors as a matrix; vectors and filter lists travel as positions in a side list."""
    held: list[tuple[bytes, np.ndarray]] = []
    base = 0

    def tagged() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            start = base + len(held)
            lists = batch.column(names.index("filters"))
            flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
            held.extend(zip(batch.column(names.index("vector")).to_pylist(), (flat[a:b] for a, b in zip(cuts, cuts[1:]))))
            columns = [batch.column(names.index(c)) for c in (*keys, "_b", "node", "n")]
            tags = np.arange(start, start + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tags)], names=[*keys, "_b", "node", "n", "tag"])

    for key, cols in sorted_groups(tagged(), keys, ["_b", "node", "n", "tag"]):
        tags = (cols["tag"] - base).tolist()
        kind = "<f4" if len(held[tags[0]][0]) == 4 * key["dim"] else "<f8"
        unit = _scaled(np.frombuffer(b"".join([held[t][0] for t in tags]), kind).reshape(len(tags), -1))
        yield key, (cols["node"], cols["n"], unit, cols["_b"], [held[t][1] for t in tags])
        if tags[-1] > 4096:
            del held[: tags[-1] + 1]
            base += tags[-1] + 1


def _links(unit: np.ndarray, n: np.ndarray, filters: list[np.ndarray], here: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows linked to each vector (a vector stands for ``n``) that are to be counted in this filter, and all links found, as positions."""
    close = unit @ unit.T >= threshold
    if side is not None:
        close &= side[:, None] != side[None, :]
    left, right = np.nonzero(np.triu(close, 1))
    if not len(left):
        return np.zeros(len(unit), np.int64), left, right
    # Pairs that share an earlier filter are counted there: a bit for each of these filters.
    linked = np.unique(np.concatenate([left, right]))
    earlier = [filters[k][: np.searchsorted(filters[k], here)] for k in linked.tolist()]
    known, column = np.unique(np.concatenate(earlier), return_inverse=True)
    bits = np.zeros((len(unit), -(-max(len(known), 1) // 64) * 64), bool)
    bits[np.repeat(linked, [len(x) for x in earlier]), column] = True
    words = np.packbits(bits, axis=1).view(np.uint64)
    counts = np.zeros(len(unit))
    for start in range(0, len(left), 8192):
        a, b = left[start : start + 8192], right[start : start + 8192]
        first = ~(words[a] & words[b]).any(axis=1)
        a, b = a[first], b[first]
        counts += np.bincount(a, n[b], len(unit)) + np.bincount(b, n[a], len(unit))
    return counts.astype(np.int64), left, right
