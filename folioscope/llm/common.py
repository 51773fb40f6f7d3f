"""What the operators share: scratch tables, skew-safe look-ups, blocked groups, components.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, the only
folder that the driver and all executors share on a cluster.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot from one part in so many of all rows on, so there are at most so many hot keys.
HOT_SHARE = 1000
#: A small table is broadcast up to this many rows; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 5000

_OWN_DIR: list[str] = []
#: Folders of scratch tables made in this session.
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a full URI; a temporary one only where none is set and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        # A path without a scheme lies in Spark's default file system, which readers outside the JVM don't know.
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="folioscope-"))
    return f"file://{_OWN_DIR[0]}"


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor costs only the step at hand."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append(self.root)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns what reads it again."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(_nullable(df.schema)).parquet(path)

    def delete(self) -> None:
        """Deletes what was written."""
        _delete(self.spark, self.root)
        _ROOTS.remove(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside, once what was computed from them is written elsewhere."""
    start = len(_ROOTS)
    try:
        yield
    finally:
        for root in _ROOTS[start:]:
            _delete(spark, root)
        del _ROOTS[start:]


def purge(spark: SparkSession) -> None:
    """Deletes all scratch tables of the session; results that were not written yet are lost with them."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def crc32_of_id(id_col: str) -> Column:
    """Unsigned crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def bounded_sample(df: DataFrame, klass: str, id_col: str, rows_per_class: int, max_classes: int = 256) -> DataFrame:
    """About ``rows_per_class`` rows of each class (all of a smaller class), the same at each run.

    The bound is what a classifier is fitted on: at most ``max_classes`` classes
    (the most frequent), and 1.5 * rows_per_class + 50 rows of each, so what
    reaches the driver does not grow with the corpus.  A row is taken by the
    hash of its id, against a threshold set from the class counts over all rows.
    """
    counts = df.groupBy(klass).count().orderBy(F.desc("count"), klass).limit(max_classes).collect()
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {row[0]: min(1.0, 1.2 * rows_per_class / row[1]) for row in counts}
    if not share:
        return df.limit(0)
    keep = F.lit(False)
    for value, part in share.items():
        keep = keep | ((F.col(klass) == F.lit(value)) & (unit < part))
    return df.where(keep).limit(int(1.5 * rows_per_class + 50) * len(share))


def lookup(rows: DataFrame, key: str | list[str], mapping: DataFrame, n_rows: int, count_col: str = "n") -> DataFrame:
    """``rows`` inner joined with ``mapping`` (one row per key), safe when one key holds most rows.

    ``mapping`` has in ``count_col`` how many of ``rows`` have the key.  Keys
    with a thousandth of all rows or more are at most ``HOT_SHARE`` and are
    broadcast; the others meet by a shuffle, where none can be large.
    """
    hot = (F.col(count_col) * HOT_SHARE >= F.lit(n_rows)) & (F.col(count_col) > 64)
    warm = F.broadcast(mapping.where(hot))
    by_hot = rows.join(warm, key)
    rest = rows.join(warm.select(key), key, "left_anti").join(mapping.where(~hot), key)
    return by_hot.unionByName(rest)


def blocked(scratch: Scratch, rows: DataFrame, keys: list[str], id_col: str, limit: int) -> DataFrame:
    """Cuts the groups of ``keys`` into blocks, so that no task gets a group of unbounded size.

    Adds ``_b`` (a row's own block), ``_bi`` and ``_bj``.  Rows of equal keys,
    ``_bi`` and ``_bj`` are at most about 2 * limit; each pair of rows of a key
    meets in exactly one of these: pairs of one block where ``_bi = _bj``, all
    others where their two blocks are ``_bi`` and ``_bj``.  No row is dropped.
    """
    sizes = scratch.cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit), "sizes")
    if sizes.isEmpty():
        zero = F.lit(0)
        return rows.withColumns({"_b": zero, "_bi": zero, "_bj": zero})
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    blocks = F.ceil(F.coalesce(F.col("_size"), F.lit(1)) / F.lit(limit)).cast("int")
    out = rows.join(sizes, keys, "left").withColumn("_g", blocks)
    out = out.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col("_g").cast("long")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.withColumns({"_bi": F.least("_b", "_o"), "_bj": F.greatest("_b", "_o")}).drop("_size", "_g", "_o")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[dict, dict]]:
    """Groups of equal integer keys in Arrow batches that are sorted by them: (keys, columns as arrays)."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: _array(batch.column(batch.schema.get_field_index(c))) for c in dict.fromkeys([*keys, *columns])}
        if held is not None:
            now = {c: np.concatenate([held[c], x]) for c, x in now.items()}
        n = len(now[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                yield {k: now[k][a] for k in keys}, {c: now[c][a:b] for c in columns}
        held = {c: x[starts[-1] :] for c, x in now.items()}
    if held is not None and len(held[keys[0]]) > 1:
        yield {k: held[k][0] for k in keys}, {c: held[c] for c in columns}


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are; equally long binaries as rows of bytes."""
    if pa.types.is_binary(column.type):
        return np.array([np.frombuffer(x, np.uint8) for x in column.to_pylist()])
    return column.to_numpy(zero_copy_only=False)


def forest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between positions left[k] and right[k]: one link from each node to its part's smallest id.

    As many links as nodes at most, with the same connected parts.
    """
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    label = ids[nodes].copy()
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if np.array_equal(before, label):
            break
    other = label != ids[nodes]
    return ids[nodes][other], label[other]


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected parts of links (a, b): (node, root), root the smallest node, for each node with a link.

    Each round hooks every node with a smaller neighbour to its smallest one,
    jumps pointers until all point to roots, and contracts the links; rounds go
    as the logarithm of the longest chain.  Every step is written to the shared
    folder; only emptiness reaches the driver.
    """
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = first = scratch.cut(tidy(links), "links")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        hook = scratch.cut(edges.groupBy("hi").agg(F.min("lo").alias("p")), "hooks")
        while True:
            up = hook.select(F.col("hi").alias("p"), F.col("p").alias("pp"))
            jumped = hook.join(up, "p", "left").select("hi", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
            hook = scratch.cut(jumped, "jumps")
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.select("hi", "p")
        hooks.append(hook)
        as_lo = hook.select(F.col("hi").alias("lo"), F.col("p").alias("q"))
        moved = edges.join(hook, "hi").join(as_lo, "lo", "left").select(F.col("p").alias("a"), F.coalesce("q", "lo").alias("b"))
        edges = scratch.cut(tidy(moved), "contracted")
    nodes = first.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node"))
    for hook in hooks:
        up = hook.select(F.col("hi").alias("root"), F.col("p").alias("up"))
        nodes = nodes.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return scratch.cut(nodes, "parts") if hooks else nodes


def with_columns(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema, without columns of the fields' names, and the fields after it."""
    names = {n for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + [T.StructField(n, t, True) for n, t in fields])


def portions(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about so many characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Keeps the session's Arrow batches small, by rows and bytes, so that a worker's memory is bounded by one long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get(_BATCH_BYTES, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_BYTES, f"{size}b")


_BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
