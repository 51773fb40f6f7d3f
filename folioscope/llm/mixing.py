"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are counted by (source, language, topic).  The cells' weights are raked
in turn to the target shares of each of the three marginals until all hold.
Probabilities are the weights, scaled so that the expected tokens meet the
budget; where that takes one over 1, they are raked on under that bound, so the
expected sample has the marginals and not only the weights.  A value whose
target is more than all its tokens at this budget gives all, and the others
share the rest by their targets; ``marginals`` reports the target, what of it
the corpus can fill, and what the sample is expected to hold.  Documents are
then taken by a hash of their id, so the same ones are taken at each run and in
each task that is run again.

A document's topic is the bucket of terms (words of five letters or more,
hashed to TOPICS buckets) that it holds most over the corpus's share, counted
over all documents; or any column given.  A source or language that is null is
its own value; every source and language has cells of its own.  Up to
``DRIVER_CELLS`` cells are raked on the driver; more are raked as tables, one
dimension after the other, and meet their documents by a shuffle.

Edge cases: null and empty texts have no tokens, no topic, and are taken like
others of their cell; repeated rows are taken or left together; an empty table
gives an empty table; other columns are ignored.  Targets for values that hold
no token are spread over the values that do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Scratch, lookup, portions, small_batches

DIMENSIONS = ("source", "lang", "topic")
#: Up to so many cells are raked on the driver.
DRIVER_CELLS = 100_000
NONE = "(none)"
#: Default targets: the observed share of a value to this power, normed to one.
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Share of all tokens that the sample is to hold.
BUDGET = 0.8
SEED = 17
#: Buckets of terms, and the letters that a word has at least to be one.
TOPICS, TERM_LETTERS = 32, 5


def _bucket(word: str) -> int:
    """The word's bucket of terms; the one past the last for short words."""
    return zlib.crc32(word.lower().encode()) % TOPICS if len(word) >= TERM_LETTERS else TOPICS


def measure(docs: DataFrame, text_col: str = "text", shares: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """docs without the text (or whole), with ``_tokens`` (words between white space) and ``_terms`` (counts of the buckets of terms).

    Where the shares of the buckets are known, with ``_topic`` instead of ``_terms``.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]
    src = docs.select(*kept, text_col)
    last = T.StructField("_terms", T.BinaryType()) if shares is None else T.StructField("_topic", T.StringType())
    n = len(kept) + whole
    schema = T.StructType([*src.schema.fields[:n], T.StructField("_tokens", T.LongType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            tokens, terms = [], []
            for some in portions(batch.column(len(kept)).to_pylist()):
                words = [(x or "").split() for x in some]
                if len(known) > 200_000:
                    known.clear()
                known.update((w, _bucket(w)) for w in set().union(*words).difference(known))
                for w in words:
                    at = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                    terms.append(np.bincount(at, minlength=TOPICS)[:TOPICS])
                    tokens.append(len(w))
            found = [x.astype("<u4").tobytes() for x in terms] if shares is None else topics_of(np.array(terms).reshape(-1, TOPICS), shares)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(tokens, pa.int64()), pa.array(found, pa.binary() if shares is None else pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def term_shares(measured: DataFrame) -> np.ndarray:
    """Share of each bucket in the terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOPICS, np.int64)
        for batch in batches:
            total += np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, TOPICS).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TOPICS, dtype=np.int32)), pa.array(total)], names=["at", "n"])

    found = np.zeros(TOPICS)
    for r in measured.select("_terms").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        found[r[0]] = r[1]
    return found / max(found.sum(), 1)


def topics_of(terms: np.ndarray, shares: np.ndarray) -> list[str]:
    """For each row of counts the bucket that is most over its expected count, in its standard deviations; the first of equal ones."""
    n = terms.sum(axis=1, keepdims=True)
    expected = n * shares
    over = (terms - expected) / np.sqrt(np.maximum(expected, 1e-9))
    return [f"t{k:02d}" if m else NONE for k, m in zip(np.argmax(over, axis=1).tolist(), n[:, 0].tolist())]


def with_topic(measured: DataFrame, shares: np.ndarray) -> DataFrame:
    """measured with ``_topic`` for its ``_terms``."""
    kept = [c for c in measured.columns if c != "_terms"]
    src = measured.select(*kept, "_terms")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_topic", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column(len(kept)).to_pylist()), "<u4").reshape(-1, TOPICS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(topics_of(terms, shares), pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def rake(cells: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells so that mass * weight has the target share of each value of each dimension.

    ``cells`` has a column of value numbers for each dimension.
    """
    weight = np.ones(len(mass))
    if not len(mass) or mass.sum() <= 0:
        return weight
    wanted = [attained(share, cells[:, d], mass) for d, share in enumerate(targets)]
    for _ in range(rounds):
        worst = 0.0
        for d, share in enumerate(wanted):
            now = np.bincount(cells[:, d], weights=mass * weight, minlength=len(share))
            now = now / now.sum()
            factor = np.divide(share, now, out=np.ones_like(share), where=now > 0)
            worst = max(worst, float(np.abs(now - share).max()))
            weight = weight * factor[cells[:, d]]
        if worst < tolerance:
            break
    return weight * mass.sum() / (mass * weight).sum()


def calibrate(mass: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * weight) with the scale at which the expected mass is the budget's share."""
    total = mass.sum()
    if total <= 0 or budget >= 1:
        return np.ones(len(mass))
    low, high = 0.0, 1.0
    while (mass * np.minimum(1, high * weight)).sum() < budget * total and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (mass * np.minimum(1, mid * weight)).sum() < budget * total else (low, mid)
    return np.minimum(1.0, high * weight)


def fillable(target: np.ndarray, held: np.ndarray, budget: float) -> np.ndarray:
    """Shares of a sample of ``budget`` of all: the targets, but of no value more than it holds; the rest by the targets."""
    most = held / budget
    full = np.zeros(len(target), bool)
    while True:
        rest = target[~full].sum()
        scale = (1 - most[full].sum()) / rest if rest > 0 else 0.0
        share = np.where(full, most, target * scale)
        over = ~full & (share > most)
        if not over.any():
            return share
        full |= over


def rake_bounded(cells: np.ndarray, mass: np.ndarray, weight: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """Probabilities of at most 1 at which the expected sample has the budget and the targets that it can fill.

    They start at the scaled weights; values short of their share are scaled up
    in turn, cells at 1 stay there and the others make up for it.
    """
    p, total = calibrate(mass, weight, budget), mass.sum()
    if total <= 0 or budget >= 1 or (budget * weight * total / max((mass * weight).sum(), 1e-300) <= 1).all():
        return p
    wanted = [fillable(t, np.bincount(cells[:, d], weights=mass, minlength=len(t)) / total, budget) * budget * total for d, t in enumerate(targets)]
    for _ in range(rounds):
        worst = 0.0
        for d, want in enumerate(wanted):
            now = np.bincount(cells[:, d], weights=mass * p, minlength=len(want))
            worst = max(worst, float(np.abs(now - want).max()) / total)
            p = np.minimum(1.0, p * np.divide(want, now, out=np.ones_like(want), where=now > 0)[cells[:, d]])
        if worst < tolerance:
            break
    return p


def default_targets(values: pd.Series, mass: pd.Series, power: float) -> dict[str, float]:
    share = mass.groupby(values).sum()
    share = (share / max(share.sum(), 1)) ** power
    return (share / max(share.sum(), 1e-12)).to_dict()


def named_cells(df: DataFrame) -> DataFrame:
    """df with ``_source`` and ``_lang``, nulls as a value."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return df.withColumns({"_source": named("source"), "_lang": named("lang")})


def plan(celled: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> tuple[pd.DataFrame | None, DataFrame]:
    """The cells with their weight and probability: on the driver (none if they are too many for it), and as a table."""
    scratch = Scratch(celled.sparkSession, "mix-plan")
    found = celled.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    found = scratch.cut(found, "cells")
    if found.count() > DRIVER_CELLS:
        return None, plan_tables(scratch, found, targets, budget)
    cells = found.toPandas().sort_values(list(DIMENSIONS), ignore_index=True)
    numbers, wanted = [], []
    for d in DIMENSIONS:
        values, at = np.unique(cells[d].to_numpy(str), return_inverse=True)
        goal = (targets or {}).get(d) or default_targets(cells[d], cells.tokens, TEMPERATURE[d])
        numbers.append(at)
        wanted.append(np.array([goal.get(v, 0.0) for v in values]))
    mass, at = cells.tokens.to_numpy(float), np.stack(numbers, axis=1) if len(cells) else np.zeros((0, 3), int)
    wanted = [attained(w, at[:, d], mass) for d, w in enumerate(wanted)]
    cells["weight"] = rake(at, mass, wanted)
    cells["probability"] = rake_bounded(at, mass, cells.weight.to_numpy(), wanted, budget)
    rows = [(*map(str, r[:3]), *map(int, r[3:5]), *map(float, r[5:])) for r in cells[[*DIMENSIONS, "docs", "tokens", "weight", "probability"]].itertuples(index=False)]
    return cells, celled.sparkSession.createDataFrame(rows, CELLS)


CELLS = "source string, lang string, topic string, docs long, tokens long, weight double, probability double"


def attained(share: np.ndarray, at: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The targets, of values that hold tokens only, normed to one."""
    held = np.bincount(at, weights=mass, minlength=len(share)) > 0
    share = np.where(held, share, 0.0)
    return share / share.sum() if share.sum() > 0 else held / max(held.sum(), 1)


def plan_tables(scratch: Scratch, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """What ``rake`` and ``rake_bounded`` give, for cells of any number; only sums reach the driver."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).head()[0] or 0)
    if total <= 0:
        return cells.select(*DIMENSIONS, "docs", "tokens", F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"))
    wanted = {}
    for d in DIMENSIONS:
        values = cells.groupBy(d).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        if goal := (targets or {}).get(d):
            named = spark.createDataFrame([(str(k), float(v)) for k, v in goal.items()], f"{d} string, goal double")
            values = values.join(named, d, "left").withColumn("goal", F.when(F.col("t") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(0.0))
        else:
            values = values.withColumn("goal", F.pow(F.col("t") / total, F.lit(TEMPERATURE[d])))
        values = scratch.cut(values, d)
        n, goals, held = values.agg(F.count(F.lit(1)), F.sum("goal"), F.sum((F.col("t") > 0).cast("int"))).head()
        share = F.col("goal") / goals if goals > 0 else (F.col("t") > 0).cast("double") / held
        wanted[d] = values.select(d, "n", "t", share.alias("share")), n
    n_cells = cells.count()
    start = scratch.cut(cells.withColumn("weight", F.lit(1.0)), "weights")
    now = _rake_tables(start, "weight", {d: (v, n) for d, (v, n) in wanted.items()}, total, n_cells, False, rounds, tolerance)
    mass = now.agg(F.sum(F.col("tokens") * F.col("weight"))).head()[0]
    now = now.withColumn("weight", F.col("weight") * total / mass)
    if budget >= 1:
        return scratch.cut(now.select(*DIMENSIONS, "docs", "tokens", "weight", F.lit(1.0).alias("probability")), "planned")
    # Cells at probability 1 stay there as the scale grows, so the scale is exact once no further cell gets there.
    scale, capped = 0.0, -1
    while True:
        full = F.col("weight") * scale >= 1
        n, sure, rest = now.agg(F.sum(full.cast("int")), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).head()
        if n == capped:
            break
        capped = n
        if rest <= 0:
            scale = max(scale, 1e12)
            break
        scale = max(scale, min(1e12, (budget * total - sure) / rest))
    planned = scratch.cut(now.select(*DIMENSIONS, "docs", "tokens", "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("probability")), "planned")
    if not capped:
        return planned
    fitting = {}
    for d, (values, n) in wanted.items():
        most, level, full = F.col("t") / (budget * total), 0.0, -1
        while True:
            over = F.col("share") * level >= most
            count, sure, rest = values.agg(F.sum(over.cast("int")), F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("share")))).head()
            if count == full or rest <= 0:
                break
            full, level = count, max(level, (1 - sure) / rest)
        fitting[d] = scratch.cut(values.withColumn("share", F.when(F.col("share") * level >= most, most).otherwise(F.col("share") * level)), f"{d}-fillable"), n
    return scratch.cut(_rake_tables(planned, "probability", fitting, budget * total, n_cells, True, rounds, 1000 * tolerance), "raked")


def _rake_tables(now: DataFrame, column: str, wanted: dict[str, tuple[DataFrame, int]], total: float, n_cells: int, bounded: bool, rounds: int, tolerance: float) -> DataFrame:
    """now with the column raked to the shares (of ``total`` if bounded by 1, else of their own sum)."""
    names, before = now.columns, None
    # A weight is the product of a factor for each dimension, so a step writes the cells anew; the one before goes.
    for _ in range(rounds):
        worst = 0.0
        for d, (share, n) in wanted.items():
            step = Scratch(now.sparkSession, "mix-step")
            sums = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col(column)).alias("m"))
            sums = step.cut(share.join(sums, d), "sums")
            mass = total if bounded else sums.agg(F.sum("m")).head()[0]
            worst = max(worst, sums.agg(F.max(F.abs(F.col("m") / mass - F.col("share")))).head()[0])
            factors = sums.select(d, "n", F.when(F.col("m") > 0, F.col("share") * mass / F.col("m")).otherwise(1.0).alias("factor"))
            met = now.join(F.broadcast(factors.drop("n")), d) if n <= BROADCAST_ROWS else lookup(now, d, factors, n_cells).drop("n")
            value = F.col(column) * F.col("factor")
            met = met.withColumn(column, F.least(F.lit(1.0), value) if bounded else value)
            now = step.cut(met.select(*names), "weights")
            if before is not None:
                before.delete()
            before = step
        if worst < tolerance:
            break
    return now


def marginals(table: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dimension, value, tokens, target, expected) of a plan: target share, and the share of the expected sample.

    Without given targets the default ones; values without tokens are left out.
    """
    spark, parts = table.sparkSession, []
    total, kept = table.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).head()
    for d in DIMENSIONS:
        found = table.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("tokens") * F.col("probability")) / F.lit(float(kept or 1))).alias("expected")).where("tokens > 0")
        if goal := (targets or {}).get(d):
            found = found.join(spark.createDataFrame([(str(k), float(v)) for k, v in goal.items()], "value string, goal double"), "value", "left").fillna(0.0, ["goal"])
        else:
            found = found.withColumn("goal", F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(TEMPERATURE[d])))
        goals = found.agg(F.sum("goal")).head()[0] or 1.0
        parts.append(found.select(F.lit(d).alias("dimension"), "value", "tokens", (F.col("goal") / goals).alias("target"), "expected"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chance(id_col: str, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) from the id."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def sample(celled: DataFrame, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """celled with ``weight``, ``probability`` and ``kept``; a small table of cells is broadcast, a large one shuffled."""
    clash = [c for c in ("weight", "probability", "kept") if c in celled.columns]
    table, cell = table.drop("tokens").withColumnsRenamed({d: f"_{d}" for d in DIMENSIONS} | {"docs": "_docs"}), [f"_{d}" for d in DIMENSIONS]
    size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("_docs"), F.lit(0))).head()
    rows = celled.drop(*clash)
    out = rows.join(F.broadcast(table.drop("_docs")), cell, "left") if size[0] <= BROADCAST_ROWS else lookup(rows, cell, table, size[1], "_docs").drop("_docs")
    return out.withColumn("kept", chance(id_col) < F.coalesce("probability", F.lit(1.0)))


def cells_of(docs: DataFrame, text_col: str = "text", topic_col: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """docs without the text, written, with ``_source``, ``_lang``, ``_topic`` and ``_tokens``; and the shares of the buckets of terms.

    ``topic_col`` is a column of docs that is the topic instead.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    found = scratch.cut(named_cells(measure(docs, text_col)), "measured")
    if topic_col is not None:
        return found.withColumn("_topic", F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE))), np.zeros(TOPICS)
    shares = term_shares(found)
    return scratch.cut(with_topic(found, shares), "cells"), shares


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """(id, source, lang, topic, tokens, weight, probability, kept) for every document."""
    own = [c for c in dict.fromkeys((id_col, "source", "lang", topic_col, text_col)) if c]
    celled, _ = cells_of(docs.select(*own), text_col, topic_col)
    celled = celled.select(id_col, "_source", "_lang", "_topic", "_tokens")
    _, table = plan(celled, targets, budget)
    out = sample(celled, table, id_col)
    return out.select(id_col, F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), "weight", "probability", "kept")


def take(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the sample holds.

    Texts are read twice, once to plan and once to take: so no text is moved.
    """
    slim, shares = cells_of(docs.select(id_col, "source", "lang", text_col), text_col)
    _, table = plan(slim, targets, budget)
    of = dict(zip(docs.columns, names := [f"__{k}" for k in range(len(docs.columns))]))
    measured = measure(docs.toDF(*names), of[text_col], shares, whole=True)
    celled = named_cells(measured.withColumns({"source": F.col(of["source"]), "lang": F.col(of["lang"])}))
    kept = sample(celled, table, of[id_col]).where("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in of.items()))
