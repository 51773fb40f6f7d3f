"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and their prefixes of four and
five letters, as 32-bit hashes.  The score is the logistic of
w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms present, so pairs such as an
insult with a group's name count beyond the sum of their weights.  The machine
is fitted by full-batch AdaGrad on a bounded sample of labelled rows, over the
terms that differ most between the classes there.

Edge cases: null and empty texts have no terms and get the machine's base
score; repeated rows score alike; an empty table gives an empty table; other
columns are ignored.  If no label is known every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc32_of_id, small_batches, with_columns

#: Labelled rows per class that the machine is fitted on, about.
SAMPLE_ROWS = 2500
#: Longer texts are not learned from (they are scored whole).
SAMPLE_CHARS = 50_000
#: Terms that the machine has weights for, at most.
TERMS = 1024
#: Terms whose z-score between the classes is over 6 and this share of the largest are strong.
STRONG = 0.4
#: From this score on a text counts as toxic.
THRESHOLD = 0.7
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def chunk_terms(chunk: str) -> list[int]:
    """Hashed terms of one piece of text between white space."""
    out = []
    for w in _WORD.findall(chunk.lower()):
        out.append(zlib.crc32(w.encode()))
        out += [zlib.crc32((w[:k] + "*").encode()) for k in (4, 5) if len(w) > k]
    return out


def terms_of(text: str | None) -> set[int]:
    return {t for chunk in set((text or "").split()) for t in chunk_terms(chunk)}


class Machine:
    """Weights over the chosen terms."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.index = {int(t): k for k, t in enumerate(terms)}
        self.w0, self.w, self.v = w0, w, v

    def score(self, at: list[int]) -> float:
        """Probability of label 1 for the distinct term numbers of a text."""
        z = self.w0
        if at:
            v = self.v[at]
            z += self.w[at].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[np.ndarray], labels: np.ndarray, rank: int = 8, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> Machine:
    """Fits on the hashed terms of each text; classes weigh the same whatever their shares."""
    if not len(labels) or len(set(labels.tolist())) < 2:
        base = 30.0 if len(labels) and labels[0] else -30.0
        return Machine(np.zeros(0, np.int64), base, np.zeros(0), np.zeros((0, rank)))
    flat, of = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    terms, inverse = np.unique(flat, return_inverse=True)
    y = labels.astype(float)
    n1, n0 = y.sum(), (1 - y).sum()
    with1 = np.bincount(inverse, weights=y[of], minlength=len(terms))
    df = np.bincount(inverse, minlength=len(terms)).astype(float)
    p1, p0, p = with1 / n1, (df - with1) / n0, df / len(y)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[(df < 5) | (z < 4)] = 0
    chosen = np.argsort(-z, kind="stable")[:TERMS]
    chosen = np.sort(chosen[z[chosen] > 0])
    to = np.full(len(terms), -1)
    to[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    ok = to[inverse] >= 0
    x[of[ok], to[inverse][ok]] = 1
    rng = np.random.default_rng(7)
    # A strong term starts at half its log-odds: texts mostly hold several, and one alone has to do.
    odds = (np.log((with1[chosen] + 0.5) / (n1 + 1)) - np.log((df - with1)[chosen] + 0.5) + np.log(n0 + 1)).astype(np.float32)
    w0, w, v = 0.0, np.where((np.abs(odds) > 2) & (z[chosen] > max(6.0, STRONG * z.max(initial=0.0))), odds / 2, 0).astype(np.float32), rng.normal(0, 0.01, (len(chosen), rank)).astype(np.float32)
    g0, gw, gv = 1e-6, np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    y = y.astype(np.float32)
    for _ in range(steps):
        xv = x @ v
        zed = w0 + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        err = (weight * (1 / (1 + np.exp(-np.clip(zed, -30, 30))) - y)).astype(np.float32)
        d0, xe = err.sum(), x.T @ err
        dw = xe + l2 * w / max(len(chosen), 1)
        dv = x.T @ (err[:, None] * xv) - xe[:, None] * v + l2 * v
        g0 += d0**2
        gw += dw**2
        gv += dv**2
        w0 -= rate * d0 / np.sqrt(g0)
        w -= rate * dw / np.sqrt(gw)
        v -= 0.2 * rate * dv / np.sqrt(gv)
    return Machine(terms[chosen], w0, w, v)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on labelled rows that are not held out: those whose crc32 of the id mod 3 is not 1.

    The sample's ids are bounded, so they are broadcast; only their hashed terms reach the driver.
    """
    small_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & (crc32_of_id(id_col) % 3 != 1)).select(id_col, F.col(label_col).cast("int").alias("__y"))
    chosen = bounded_sample(known, "__y", id_col, sample_rows)
    src = df.select(id_col, F.col(text_col).alias("__text")).where(F.length("__text") <= SAMPLE_CHARS).join(F.broadcast(chosen), id_col).select("__y", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.fromiter(terms_of(t), np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["y", "terms"])

    rows = sorted(src.mapInArrow(run, "y int, terms binary").collect(), key=lambda r: (r[0], bytes(r[1])))
    return fit([np.frombuffer(r[1], np.uint32).astype(np.int64) for r in rows], np.array([r[0] for r in rows]))


def score(df: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """df with the score of every whole text; no shuffle, and bounded caches in the workers."""
    small_batches(df.sparkSession)
    schema = with_columns(df.schema, (score_col, T.DoubleType()))
    kept = [f.name for f in schema.fields[:-1]]
    src = df.select(*kept, df[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        index = machine.index
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found: set[int] = set()
                for chunk in set((text or "").split()):
                    at = cache.get(chunk)
                    if at is None:
                        at = tuple(index[t] for t in chunk_terms(chunk) if t in index)
                        if len(cache) >= 400_000:
                            cache.clear()
                        if len(chunk) <= 64:
                            cache[chunk] = at
                    if at:
                        found.update(at)
                scores.append(machine.score(sorted(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, score_col])

    return src.mapInArrow(run, schema)
