"""Order-dependent steps over groups of rows, without a pandas frame per group.

Rows are dealt by key and sorted inside each partition; the worker walks the
Arrow batches and hands over one group at a time, so memory holds one group,
and millions of small groups cost little more than their rows.  A group is a
page, a table or a line; one of more rows than MAX_GROUP is none, and is an
error rather than a task without bound.

Where most groups are small, a step can also be given for many groups of one
size at once (``SameSize``): it walks the positions of a group, each for all groups
together in numpy, with the operations of the step in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows of a group, at most.
MAX_GROUP = 500_000
#: Groups of up to so many rows are taken together by size, if the step has a form for that; so many rows are gathered for it.
FEW, GATHERED = 32, 60_000
#: For all groups of one size: the rows (whole groups) and the indices of each group's rows, [groups, size], to rows of the schema.
SameSize = Callable[[pa.Table, np.ndarray], pa.Table]


def sequential(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[dict]], list[tuple]], schema: T.StructType | str, same_size: SameSize | None = None, finite: tuple[str, ...] = ()) -> DataFrame:
    """The rows that ``step`` gives for each group (its rows as dicts, in order), as tuples of ``schema``.

    ``same_size`` gives the same rows for groups of up to ``FEW`` rows whose columns ``finite`` are finite doubles.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        held: list[dict] = []
        at: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != at:
                    out += step(held)
                    held = []
                at = key
                held.append(row)
                if len(held) > MAX_GROUP:
                    raise ValueError(f"a group of {keys} has more than {MAX_GROUP} rows: {key}")
            if out:
                yield _batch(out, names, target)
        if held:
            out = step(held)
            if out:
                yield _batch(out, names, target)

    def run_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        n, wanted = 0, GATHERED
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= wanted:
                rows = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(rows, keys)
                yield from _together(rows.slice(0, starts[-1]), starts[:-1], keys, step, same_size, finite, names, target)
                rest = rows.slice(starts[-1])
                held, n = rest.to_batches(), rest.num_rows
                if n > MAX_GROUP:
                    raise ValueError(f"a group of {keys} has more than {MAX_GROUP} rows: {tuple(rest.column(k)[0].as_py() for k in keys)}")
                wanted = n + GATHERED
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from _together(rows, _starts(rows, keys), keys, step, same_size, finite, names, target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run_together if same_size else run, schema)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        c = rows.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _together(rows: pa.Table, starts: np.ndarray, keys: list[str], step, same_size: SameSize, finite: tuple[str, ...], names: list[str], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    if not len(starts):
        return
    sizes = np.diff(np.append(starts, rows.num_rows))
    plain = sizes > FEW
    for name in finite:
        if pa.types.is_float64(rows.schema.field(name).type):
            plain |= np.logical_or.reduceat(~np.isfinite(doubles(rows, name)), starts)
        else:
            plain[:] = True
    for size in np.unique(sizes[~plain]):
        at = starts[~plain & (sizes == size)][:, None] + np.arange(size)
        yield from same_size(rows, at).select(names).cast(target).combine_chunks().to_batches()
    for start, size in zip(starts[plain].tolist(), sizes[plain].tolist()):
        if size > MAX_GROUP:
            raise ValueError(f"a group of {keys} has more than {MAX_GROUP} rows: {tuple(rows.column(k)[start].as_py() for k in keys)}")
        out = step(rows.slice(start, size).to_pylist())
        if out:
            yield _batch(out, names, target)


def doubles(rows: pa.Table, name: str) -> np.ndarray:
    """A column of doubles, null as NaN."""
    return rows.column(name).to_numpy()


def _batch(rows: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=target)
