"""Contracts of pixel and model steps.

An adapter turns batches of rows into batches of rows with a fixed schema and
is run by ``run`` as ``mapInPandas``; its model is loaded once per Python
worker, on first use.  Where a capability is missing, the row says so: text is
never made up.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

RECOGNIZED = "region_id string, line_index int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, backend string, model string, model_version string, flags array<string>, error string"
LAYOUT = "page_id string, region_index int, label string, confidence double, x0 double, y0 double, x1 double, y1 double, backend string, error string"
CELLS = "region_id string, cell_idx int, row int, column int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, backend string, error string"
RENDERED = "page_id string, content binary, width int, height int, dpi double, error string"


class Adapter(Protocol):
    """What runs in the workers: its name, output schema and step over one batch."""

    name: str
    schema: str

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class Unavailable:
    """Stands for a missing capability: a row per input, with the flag and no text."""

    def __init__(self, name: str, key: str = "region_id", schema: str = RECOGNIZED):
        self.name, self.key, self.schema = name, key, schema

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        out = pd.DataFrame({c: [None] * len(batch) for c in columns}, dtype=object)
        out[self.key] = batch[self.key].astype(str).tolist()
        if "backend" in columns:
            out["backend"] = self.name
        if "flags" in columns:
            out["flags"] = [["missing_backend", "capability_unavailable"] for _ in range(len(batch))]
        out["error"] = "capability_unavailable"
        return out


class PerWorker:
    """A model that each Python worker loads once, on first use."""

    _loaded: dict[str, Any] = {}
    _lock = threading.Lock()

    def __init__(self, name: str, load: Callable[[], Any]):
        self.name, self.load = name, load

    def get(self) -> Any:
        with self._lock:
            if self.name not in self._loaded:
                self._loaded[self.name] = self.load()
            return self._loaded[self.name]


def run(rows: DataFrame, adapter: Adapter, key: str = "region_id") -> DataFrame:
    """The adapter's rows for every batch; a batch that fails gives a row with the error for each input."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield adapter(batch)
            except Exception as e:  # a model's fault is data of the row, not the job's end
                failed = Unavailable(adapter.name, key, adapter.schema)(batch)
                failed["error"] = f"backend_failure: {type(e).__name__}: {e}"[:500]
                yield failed

    return rows.mapInPandas(step, adapter.schema)


def staged(rows: DataFrame, adapters: list[Adapter], good: Callable[[DataFrame], DataFrame], key: str = "region_id") -> list[DataFrame]:
    """Each adapter runs on the rows that the ones before did not settle; ``good`` gives the keys settled by its rows."""
    out, left = [], rows
    for adapter in adapters:
        got = run(left, adapter, key)
        out.append(got)
        left = left.join(good(got).select(key).distinct(), key, "left_anti")
    return out
