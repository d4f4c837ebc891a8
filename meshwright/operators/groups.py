"""Many small groups of rows in one Arrow batch: whole numbers only, a group to a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_keys(rows: DataFrame, n_keys: int, kernel: Callable[[tuple[int, ...], np.ndarray], list[pd.DataFrame]], schema: str) -> DataFrame:
    """``kernel`` on every group's key (the first ``n_keys`` columns) and other columns, in the order of all columns; a task holds a group at a time and a batch."""
    return by_batches(rows, n_keys, lambda groups: [f for key, own in groups for f in kernel(key, own)], schema)


def by_batches(rows: DataFrame, n_keys: int, kernel: Callable[[list[tuple[tuple[int, ...], np.ndarray]]], list[pd.DataFrame]], schema: str) -> DataFrame:
    """As ``by_keys``, with all groups that end in a batch in one call."""
    keys = rows.columns[:n_keys]
    spread = rows.repartition(*keys).sortWithinPartitions(*rows.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # of a group that may go on in the next batch
        for frame in chain(frames, [None]):
            new = np.zeros((0, len(rows_columns)), np.int64) if frame is None else frame.to_numpy(np.int64)
            if held and len(new) and (held[0][0, :n_keys] == new[-1, :n_keys]).all():
                held.append(new)
                continue
            every = np.concatenate([*held, new])
            parts = np.split(every, np.flatnonzero((np.diff(every[:, :n_keys], axis=0) != 0).any(1)) + 1)
            held = [] if frame is None or not len(every) else [parts.pop()]
            out = kernel([(tuple(p[0, :n_keys].tolist()), p[:, n_keys:]) for p in parts if len(p)])
            if out:
                yield pd.concat(out, ignore_index=True)

    rows_columns = rows.columns
    return spread.mapInPandas(run, schema)


def pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ``n`` places that pairs (a, b) join, the least one in reach of each."""
    out = np.arange(n)
    while len(a):
        x, y = out[a], out[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(out, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (out[out] != out).any():
            out = out[out]
    return out
