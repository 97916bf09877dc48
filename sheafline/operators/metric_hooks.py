"""Metrics of the user's own: a state that is updated by blocks of rows and merged.

The extension point for what sums of columns cannot say. A metric sees the rows as arrays, one call
per Arrow batch and group; only states leave a task, so a group that holds most rows is spread over
all tasks and its states meet in one small merge.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sheafline.session import materialize

FAN = 64  # states of one group that are merged in a task


class Metric(Protocol):
    """States are anything that pickles; ``merge`` may be called in any order."""

    def start(self) -> Any: ...

    def update(self, state: Any, *columns: np.ndarray) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> float | None: ...


class BalancedAccuracy:
    """Mean of the two classes' recalls; of one class alone where the other does not occur."""

    def start(self) -> np.ndarray:
        return np.zeros(4, np.int64)

    def update(self, state: np.ndarray, label: np.ndarray, pred: np.ndarray) -> np.ndarray:
        known = ~(pd.isna(label) | pd.isna(pred))
        label, pred = label[known].astype(float), pred[known].astype(float)
        cells = [((label == y) & (pred == p)).sum() for y in (0, 1) for p in (0, 1)]
        return state + np.array(cells, np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> float | None:
        rates = [hit / (hit + miss) for hit, miss in ((state[0], state[1]), (state[3], state[2])) if hit + miss]
        return float(np.mean(rates)) if rates else None


class RankStatistic:
    """Probability that a row of class 1 scores above one of class 0, ties half (area under the curve).

    Scores are counted in steps of ``step``: exact for scores of that many decimals, and the state's
    size follows the range of the scores, not the rows.
    """

    def __init__(self, step: float = 0.001):
        self.step = step

    def start(self) -> dict[int, np.ndarray]:
        return {}

    def update(self, state: dict, label: np.ndarray, score: np.ndarray) -> dict:
        known = ~(pd.isna(label) | pd.isna(score))
        label, score = label[known].astype(float), score[known].astype(float)
        places, at = np.unique(np.rint(score / self.step).astype(np.int64), return_inverse=True)
        zeros, ones = (np.bincount(at, label == y, len(places)).astype(np.int64) for y in (0, 1))
        return self.merge(state, {int(p): np.array(c) for p, *c in zip(places, zeros, ones)})

    def merge(self, a: dict, b: dict) -> dict:
        out = dict(a)
        for place, cells in b.items():
            out[place] = out[place] + cells if place in out else cells
        return out

    def finish(self, state: dict) -> float | None:
        below, won, zeros, ones = 0, 0.0, 0, 0
        for place in sorted(state):
            low, high = (int(x) for x in state[place])
            won += high * (below + low / 2)
            below, zeros, ones = below + low, zeros + low, ones + high
        return won / (zeros * ones) if zeros and ones else None


def grouped_metrics(df: DataFrame, by: list[str], columns: list[str], metrics: dict[str, Metric]) -> DataFrame:
    """One row per group with a DOUBLE column per metric; ``columns`` are what the metrics see.

    Null groups are a group. A metric that has nothing to say (``finish`` gives None) is null.
    """
    names = list(metrics)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list] = {}
        keys: dict[tuple, int] = {}
        for batch in batches:
            frame = batch.to_pandas()
            grouped = frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]
            for key, rows in grouped:
                key = tuple(None if pd.isna(k) else k for k in key)
                at = keys.setdefault(key, len(keys))
                state = states.setdefault(at, [metrics[n].start() for n in names])
                arrays = [rows[c].to_numpy() for c in columns]
                states[at] = [metrics[n].update(s, *arrays) for n, s in zip(names, state)]
        task = TaskContext.get().partitionId()
        arrays = [pa.array([k[i] for k in keys], t.type) for i, t in enumerate(key_types)]
        rest = [pa.array([task] * len(keys), pa.int64()), pa.array([pickle.dumps(states[i]) for i in keys.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, *rest], [*by, "_task", "_state"])

    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = df.select(*by, *columns)
    key_types = [f for f in to_arrow_schema(narrow.select(*by).schema)] if by else []
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in narrow.dtypes[: len(by)]), "_task long, _state binary"])
    states = materialize(narrow.mapInArrow(of_task, kinds))

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in rows.sort_values("_task")["_state"]:
            found = pickle.loads(data)
            total = found if total is None else [metrics[n].merge(a, b) for n, a, b in zip(names, total, found)]
        out = rows.iloc[:1].copy()
        out["_task"], out["_state"] = int(key[-1]), pickle.dumps(total)
        return out

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = pickle.loads(together((*key, 0), rows)["_state"].iloc[0])
        out = rows[by].iloc[:1].copy() if by else pd.DataFrame(index=[0])
        for n, s in zip(names, state):
            out[n] = [metrics[n].finish(s)]
        return out.astype({n: "float64" for n in names})

    while (states.agg(F.max("_task")).first()[0] or 0) >= FAN:
        level = states.withColumn("_task", F.floor(F.col("_task") / F.lit(FAN)))
        states = materialize(level.groupBy(*by, "_task").applyInPandas(together, kinds))
    result = ", ".join([*(f"`{c}` {t}" for c, t in narrow.dtypes[: len(by)]), *(f"`{n}` double" for n in names)])
    # float columns of Arrow turn a missing value into NaN
    done = states.groupBy(*by).applyInPandas(last, result)
    return done.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
