"""Online correlation graph over a stream: exponentially weighted moments of each pair as keyed state.

Input rows are pairs ``a, b, t, x, y``. Pairs are independent, so state is one small record a pair and
the stream scales with their number. Within a micro-batch rows are applied in order of t; rows not
later than a pair's last t are rejected (put ``withWatermark`` before to bound waiting).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "t long, n long, mx double, my double, xx double, yy double, xy double"
OUTPUT = "a string, b string, t long, n long, corr double"


def update(state: tuple | None, t: int, x: float, y: float, alpha: float, start_variance: float = 0.01) -> tuple:
    """One observation; the first sets the means only."""
    if state is None:
        return (t, 1, x, y, start_variance, start_variance, 0.0)
    _, n, mx, my, xx, yy, xy = state
    dx, dy, keep = x - mx, y - my, 1 - alpha
    return (t, n + 1, keep * mx + alpha * x, keep * my + alpha * y, keep * xx + alpha * dx * dx, keep * yy + alpha * dy * dy, keep * xy + alpha * dx * dy)


def online_correlations(stream: DataFrame, alpha: float = 0.06) -> DataFrame:
    """Each pair's latest correlation after every micro-batch that touched it (update mode)."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        for t, x, y in zip(rows["t"], rows["x"], rows["y"]):
            if current is None or t > current[0]:
                current = update(current, int(t), float(x), float(y), alpha)
        state.update(current)
        t, n, _, _, xx, yy, xy = current
        yield pd.DataFrame([(key[0], key[1], t, n, xy / ((xx**0.5 + 1e-9) * (yy**0.5 + 1e-9)))], columns=["a", "b", "t", "n", "corr"])

    return stream.groupBy("a", "b").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
