"""Denton disaggregation of whole panels, in time that grows with a series' length: one banded system a series, solved block by block."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONVERSIONS = ("sum", "mean", "first", "last")


def difference_penalty(n: int, power: int) -> np.ndarray:
    """The bands of D'D for ``power``-th differences of n values: row k holds the k-th diagonal, from the main one."""
    base = np.array([-1.0, 1.0]) if power == 1 else np.array([1.0, -2.0, 1.0])
    bands = np.zeros((power + 1, n))
    for k in range(power + 1):
        for i in range(power + 1 - k):
            bands[k, i : n - power + i] += base[i] * base[i + k]
    return bands


def weights_of(per: int, conversion: str) -> np.ndarray:
    """What a low-frequency value is made of: the sum, mean, first or last of its ``per`` slots."""
    return {"sum": np.ones(per), "mean": np.full(per, 1 / per), "first": np.eye(per)[0], "last": np.eye(per)[-1]}[conversion]


def smoothest(values: np.ndarray, per: int, conversion: str = "sum", power: int = 2, ridge: float = 1e-8, prior: np.ndarray | None = None) -> np.ndarray:
    """The path of len(values) * per slots that meets all values (NaN: none asked) and strays least from ``prior`` (else from 0).

    Straying is the squared ``power``-th differences of path less prior plus ``ridge`` times its
    squares. Slots and the multiplier of a value form a block; blocks touch neighbours only, and
    are eliminated one after another (a slot reaches ``power`` slots on, so ``per`` must be that at least).
    """
    m, n = len(values), len(values) * per
    if per < power:
        raise ValueError("a value needs as many slots as the power of the differences")
    if n <= power:
        return np.repeat(values / weights_of(per, conversion).sum(), per)
    bands = difference_penalty(n, power)
    bands[0] += ridge
    prior = np.zeros(n) if prior is None else prior
    w = weights_of(per, conversion)
    size, held = per + 1, np.isfinite(values)
    rows, cols = np.indices((per, per))
    near = np.abs(rows - cols)
    own = np.zeros((m, size, size))
    at = np.arange(m)[:, None, None] * per + np.minimum(rows, cols)
    own[:, :per, :per] = np.where(near <= power, bands[np.minimum(near, power), at], 0.0)
    own[:, :per, per] = own[:, per, :per] = w * held[:, None]
    own[:, per, per] = np.where(held, 0.0, 1.0)
    link = np.zeros((max(m - 1, 0), size, size))  # from a block to the next
    apart = per + cols - rows
    start = np.arange(m - 1)[:, None, None] * per + rows
    link[:, :per, :per] = np.where(apart <= power, bands[np.minimum(apart, power), start], 0.0)
    right = np.zeros((m, size))
    right[:, per] = np.where(held, np.nan_to_num(values) - prior.reshape(m, per) @ w, 0.0)
    carry = np.zeros((m, size, size))
    for i in range(m):  # forward: what is left of each block once those before it are gone
        if i:
            own[i] -= link[i - 1].T @ carry[i - 1]
            right[i] -= link[i - 1].T @ right[i - 1]
        solved = np.linalg.solve(own[i], np.column_stack([link[i] if i < m - 1 else np.zeros((size, 0)), right[i]]))
        if i < m - 1:
            carry[i] = solved[:, :-1]
        right[i] = solved[:, -1]
    for i in range(m - 2, -1, -1):
        right[i] -= carry[i] @ right[i + 1]
    return prior + right[:, :per].ravel()


def positive_blocks(path: np.ndarray, values: np.ndarray, per: int, conversion: str) -> np.ndarray:
    """The path without negative slots that still meets sums and means (values of 0 or more): each block is scaled; an empty one is filled evenly."""
    blocks = np.maximum(path.reshape(-1, per), 0.0)
    for block, value in zip(blocks, values):
        if not np.isfinite(value):
            continue
        if conversion in ("sum", "mean"):
            target, total = value * (per if conversion == "mean" else 1), block.sum()
            block[:] = target / per if total <= 1e-12 else block * (target / total)
        else:
            block[-1 if conversion == "last" else 0] = max(value, 0.0)
    return blocks.ravel()


def _month_end(month: int) -> int:
    """The day number of the last day of a month, counted from year 0."""
    year, m = divmod(month + 1, 12)
    return date(year, m + 1, 1).toordinal() - 1


def anchored(months: np.ndarray, values: np.ndarray, span: int, per: int, conversion: str) -> np.ndarray:
    """The prior path of consecutive periods of ``span`` months that begin in ``months``: values (a sum's share of a slot) at their anchor days, straight lines between, level beyond.

    The anchor is the end of the last or the first slot; of a sum or mean, the end of the period's
    middle month (of a year of months: July, of quarters: the second one).
    """
    step = span // per
    slots = np.array([_month_end(m + step * (k + 1) - 1) for m in months for k in range(per)], float)
    place = {"last": per - 1, "first": 0}.get(conversion, per // 2 if per > 4 else (per - 1) // 2)
    held = np.isfinite(values)
    share = values / per if conversion == "sum" else values
    return np.interp(slots, slots.reshape(-1, per)[held, place], share[held])


def denton_panel(low: DataFrame, per: int, conversion: str = "sum", mode: str = "classic", span: int = 3, power: int = 2, ridge: float | None = None, positive: bool = False, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(series, date, slot, path): every low-frequency value spread over ``per`` slots.

    ``span`` is a period's months: 3 for quarters, 12 for years. ``classic`` smooths second
    differences over the values in order, whether periods are missing between them or not.
    ``prior`` keeps to a path through the values' anchors (``anchored``) with differences of ``power``,
    over all periods from the first to the last, also those without a value; their ``date`` is null.
    ``positive`` scales blocks without their negative slots. Null values are left out; repeated
    dates are an error. A task takes one row for each series, its history.
    """
    if conversion not in CONVERSIONS or mode not in ("classic", "prior"):
        raise ValueError(f"no such conversion or mode: {conversion}, {mode}")
    ridge = ridge if ridge is not None else (1e-8 if mode == "classic" else 1e-6)
    month = (F.year(at) * 12 + F.month(at) - 1).cast("int")
    item = F.struct((month - month % span).alias("month"), F.col(at).alias("at"), F.col(x).cast("double").alias("x"))
    rows = low.filter(F.col(x).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kinds = {f.name: f.dataType.simpleString() for f in low.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, items in zip(frame[by], frame["items"]):
                months, dates, values = (np.array([i[k] for i in items], t) for k, t in (("month", np.int64), ("at", object), ("x", float)))
                if len(np.unique(months)) < len(months):
                    raise ValueError(f"{name}: two values of one period")
                if mode == "classic":
                    path = smoothest(values, per, conversion, 2, ridge)
                else:
                    every = np.arange(months[0], months[-1] + 1, span)
                    where = (months - months[0]) // span
                    full, on = np.full(len(every), np.nan), np.full(len(every), None, object)
                    full[where], on[where] = values, dates
                    values, dates = full, on
                    path = smoothest(values, per, conversion, power, ridge, anchored(every, values, span, per, conversion))
                if positive:
                    path = positive_blocks(path, values, per, conversion)
                n = len(values)
                yield pd.DataFrame({by: [name] * (n * per), at: np.repeat(dates, per), "period": np.repeat(np.arange(n), per), "slot": np.tile(np.arange(per), n), "path": path})

    return rows.mapInPandas(run, f"`{by}` {kinds[by]}, `{at}` {kinds[at]}, period long, slot int, path double")
