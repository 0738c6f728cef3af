"""Regressions on hundreds of columns held as one array: cross-products in a plan that does not grow with them, components, and cross-fitted effects with nested choice of controls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from macrotide.operators.factors import principal
from macrotide.operators.regression import hac_slope
from macrotide.operators.shocks import _net_fit

#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20


def wide_rows(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value", whole: bool = True) -> DataFrame:
    """(date, names, w): the values of all series in order of name on every date; missing ones are null, or with ``whole`` their dates left out."""
    held = panel.select(F.col(by).cast("string").alias("name"), at, F.col(x).cast("double").alias("x"))
    grid = held.select("name").distinct().crossJoin(held.select(at).distinct())  # what a panel without gaps would hold
    full = grid.join(held, ["name", at], "left").groupBy(at).agg(F.array_sort(F.collect_list(F.struct("name", "x"))).alias("items"))
    out = full.select(at, F.col("items.name").alias("names"), F.col("items.x").alias("w"))
    return out.filter(~F.exists("w", lambda v: v.isNull())) if whole else out


def wide_gram(df: DataFrame, by: list[str], w: str = "w", centred_by: list[str] | None = None) -> DataFrame:
    """(*by, i, j, s) for i <= j, and (*by, -1, j, mean): sums of products of the elements of array ``w``, less their means.

    Means are of the groups of ``centred_by`` (``by`` unless given, of which it must be a part), so that the
    sums of finer groups can be added. Index 0 is a constant: s(0, 0) counts rows, s(0, j) are sums
    of centred values. Arrays of a group must be of one length and without nulls; others raise.
    Tasks add up whole matrices for the groups they meet; one aggregation, whatever the length.
    """
    centred_by = by if centred_by is None else centred_by
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    # rows are met twice: for the means, and for the products of what is left
    parts = df.select(*centred_by, F.posexplode(w).alias("i", "x")).groupBy(*centred_by, "i").agg(F.avg("x").alias("m"))
    means = parts.groupBy(*centred_by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("__means"))
    rows = (df.select(*by, F.col(w).alias("__w")).join(means, centred_by) if centred_by else df.select(*by, F.col(w).alias("__w")).crossJoin(F.broadcast(means))).select(*by, "__w", "__means")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for key, s in held.items():
                i, j = np.triu_indices(len(s))
                columns = [pa.array([v] * len(i)).cast(batch.schema.field(c).type) for c, v in zip(by, key)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], [*by, "i", "j", "s"])

        for batch in batches:
            frame = batch.select(by).to_pandas() if by else None
            groups = frame.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(batch.num_rows)}
            values = batch.column(len(by))
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                own = values.take(pa.array(at))
                if own.flatten().null_count or len({len(x) for x in own}) > 1:
                    raise ValueError("arrays of one length without nulls are needed")
                x = np.stack(own.to_numpy(zero_copy_only=False)) - np.stack(batch.column(len(by) + 1).take(pa.array(at)).to_numpy(zero_copy_only=False))
                x = np.column_stack([np.ones(len(x)), x])
                if key not in held:
                    held[key] = np.zeros((x.shape[1],) * 2)
                    size += held[key].nbytes
                held[key] += x.T @ x
            if size > HELD_BYTES:
                yield from out()
                held, size = {}, 0
        if held:
            yield from out()

    sums = rows.mapInArrow(run, f"{keys}{', ' if by else ''}i int, j int, s double").groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))
    shifts = means.select(*centred_by, F.posexplode("__means").alias("p", "s")).select(*centred_by, F.lit(-1).alias("i"), (F.col("p") + 1).cast("int").alias("j"), "s")
    if by != centred_by:
        shifts = shifts.join(df.select(*by).distinct(), centred_by) if centred_by else shifts.crossJoin(df.select(*by).distinct())
    return sums.unionByName(shifts.select(*by, "i", "j", "s"))


def matrix_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sums, means) of one group's rows of ``wide_gram``."""
    shift, rows = frame[frame["i"] < 0], frame[frame["i"] >= 0]
    size = int(rows["j"].max()) + 1
    s, means = np.zeros((size, size)), np.zeros(size - 1)
    s[rows["i"], rows["j"]] = s[rows["j"], rows["i"]] = rows["s"]
    means[shift["j"].to_numpy() - 1] = shift["s"]
    return s, means


def wide_components(df: DataFrame, by: list[str], w: str = "w", threshold: float = 0.9, most: int = 5) -> DataFrame:
    """(*by, n, k, share, means, scales, loadings) of the standardized elements of array ``w``, as ``factors.components`` has them for columns."""
    keyed = df if by else df.withColumn("__all", F.lit(1))
    own = by or ["__all"]
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        s, means = matrix_of(frame)
        n = s[0, 0]
        k, share, scales, loads = principal(s[1:, 1:] / n - np.outer(s[0, 1:], s[0, 1:]) / n**2, threshold, most)
        return pd.DataFrame([[*frame[own].iloc[0], int(n), k, share, means.tolist(), scales, loads]], columns=[*own, "n", "k", "share", "means", "scales", "loadings"])

    keys = ", ".join(f"`{c}` {kinds[c]}" for c in own)
    out = wide_gram(keyed, own, w).groupBy(*own).applyInPandas(solve, f"{keys}, n long, k int, share array<double>, means array<double>, scales array<double>, loadings array<array<double>>")
    return out if by else out.drop("__all")


def wide_scores(df: DataFrame, fits: DataFrame, by: list[str], w: str = "w", most: int = 5) -> DataFrame:
    """Rows with f1 .. f<most>: the scores of array ``w`` on its group's components, 0 beyond k; a null element counts as its mean."""
    rows = df.join(fits.select(*by, "means", "scales", "loadings"), by) if by else df.crossJoin(F.broadcast(fits.select("means", "scales", "loadings")))
    z = F.transform(F.arrays_zip(F.col(w).alias("x"), F.col("means").alias("m"), F.col("scales").alias("s")), lambda v: F.coalesce((v["x"] - v["m"]) * v["s"], F.lit(0.0)))
    rows = rows.withColumn("__z", z)

    def score(k: int):
        return F.when(F.size("loadings") > k, F.aggregate(F.zip_with("__z", F.get("loadings", F.lit(k)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)

    return rows.withColumns({f"f{k + 1}": score(k) for k in range(most)}).drop("means", "scales", "loadings", "__z")


def chosen_controls(s: np.ndarray, p: int, most: int | None, mode: str, forced: list[int]) -> np.ndarray:
    """Which of p controls a fit may use, from moments of (1, controls, y, d): all, or ``forced`` and others up to ``most``.

    corr_t takes the largest |correlation| with d, variance the largest variance,
    corr_t_then_variance half of each; without variation of d, variance decides. Controls that do not
    vary are left out; ties go by place.
    """
    if not most or p <= most:
        return np.arange(p)
    n = s[0, 0]
    cov = s[1:, 1:] / n - np.outer(s[0, 1:], s[0, 1:]) / n**2
    spread = np.maximum(np.diag(cov), 0)
    rest = [j for j in range(p) if j not in forced and spread[j] > 1e-16]
    room = max(most - len(forced), 0)
    by_spread = sorted(rest, key=lambda j: (-round(spread[j], 12), j))
    scale = np.sqrt(spread * spread[p + 1])
    r = np.abs(np.divide(cov[:, p + 1], scale, out=np.zeros_like(scale), where=scale > 0))
    by_r = sorted(rest, key=lambda j: (-round(r[j], 12), j))
    if mode == "variance" or spread[p + 1] <= 1e-16:
        picked = by_spread[:room]
    elif mode == "corr_t":
        picked = by_r[:room]
    elif mode == "corr_t_then_variance":
        picked = by_r[: max(1, room // 2)] if room else []
        picked += [j for j in by_spread if j not in picked][: room - len(picked)]
    else:
        raise ValueError(f"no such choice of controls: {mode}")
    return np.array(sorted([*forced, *picked]), int)


def nested_fits(df: DataFrame, by: list[str], y: str, d: str, w: str, fold: str, most: int | None = None, mode: str = "corr_t", forced: list[int] | None = None, l1_ratio: float = 0.5, rounds: int = 1000) -> DataFrame:
    """(*by, fold, n_train, controls, penalty_y, penalty_d, b_y, b_d): elastic nets of y and of d on controls, for each fold from the others.

    Which controls are used and how hard slopes are shrunk is settled inside a fold's training
    rows: the choice from their moments, the penalty by leaving out one training fold after
    another. b has the intercept and a slope for every element of ``w``. Without a control the
    training mean is the fit; a fold whose training rows are fewer than 3 has no fit. A group's task
    gets the moments of each fold, not its rows.
    """
    forced = forced or []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    held = df.filter(F.col(y).isNotNull() & F.col(d).isNotNull() & F.col(fold).isNotNull() & ~F.exists(F.coalesce(w, F.array(F.lit(None).cast("double"))), lambda v: v.isNull()))
    rows = held.select(*by, fold, F.concat(F.transform(w, lambda v: v.cast("double")), F.array(F.col(y).cast("double"), F.col(d).cast("double"))).alias("w"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        names, parts, means = [], [], None
        for name, own in frame.groupby(fold):
            s, means = matrix_of(own)
            names.append(name)
            parts.append(s)
        folds, out = np.stack(parts), []
        p = folds.shape[1] - 3
        for i, name in enumerate(names):
            train = np.delete(folds, i, 0)
            n = train[:, 0, 0].sum() if len(train) else 0
            if n < 3:
                continue
            used = chosen_controls(train.sum(0), p, most, mode, forced)
            found = []
            for target in (p + 1, p + 2):
                b = np.zeros(p + 1)
                keep = np.concatenate([[0], 1 + used, [target]]).astype(int)
                if len(used):
                    fitted, penalty, _, _ = _net_fit(train[:, keep][:, :, keep], l1_ratio, rounds, None)
                    b[0], b[1 + used] = fitted[0], fitted[1:]
                else:
                    b[0], penalty = train[:, 0, target].sum() / n, np.nan
                b[0] += means[target - 1] - b[1:] @ means[:p]  # moments are about the group's means
                found.append((float(penalty), b.tolist()))
            out.append([*frame[by].iloc[0], name, int(n), used.tolist(), found[0][0], found[1][0], found[0][1], found[1][1]])
        return pd.DataFrame(out, columns=[*by, fold, "n_train", "controls", "penalty_y", "penalty_d", "b_y", "b_d"])

    keys = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, fold])
    return wide_gram(rows, [*by, fold], "w", centred_by=by).groupBy(*by).applyInPandas(fit, f"{keys}, n_train long, controls array<int>, penalty_y double, penalty_d double, b_y array<double>, b_d array<double>")


def nested_partially_linear(df: DataFrame, by: list[str], at: str, y: str, d: str, w: str, fold: str, lags: int = 3, least: int = 10, **options) -> DataFrame:
    """(*by, n, beta, se, z, p, lo, hi): the cross-fitted effect of d on y given the array of controls ``w`` (``nested_fits``), with HAC errors and a 95 % interval; none below ``least`` rows."""
    fits = nested_fits(df, by, y, d, w, fold, **options).select(*by, fold, "b_y", "b_d")

    def fitted(b: str):
        return F.element_at(b, 1) + F.aggregate(F.zip_with(w, F.slice(b, F.lit(2), F.size(w)), lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)

    rows = df.filter(F.col(y).isNotNull() & F.col(d).isNotNull() & ~F.exists(w, lambda v: v.isNull())).join(fits, [*by, fold])
    rows = rows.withColumns({"r_y": F.col(y) - fitted("b_y"), "r_d": F.col(d) - fitted("b_d")})
    out = hac_slope(rows, by, at, "r_y", "r_d", lags).filter(F.col("n") >= least)
    return out.withColumns({"lo": F.col("beta") - 1.96 * F.col("se"), "hi": F.col("beta") + 1.96 * F.col("se")})


def fold_in_order(df: DataFrame, by: list[str], at: str, folds: int, name: str = "fold") -> DataFrame:
    """Adds the fold of each row of a group: runs of consecutive rows, as equal as can be."""
    from macrotide.operators.instruments import fold_of

    whole = Window.partitionBy(*by)
    return df.withColumn(name, fold_of(F.row_number().over(whole.orderBy(at)) - 1, F.count("*").over(whole), folds))
