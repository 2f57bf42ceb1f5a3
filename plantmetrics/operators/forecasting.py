"""Additive Holt-Winters smoothing with weights and first states fitted together, and the comparison with the tree models."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORECAST_SCHEMA = "series string, step int, forecast double"
GRID = np.array([0.02, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])  # where the search starts
STARTS = 3  # so many of the best grid points are refined
FINEST = 1e-4
BATCH_SERIES = 256  # series that are fitted together


def follow(values: np.ndarray, period: int, weights: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run the smoothing of many series with many weight triples at once.

    ``values`` is series x time, ``weights`` series x triples x 3. ``states`` is (2 + period) x columns (level, trend, seasons),
    or has series and triples in front. All is linear in the states: column 0 follows the values from its states, and each other
    column is the response to its states alone. Returns the sums of products of the residuals' columns, and the last states.
    """
    series, n = values.shape
    states = np.broadcast_to(states, (series, weights.shape[1], *states.shape[-2:]))
    level, trend = states[:, :, 0], states[:, :, 1]
    season = [states[:, :, 2 + i] for i in range(period)]
    alpha, beta, gamma = (weights[:, :, i, None] for i in range(3))
    columns = states.shape[-1]
    first = np.zeros(columns)
    first[0] = 1.0
    products = np.zeros((*level.shape, columns))
    for i in range(n):
        value = values[:, i, None, None] * first
        slot = i % period
        residual = value - (level + trend + season[slot])
        products += residual[..., :, None] * residual[..., None, :]
        before = level
        level = alpha * (value - season[slot]) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season[slot] = gamma * (value - level) + (1 - gamma) * season[slot]
    return products, np.stack([level, trend, *season], axis=2)


def best_states(values: np.ndarray, period: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every weight triple the least squared one-step error over all first states, and these states.

    The error is a quadratic form of the states, so its least value comes from a small linear system. Level and seasons may be
    moved against each other; the solution of least size is taken.
    """
    size = 2 + period
    products, _ = follow(values, period, weights, np.hstack([np.zeros((size, 1)), np.eye(size)]))
    across, own = products[..., 1:, 0], products[..., 1:, 1:]
    states = -(np.linalg.pinv(own, rcond=1e-11, hermitian=True) @ across[..., None])[..., 0]
    return products[..., 0, 0] + (across * states).sum(-1), states


def usual_states(values: np.ndarray, period: int) -> np.ndarray:
    """Level, trend and seasons read off the first two periods: series x (2 + period)."""
    head, second = values[:, :period], values[:, period : 2 * period]
    level = head.mean(axis=1)
    slope = (second.mean(axis=1) - level) / period if second.shape[1] == period else np.zeros(len(values))
    return np.column_stack([level, slope, head - level[:, None]])


def refine(values: np.ndarray, weights: np.ndarray, error_of) -> tuple[np.ndarray, np.ndarray]:
    """From one triple per series to a triple that no step in a weight improves; steps are halved down to ``FINEST``."""
    moves = np.vstack([np.zeros(3), np.eye(3), -np.eye(3), np.array(list(itertools.product((-1, 1), repeat=3)))])
    step = np.full(len(values), 0.1)
    error = error_of(weights[:, None])[:, 0]
    while (step > FINEST).any():
        near = np.clip(weights[:, None] + step[:, None, None] * moves, 0.0, 1.0)
        errors = error_of(near)
        best = errors.argmin(axis=1)
        everyone = np.arange(len(values))
        better = (errors[everyone, best] < error) & (step > FINEST)
        weights = np.where(better[:, None], near[everyone, best], weights)
        error = np.where(better, errors[everyone, best], error)
        step = np.where(better, step, step / 2)
    return weights, error


def fit_many(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (series x 3), first states and squared one-step error of series of one length.

    First the weights are searched with the usual first states; then weights and states together, from there and from the best
    grid points. A solution is taken only where a run with it has the smallest error, so the joint fit is never worse.
    """
    grid = np.broadcast_to(np.array(list(itertools.product(GRID, GRID, GRID))), (len(values), len(GRID) ** 3, 3))
    usual = usual_states(values, period)
    given = usual[:, None, :, None]

    def usual_error(weights: np.ndarray) -> np.ndarray:
        return follow(values, period, weights, given)[0][..., 0, 0]

    def joint_error(weights: np.ndarray) -> np.ndarray:
        return best_states(values, period, weights)[0]

    def at_best(errors: np.ndarray, place: int) -> np.ndarray:
        return grid[np.arange(len(values)), np.argsort(errors, axis=1, kind="stable")[:, place]]

    weights, error = refine(values, at_best(usual_error(grid), 0), usual_error)
    found, states = weights, usual
    on_grid = joint_error(grid)
    for start in [weights, *[at_best(on_grid, i) for i in range(STARTS)]]:
        tried, _ = refine(values, start, joint_error)
        own = best_states(values, period, tried[:, None])[1][:, 0]
        reached = follow(values, period, tried[:, None], own[:, None, :, None])[0][:, 0, 0, 0]
        better = reached < error
        error = np.where(better, reached, error)
        found = np.where(better[:, None], tried, found)
        states = np.where(better[:, None], own, states)
    return found, states, error


def smooth_many(values: np.ndarray, period: int, horizon: int) -> np.ndarray:
    """Forecasts, series x horizon."""
    weights, states, _ = fit_many(values, period)
    _, last = follow(values, period, weights[:, None], states[:, None, :, None])
    level, trend, season = last[:, 0, 0, 0], last[:, 0, 1, 0], last[:, 0, 2:, 0]
    ahead = [level + trend * s + season[:, (values.shape[1] + s - 1) % period] for s in range(1, horizon + 1)]
    return np.stack(ahead, axis=1)


def smooth(values: np.ndarray, period: int, horizon: int) -> np.ndarray:
    """The forecast of one series."""
    return smooth_many(np.asarray(values, dtype=float)[None], period, horizon)[0]


def season_length(n: int) -> int:
    return max(min(4, n // 2), 1)


def holt_winters(training: DataFrame, horizon: int) -> DataFrame:
    """Forecast ``horizon`` weeks per series. A task fits its series in batches, those of one length together."""

    def forecasts(waiting: list[tuple[str, np.ndarray]]) -> pd.DataFrame:
        parts = []
        for n in sorted({len(v) for _, v in waiting}):
            own = [(name, v) for name, v in waiting if len(v) == n]
            ahead = smooth_many(np.stack([v for _, v in own]), season_length(n), horizon)
            parts.append(
                pd.DataFrame(
                    {
                        "series": np.repeat([name for name, _ in own], horizon),
                        "step": np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(own)),
                        "forecast": ahead.ravel(),
                    }
                )
            )
        return pd.concat(parts)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, open_name, open_values = [], None, []
        for batch in batches:
            for name, rows in batch.groupby("series", sort=False, dropna=False):
                if open_values and name != open_name:
                    waiting.append((open_name, np.concatenate(open_values)))
                    open_values = []
                open_name = name
                open_values.append(rows["demand"].to_numpy(dtype=float))
            if len(waiting) >= BATCH_SERIES:
                yield forecasts(waiting)
                waiting = []
        if open_values:
            waiting.append((open_name, np.concatenate(open_values)))
        if waiting:
            yield forecasts(waiting)

    # the series of a task come one after the other, in date order
    lined_up = training.select("series", "date", "demand").repartition("series").sortWithinPartitions("series", "date")
    return lined_up.select("series", "demand").mapInPandas(fit, FORECAST_SCHEMA)


def against_actual(forecast: DataFrame, test: DataFrame) -> DataFrame:
    """Forecast steps beside the test weeks of the series, in date order."""
    step = F.row_number().over(W.partitionBy("series").orderBy("date"))
    return test.select("series", "date", "demand", step.alias("step")).join(forecast, ["series", "step"])
