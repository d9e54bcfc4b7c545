"""Template time series and Granger tests between them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logtide.operators.classify import is_info
from logtide.plans.common import materialize

# Points per series, window length in strides, lags, significance.
POINTS, WINDOW_STRIDES, MAX_LAG, SIGNIFICANCE, TOP_PAIRS = 1000, 5, 5, 0.05, 10
BLOCK = 128  # series per block of the pair grid


def template_series(labelled: DataFrame) -> DataFrame:
    """Counts per template in sliding windows, as one array per template.

    Windows start at the first record, move by whole seconds of span/1000 (at
    least one), last span/200 and end by the last record. Records are reduced
    to counts per template and range of windows before being spread over those
    windows. Series with at most three distinct values are dropped.
    """
    shown = labelled.where(~is_info(F.col("golden_signal"))).select("template_id", "epoch")
    span = shown.agg(F.min("epoch").alias("_min"), F.max("epoch").alias("_max"))
    step = (F.col("_max") - F.col("_min")) / POINTS
    span = span.select("_min", "_max", F.greatest(F.floor(step), F.lit(1)).alias("_stride"),
                       (step * WINDOW_STRIDES).alias("_width"))
    last = F.floor((F.col("_max") - F.col("_min") - F.col("_width")) / F.col("_stride"))
    span = span.withColumn("_last", last)
    offset = F.col("epoch") - F.col("_min")
    high = F.least(F.floor(offset / F.col("_stride")), F.col("_last"))
    low = F.greatest(
        F.floor((offset - F.col("_width")) / F.col("_stride")) + 1, F.lit(0).cast("long")
    )
    counted = (
        shown.crossJoin(F.broadcast(span))
        .groupBy("template_id", low.alias("low"), high.alias("high"), F.col("_last").alias("last"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("epoch").alias("since"))
    )
    per_window = (
        counted.where("low <= high")
        .withColumn("k", F.explode(F.sequence("low", "high")))
        .groupBy("template_id", "last", "k").agg(F.sum("c").alias("c"), F.min("since").alias("since"))
    )
    filled = per_window.groupBy("template_id", "last").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"),
        F.min("since").alias("since"),
    )
    values = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("last")),
        lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")),
    )
    series = filled.select("template_id", "since", values.alias("values"))
    return series.where(F.size(F.array_distinct("values")) > 3)


def differenced(series: DataFrame) -> DataFrame:
    """First differences; series that become constant are dropped."""
    steps = F.transform(
        F.slice("values", 2, F.size("values") - 1), lambda v, i: v - F.get("values", i)
    )
    return series.select("template_id", "since", steps.alias("diffs")).where(
        F.size(F.array_distinct("diffs")) > 1
    )


def chi2_survival(x: float, df: int) -> float:
    """P(X > x) for 1 to 5 degrees of freedom, in closed form."""
    if x <= 0:
        return 1.0
    half = math.exp(-x / 2)
    if df in (2, 4):
        return half * (1 if df == 2 else 1 + x / 2)
    extra = math.sqrt(2 * x / math.pi) * half
    return math.erfc(math.sqrt(x / 2)) + {1: 0.0, 3: extra, 5: extra * (1 + x / 3)}[df]


def _lags(x: np.ndarray, lag: int) -> np.ndarray:
    return np.column_stack([x[lag - k:len(x) - k] for k in range(1, lag + 1)])


def _residual(y: np.ndarray, x: np.ndarray) -> float:
    """Sum of squares that a least-squares fit leaves, by normal equations where they are sound."""
    try:
        left = y - x @ np.linalg.solve(x.T @ x, x.T @ y)
        sound = np.abs(x.T @ left).max() <= 1e-9 * max(1.0, float(y @ y))
    except np.linalg.LinAlgError:
        sound = False
    if not sound:
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(left @ left)


def granger_p_values(x: np.ndarray, y: np.ndarray, max_lag: int = MAX_LAG) -> list[float] | None:
    """p-values, per lag, of y helping to predict x; null where a test is impossible."""
    if len(x) <= 3 * max_lag + 1:
        return None
    out = []
    for lag in range(1, max_lag + 1):
        target, one = x[lag:], np.ones((len(x) - lag, 1))
        own, other = _lags(x, lag), _lags(y, lag)
        if (np.ptp(own, axis=0) == 0).any() or (np.ptp(other, axis=0) == 0).any():
            return None
        alone = _residual(target, np.hstack([own, one]))
        joint = _residual(target, np.hstack([own, other, one]))
        if joint <= 0:
            return None
        out.append(chi2_survival(len(target) * (alone - joint) / joint, lag))
    return out


def _moments(x: np.ndarray, y: np.ndarray, max_lag: int) -> list[np.ndarray]:
    """For each lag p: sums of products of lagged series, as (series of x, series of y, p + 1, p + 1).

    One matrix product gives the sums over the places that the longest lag leaves; a
    shorter lag has a few places more, whose products are added.
    """
    n = x.shape[1]
    lagged = lambda z: np.stack([z[:, max_lag - k : n - k] for k in range(max_lag + 1)], 1)
    a, b = lagged(x), lagged(y)
    whole = (a.reshape(-1, n - max_lag) @ b.reshape(-1, n - max_lag).T).reshape(len(x), max_lag + 1, len(y), max_lag + 1)
    whole = whole.transpose(0, 2, 1, 3)
    out = [whole]
    for p in range(max_lag - 1, 0, -1):
        one, other = x[:, p::-1], y[:, p::-1]  # place p, at lags 0 to p
        out.append(out[-1][:, :, : p + 1, : p + 1] + np.einsum("ik,jl->ijkl", one, other))
    return out[::-1]


def _totals(x: np.ndarray, p: int) -> np.ndarray:
    """Sums of each series at lags 0 to p over the places that lag p leaves."""
    n = x.shape[1]
    return np.stack([x[:, p - k : n - k].sum(axis=1) for k in range(p + 1)], 1)


def _sound(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Series that are constant at none of the lags of any test."""
    n = x.shape[1]
    good = np.ones(len(x), bool)
    for p in range(1, max_lag + 1):
        for k in range(1, p + 1):
            good &= np.ptp(x[:, p - k : n - k], axis=1) > 0
    return good


def _left(gram: np.ndarray, target: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Sums of squares that stacked fits leave, by their normal equations; nan where those are not sound."""
    try:
        found = np.linalg.solve(gram, target[..., None])[..., 0]
    except np.linalg.LinAlgError:
        half = len(gram) // 2
        if not half:
            return np.full(square.shape, np.nan)
        return np.concatenate([_left(gram[c], target[c], square[c]) for c in (slice(half), slice(half, None))])
    left = square - (found * target).sum(axis=-1)
    error = np.abs((gram @ found[..., None])[..., 0] - target).max(axis=-1)
    return np.where((error <= 1e-9 * np.maximum(1.0, square)) & (left > 1e-9 * square), left, np.nan)


def granger_grid(
    x: np.ndarray, y: np.ndarray, wanted: np.ndarray | None = None, max_lag: int = MAX_LAG
) -> tuple[np.ndarray, np.ndarray]:
    """p-values (series of x, series of y, lag) of each y helping to predict each x, and which of the wanted pairs
    can be tested.

    All fits come from the lagged moments: for each lag the systems of all y against one x
    are solved in one call. Pairs whose systems are close to singular are fitted one by one.
    """
    n, found = x.shape[1], np.full((len(x), len(y), max_lag), np.nan)
    if n <= 3 * max_lag + 1:
        return found, np.zeros(found.shape[:2], bool)
    good = _sound(x, max_lag)[:, None] & _sound(y, max_lag)[None, :]
    if wanted is not None:
        good &= wanted
    xy = _moments(x, y, max_lag)
    xx, yy = ([np.stack(m)[:, 0, 0] for m in zip(*[_moments(s[None], s[None], max_lag) for s in z])] for z in (x, y))
    odd = np.zeros(found.shape[:2], bool)
    for p in range(1, max_lag + 1):
        places, tx, ty = n - p, _totals(x, p), _totals(y, p)
        # Regressors: x at lags 1 to p, one, y at lags 1 to p.
        own = np.empty((len(x), p + 1, p + 1))
        own[:, :p, :p] = xx[p - 1][:, 1:, 1:]
        own[:, :p, p] = own[:, p, :p] = tx[:, 1:]
        own[:, p, p] = places
        reached = np.concatenate([xx[p - 1][:, 1:, 0], tx[:, :1]], 1)
        square = xx[p - 1][:, 0, 0]
        alone = _left(own, reached, square)
        for i in range(len(x)):
            gram = np.empty((len(y), 2 * p + 1, 2 * p + 1))
            gram[:, : p + 1, : p + 1] = own[i]
            gram[:, p + 1 :, p + 1 :] = yy[p - 1][:, 1:, 1:]
            across = np.concatenate([xy[p - 1][i][:, 1:, 1:], ty[:, None, 1:]], 1)
            gram[:, : p + 1, p + 1 :] = across
            gram[:, p + 1 :, : p + 1] = across.transpose(0, 2, 1)
            target = np.concatenate([np.broadcast_to(reached[i], (len(y), p + 1)), xy[p - 1][i][:, 0, 1:]], 1)
            at = np.flatnonzero(good[i])
            if not len(at):
                continue
            joint = _left(gram[at], target[at], np.full(len(at), square[i]))
            statistic = places * (alone[i] - joint) / joint
            odd[i, at] |= np.isnan(statistic)
            found[i, at, p - 1] = [chi2_survival(s, p) if s == s else np.nan for s in statistic.tolist()]
    for i, j in zip(*np.nonzero(odd)):
        values = granger_p_values(x[i], y[j], max_lag)
        good[i, j] = values is not None
        found[i, j] = values or np.nan
    return found, good


def granger_pairs(
    diffs: DataFrame, top_k: int | None = TOP_PAIRS, both_ways: bool = False, block: int = BLOCK
) -> DataFrame:
    """Significant pairs by smallest p-value: the first template is the one seen
    earlier, and the second helps to predict it.

    Series are put in even blocks, and each pair of blocks is one group of at
    most two blocks; a group returns significant pairs only, its top_k best if
    a limit is asked for.
    """
    series = materialize(diffs, "series")
    blocks = max(1, math.ceil(series.count() / block))
    own = F.pmod(F.xxhash64("template_id"), F.lit(blocks)).alias("own")
    cells = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("partner")
    placed = series.select("template_id", "since", "diffs", own, cells).select(
        "template_id", "since", "diffs", "own",
        F.least("own", "partner").alias("a"), F.greatest("own", "partner").alias("b"),
    )

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        sides = [pdf[pdf["own"] == side].sort_values(["since", "template_id"]) for side in ((a, b) if a != b else (a,))]
        ids = [side["template_id"].to_numpy() for side in sides]
        order = [list(zip(side["since"], side["template_id"])) for side in sides]
        values = [np.array(side["diffs"].tolist(), dtype=float) for side in sides]
        found = []
        for one, other in [(0, 0)] if a == b else [(0, 1), (1, 0)]:
            if not len(ids[one]) or not len(ids[other]):
                continue
            wanted = np.array([
                [x[1] != y[1] and (both_ways or x < y) for y in order[other]] for x in order[one]
            ])
            p, good = granger_grid(values[one], values[other], wanted)
            least = np.where(good, np.nan_to_num(p, nan=1.0).min(axis=2), 1.0)
            for i, j in zip(*np.nonzero(least < SIGNIFICANCE)):
                found.append((ids[one][i], ids[other][j], p[i, j].tolist(), least[i, j]))
        # A pair of blocks may have no significant pair at all.
        out = pd.DataFrame(found, columns=["first_id", "second_id", "p_values", "min_p"]).astype({"min_p": float})
        return out.nsmallest(top_k, "min_p", keep="all") if top_k else out

    tested = placed.groupBy("a", "b").applyInPandas(
        test, "first_id long, second_id long, p_values array<double>, min_p double"
    )
    ordered = tested.orderBy("min_p", "first_id", "second_id")
    return ordered.limit(top_k) if top_k else ordered


def causal_graph(pairs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): an edge leads from the helping template to the predicted one."""
    edges = pairs.select(F.col("second_id").alias("source"), F.col("first_id").alias("target"))
    ids = edges.select(F.explode(F.array("source", "target")).alias("template_id")).distinct()
    nodes = templates.join(ids, "template_id").select(
        F.col("template_id").alias("id"), F.col("rep_log").alias("label"), F.col("golden_signal").alias("gs")
    )
    return nodes, edges
