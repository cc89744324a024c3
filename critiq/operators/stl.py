"""Robust STL decomposition (Cleveland, Cleveland, McRae & Terpenning, 1990)
as a grouped pandas function: every series is one group, so many series
decompose in parallel and one series is one small task (a few hundred
monthly points at most).

Defaults for period 12: seasonal span 7, trend span 23, low-pass span 13,
local-linear fits, 2 inner and 15 robustness iterations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def default_spans(period: int, seasonal: int = 7) -> tuple[int, int, int]:
    trend = _odd(1.5 * period / (1.0 - 1.5 / seasonal))
    low_pass = _odd(period + 1) if period % 2 == 0 else _odd(period)
    return seasonal, trend, low_pass


def loess(y: np.ndarray, span: int, rw: np.ndarray, xs: np.ndarray, degree: int = 1) -> np.ndarray:
    """Local (linear) regression of y on 0..n-1, evaluated at every point of
    ``xs`` at once; tricube neighbourhood weights of the ``span`` nearest
    points times the robustness weights ``rw``."""
    n = len(y)
    x = np.arange(n, dtype=float)
    xs = np.asarray(xs, dtype=float)
    d = np.abs(xs[:, None] - x[None, :])
    if span <= n:
        h = np.partition(d, span - 1, axis=1)[:, span - 1]
    else:
        h = d.max(axis=1) + (span - n) / 2.0
    h = np.maximum(h, 1e-12)
    u = d / h[:, None]
    w = np.where(u < 1.0, (1.0 - u ** 3) ** 3, 0.0) * rw[None, :]
    sw = w.sum(axis=1)
    w = w / np.where(sw > 0.0, sw, 1.0)[:, None]
    if degree >= 1:
        a = (w * x[None, :]).sum(axis=1)
        dx = x[None, :] - a[:, None]
        b = (w * dx ** 2).sum(axis=1)
        ok = np.sqrt(b) > 1e-3 * (n - 1)
        adj = dx * (xs - a)[:, None] / np.where(ok, b, 1.0)[:, None] + 1.0
        w = np.where(ok[:, None], w * adj, w)
    out = (w * y[None, :]).sum(axis=1)
    empty = sw <= 0.0
    if empty.any():
        out[empty] = y[np.argmin(d[empty], axis=1)]
    return out


def _moving_average(v: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], v]))
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int = 12, seasonal: int = 7, robust: bool = True,
        inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return (trend, seasonal, residual) of ``y``."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    ns, nt, nl = default_spans(period, seasonal)
    trend = np.zeros(n)
    season = np.zeros(n)
    rw = np.ones(n)
    for it in range(outer + 1 if robust else 1):
        for _ in range(inner):
            det = y - trend
            c = np.empty(n + 2 * period)
            for k in range(period):
                sub = det[k::period]
                m = len(sub)
                if m == 0:
                    continue
                sm = loess(sub, ns, rw[k::period], np.arange(-1, m + 1, dtype=float))
                c[k::period][: m + 2] = sm
            low = _moving_average(_moving_average(_moving_average(c, period), period), 3)
            low = loess(low, nl, np.ones(n), np.arange(n, dtype=float))
            season = c[period: period + n] - low
            trend = loess(y - season, nt, rw, np.arange(n, dtype=float))
        if not robust or it == outer:
            break
        r = np.abs(y - season - trend)
        h = 6.0 * np.median(r)
        u = r / h if h > 0 else np.zeros(n)
        rw = np.where(u < 1.0, (1.0 - u ** 2) ** 2, 0.0)
    return trend, season, y - season - trend


def stl_grouped(monthly: DataFrame, key: str | None = None, period: int = 12) -> DataFrame:
    """Decompose every series of (key, year_month, count, avg_score)."""
    k = key or "_series"
    src = monthly if key else monthly.withColumn(k, F.lit(0))
    key_type = src.schema[k].dataType.simpleString()

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year_month").reset_index(drop=True)
        t, s, r = stl(pdf["count"].to_numpy(dtype=float), period=period)
        return pdf.assign(trend=t, seasonal=s, residual=r, method="STL")

    schema = (f"{k} {key_type}, year_month string, count long, avg_score double, "
              "trend double, seasonal double, residual double, method string")
    # The month table is tiny, so adaptive execution would gather it in one or
    # two tasks, but each series costs real CPU: the session's shuffle partitions
    # are asked for by number, which it leaves as they are, and which also
    # serve the grouping (no second exchange).
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.select(k, "year_month", "count", "avg_score").repartition(parts, k)
    out = src.groupBy(k).applyInPandas(fn, schema)
    return out if key else out.drop(k)
