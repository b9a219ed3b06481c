"""Plain NumPy versions of the rule statistics, for small frames in tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

Z = 1.959963984540054


def kish(labels: pd.Series) -> float:
    c = labels.value_counts().to_numpy(float)
    return float(c.sum() ** 2 / (c**2).sum()) if len(c) else 0.0


def wilson(p: float, n: float) -> tuple[float, float]:
    if n <= 0:
        return 0.0, 1.0
    roots = np.roots([1 + Z * Z / n, -(2 * p + Z * Z / n), p * p]).real
    return max(0.0, roots.min()), min(1.0, roots.max())


def hac(x: np.ndarray, lag: int, clusters: int) -> float:
    if len(x) <= 1 or clusters <= 1:
        return 0.0
    lag = min(lag, len(x) - 1)
    i = np.arange(len(x))
    kernel = np.clip(1 - np.abs(i[:, None] - i[None, :]) / (lag + 1), 0, None)
    return math.sqrt(max(0.0, clusters / (clusters - 1) * float(x @ kernel @ x)))


def entity_error(x: pd.Series, entity: pd.Series) -> float:
    sums = x.groupby(entity).sum()
    g = len(sums)
    return math.sqrt(g / (g - 1) * float((sums**2).sum())) if g > 1 else 0.0


def evidence(df: pd.DataFrame, mask: pd.Series, base: pd.Series, target: float, lag: int) -> dict:
    seen = df.forward_return.notna()
    sel, bas = df[mask & seen], df[base & seen]
    hit = (df.forward_return > target).astype(float)
    days = sorted(df.session.unique())
    p, pb = hit[sel.index].mean(), hit[bas.index].mean()

    def interval(rows, rate):
        if rows.session.nunique() <= 1:
            return 0.0, 1.0, 0.0
        x = (hit[rows.index] - rate) / len(rows)
        by_day = x.groupby(rows.session).sum().reindex(days, fill_value=0.0)
        error = max(hac(by_day.to_numpy(), lag, rows.session.nunique()), entity_error(x, rows.entity))
        d, e = wilson(rate, kish(rows.session)), wilson(rate, kish(rows.entity))
        return (
            min(max(0.0, rate - Z * error), d[0], e[0]),
            max(min(1.0, rate + Z * error), d[1], e[1]),
            error,
        )

    low, high, error = interval(sel, p)
    b_low, b_high, _ = interval(bas, pb)
    matched, eligible = int(mask.sum()), int(base.sum())
    positive, b_positive = int(hit[sel.index].sum()), int(hit[bas.index].sum())
    lost, b_lost = matched - len(sel), eligible - len(bas)
    low, high = min(low, positive / matched), max(high, (positive + lost) / matched)
    b_low = min(b_low, b_positive / eligible)
    b_high = max(b_high, (b_positive + b_lost) / eligible)
    x = mask[bas.index] * (hit[bas.index] - p) / len(sel) - (hit[bas.index] - pb) / len(bas)
    by_day = x.groupby(bas.session).sum().reindex(days, fill_value=0.0)
    lift_error = 0.0
    if bas.session.nunique() > 1:
        lift_error = max(hac(by_day.to_numpy(), lag, bas.session.nunique()), entity_error(x, bas.entity))
    r = sel.forward_return
    return {
        "sample_count": len(sel),
        "matched_sample_count": matched,
        "eligible_sample_count": eligible,
        "win_rate": p,
        "baseline_win_rate": pb,
        "mean_return": r.mean(),
        "median_return": r.median(),
        "return_p05": r.quantile(0.05),
        "return_std": r.std(ddof=0),
        "win_rate_lift": p - pb,
        "effective_trading_day_count": kish(sel.session),
        "effective_security_count": kish(sel.entity),
        "max_security_event_share": sel.entity.value_counts().max() / len(sel),
        "max_signal_date_event_share": sel.session.value_counts().max() / len(sel),
        "cluster_standard_error": error,
        "lift_standard_error": lift_error,
        "confidence_lower": low,
        "confidence_upper": high,
        "lift_confidence_lower": max(-1.0, min(p - pb - Z * lift_error, low - b_high)),
        "lift_confidence_upper": min(1.0, max(p - pb + Z * lift_error, high - b_low)),
        "outcome_robust_lift_lower": positive / matched - (b_positive + b_lost - lost) / eligible,
        "outcome_robust_lift_upper": (positive + lost) / matched - (b_positive + lost) / eligible,
    }
