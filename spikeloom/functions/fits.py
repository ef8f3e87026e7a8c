"""Small numeric kernels that SQL has no form for: least squares, the normal CDF, peak geometry."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def least_squares(model: Callable, p0, x, y, rounds: int = 60, tol: float = 1e-7) -> np.ndarray | None:
    """Levenberg-Marquardt with a numeric Jacobian; None if no finite fit is found."""
    p, lam = np.asarray(p0, float), 1e-3
    r = y - model(x, *p)
    cost = float(r @ r)
    if not np.isfinite(cost):
        return None
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-6)
        jac = np.stack([(model(x, *(p + step * (np.arange(len(p)) == i))) - model(x, *p)) / step[i] for i in range(len(p))], 1)
        if not np.isfinite(jac).all():
            return None
        a, g = jac.T @ jac, jac.T @ r
        for _ in range(30):
            try:
                d = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), g)
            except np.linalg.LinAlgError:
                lam *= 10
                continue
            new = y - model(x, *(p + d))
            c = float(new @ new)
            if np.isfinite(c) and c <= cost:
                done = cost - c <= tol * max(cost, 1e-30)
                p, r, cost, lam = p + d, new, c, max(lam / 10, 1e-12)
                break
            lam *= 10
        else:
            return p
        if done:
            return p
    return p


#: Steps of the batched Gaussian fit, at most; each either moves or raises its own damping. A fit ends
#: with a move that lessens its squares by less than this share.
GAUSSIAN_STEPS, GAUSSIAN_TOLERANCE = 100, 1e-4

#: Bits of each of the three whole numbers that squares are summed up in, exactly and in any order.
SQUARE_BITS = 31


def _libm(f: Callable, v: np.ndarray, *more) -> np.ndarray:
    """f of the C library value by value: NumPy's own exp and squares differ from it in the last digit."""
    return np.array(list(map(f, v.ravel().tolist(), *more)), float).reshape(v.shape)


def _total(v: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right."""
    return np.add.accumulate(v, axis=1)[:, -1]


def _squared(v: np.ndarray) -> np.ndarray:
    over = np.abs(v) > 1e154  # math.pow raises there
    return np.where(over, np.inf, _libm(math.pow, np.where(over, 0.0, v), itertools.repeat(2.0)))


def deviation(parts: list[np.ndarray], offset: np.ndarray, n: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Deviations of `amplitude.squares`, taken with the digits beyond a double's and rounded once."""
    n = np.asarray(n, np.longdouble)
    total = sum(np.asarray(h, np.longdouble) * np.longdouble(2) ** (-SQUARE_BITS * (i + 1)) for i, h in enumerate(parts))
    return (np.sqrt(np.maximum(total / n - (np.asarray(offset, np.longdouble) / n) ** 2, 0)) * np.asarray(scale, np.longdouble)).astype(float)


def cut_gaussians_missing(counts: np.ndarray, lefts: np.ndarray, width: np.ndarray, sd: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Percent of a Gaussian below its cut-off for each row of histograms, all fitted at once by damped least squares.

    The cut-off stays at its start, the 1st percentile: it has no gradient in the sum of
    squares, so only height, centre and width are fitted, from the 99th percentile of the
    counts, the fullest bin and the standard deviation. No finite fit: NaN.

    Some fits run off along a valley, and where they end hangs on the last digit of each step:
    sums, squares and powers are taken in the order and by the functions that SQL takes.
    """
    n, x = np.asarray(counts, float), np.asarray(lefts, float) + np.asarray(width, float)[:, None] / 2
    at = (x >= np.asarray(low, float)[:, None]).astype(float)
    rows, low = np.arange(len(n)), np.asarray(low, float)
    p = np.stack([np.percentile(n, 99, axis=1), x[rows, n.argmax(1)], np.asarray(sd, float)], 1)

    def model(p, x, at):
        d, s = x - p[:, 1:2], p[:, 2:]
        return d, p[:, :1] * _libm(math.exp, -_squared(d) / (2 * s * s)) * at

    with np.errstate(all="ignore"):
        d, f = model(p, x, at)
        cost, lam, going = _total(_squared(n - f)), np.full(len(n), 1e-3), np.arange(len(n))
        for _ in range(GAUSSIAN_STEPS):
            if not len(going):
                break
            # d and f are kept for the rows that go on
            q, a, s = p[going], p[going, :1], p[going, 2:]
            jac = (f / a, f * d / (s * s), f * d * d / (s * s * s))
            rest = n[going] - f
            damp = 1 + lam[going]
            m = [_total(jac[i] * jac[j]) * (damp if i == j else 1) for i in range(3) for j in range(i, 3)]
            step = _solve3(*m, *[_total(j * rest) for j in jac])
            new = q + step
            d2, f2 = model(new, x[going], at[going])
            c = _total(_squared(n[going] - f2))
            good = np.isfinite(new).all(1) & np.isfinite(c) & (c <= cost[going])
            done = good & (cost[going] - c <= GAUSSIAN_TOLERANCE * cost[going])
            p[going] = np.where(good[:, None], new, q)
            cost[going] = np.where(good, c, cost[going])
            lam[going] = np.where(good, np.maximum(lam[going] / 10, 1e-12), np.minimum(lam[going] * 10, 1e12))
            d, f = (np.where(good[:, None], u, v)[~done] for u, v in ((d2, d), (f2, f)))
            going = going[~done]
        z = np.where(np.isfinite(cost), (p[:, 1] - low) / np.abs(p[:, 2]), np.nan)
    return np.array([100 * (1 - norm_cdf(v)) if math.isfinite(v) else math.nan for v in z.tolist()])


def _solve3(a, b, c, d, e, f, x, y, z) -> np.ndarray:
    """Solutions of symmetric systems ((a b c) (b d e) (c e f)) by Cramer's rule; a singular one gives no finite numbers."""
    ca, cb, cc, cd, ce, cf = d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b
    det = a * ca + b * cb + c * cc
    return np.stack([ca * x + cb * y + cc * z, cb * x + cd * y + ce * z, cc * x + ce * y + cf * z], 1) / det[:, None]


def cut_gaussian_missing(counts, lefts, width, sd, low) -> float:
    """`cut_gaussians_missing` of one histogram; too few counts: NaN."""
    if not len(counts) or sum(counts) <= 5 or not sd:
        return math.nan
    return float(cut_gaussians_missing(np.array([counts]), np.array([lefts]), np.array([width]), np.array([sd]), np.array([low]))[0])


def exponential_slope(distances, values) -> float:
    """-m of A exp(m x) fitted from m = 0.1, A = 1 over a scaled distance; null input or no fit: NaN."""
    x, y = np.asarray(distances, float), np.asarray(values, float)
    if len(x) < 3 or not np.isfinite(y).all():
        return math.nan
    # a start in the falling direction reaches the same minimum as one from 0.1 and can't overflow
    fit = least_squares(lambda v, m, a: a * np.exp(np.clip(m * v, -700, 700)), (-0.01, 1.0), x, y)
    return math.nan if fit is None or not np.isfinite(fit).all() else -float(fit[0])


def peaks(w: np.ndarray, least: float) -> tuple[list[int], list[float], list[float]]:
    """(places, prominences, widths at half prominence) of local maxima that stand out by `least`.

    A plateau counts at its middle. Prominence is the height over the higher of the two lowest
    points on the way to higher ground or the end; NaN ends the way. The width is where the
    flanks cross half the prominence, interpolated linearly.
    """
    out: tuple[list, list, list] = ([], [], [])
    n, i = len(w), 1
    while i < n - 1:
        j = i
        while j < n - 1 and w[j + 1] == w[i]:
            j += 1
        if j < n - 1 and w[i - 1] < w[i] and w[j + 1] < w[i]:
            p = (i + j) // 2
            top = w[p]
            lows = []
            ends = []
            for step in (-1, 1):
                k, low, end = p, top, p
                while 0 <= k < n and w[k] <= top:
                    if w[k] < low:
                        low, end = w[k], k
                    k += step
                lows.append(low)
                ends.append(end)
            prom = top - max(lows)
            if prom >= least:
                half, sides = top - prom / 2, []
                for step, end in zip((-1, 1), ends, strict=True):
                    k = p
                    while k != end and half < w[k]:
                        k += step
                    at = float(k)
                    if w[k] < half:
                        at -= step * (half - w[k]) / (w[k - step] - w[k])
                    sides.append(at)
                out[0].append(p)
                out[1].append(float(prom))
                out[2].append(sides[1] - sides[0])
        i = j + 1
    return out


def safe_ratio(num: float | None, den: float | None) -> float:
    if not den:
        return math.inf
    return abs(num / den) if num else 0.0


def shape(wf, fs: float, share: float = 0.2, fallback: float = 0.015, masked: int | None = None) -> dict | None:
    """Peaks, troughs, widths, ratios and duration of a peak-channel template; an all-zero or empty one: None."""
    w = np.asarray(wf, float).copy()
    lead = masked if masked is not None else 24 if len(w) == 82 else 4
    w[:lead] = np.nan
    if len(w) <= lead + 2 or not np.nanmax(np.abs(w)):
        return None
    biggest = np.nanmax(np.abs(w))
    least = share * biggest

    def widest(found):
        return found[2][int(np.argmax(found[1]))] if found[0] else math.nan

    low = peaks(-w, least)
    trough_width, sizes = widest(low), [-w[i] for i in low[0]]
    if low[0]:
        trough = low[0][int(np.argmax(sizes))]
    else:  # the global minimum, with its sign
        trough = int(np.nanargmin(w))
        low, sizes = ([trough], [0.0], [math.nan]), [w[trough]]

    def side(part: np.ndarray, offset: int):
        """(places, sizes, width, forced)"""
        usable = len(part) > 3
        found = peaks(part, least) if usable else ([], [], [])
        if found[0]:
            return [p + offset for p in found[0]], [part[p] for p in found[0]], widest(found), False
        found = peaks(part, fallback * biggest) if usable else ([], [], [])
        if found[0]:
            k = int(np.argmax(found[1]))
            return [found[0][k] + offset], [part[found[0][k]]], found[2][k], True
        if not len(part) or np.isnan(part).all():
            return [offset], [0.0], math.nan, True
        k = int(np.nanargmax(part))
        return [k + offset], [part[k]], math.nan, True

    before, after = side(w[:trough], 0), side(w[trough:], trough)
    forced_b, forced_a = before[3], after[3]
    if forced_b and forced_a:
        forced_b, forced_a = (False, True) if before[1][0] > after[1][0] else (True, False)
        # the larger one isn't treated as forced any more
    size_b, size_a, size_t = max(map(abs, before[1])), max(map(abs, after[1])), max(sizes)
    if forced_b and size_b < least / 2:
        places = after[0]
    elif forced_a and size_a < least / 2:
        places = before[0]
    else:
        places = before[0] + after[0]
    at = int(np.nanargmax(np.abs(w)))
    other = at + int(np.nanargmin(w[at:]) if w[at] > 0 else np.nanargmax(w[at:]))
    return {
        "n_peaks": len(places), "n_troughs": len(sizes), "duration_us": 1e6 * abs(at - other) / fs, "peak_before_width": before[2], "trough_width": trough_width,
        "second_peak_to_trough": safe_ratio(size_a, size_t), "peak1_to_peak2": safe_ratio(size_b, size_a), "main_peak_to_trough": safe_ratio(max(size_b, size_a), size_t),
        "trough_to_peak2": safe_ratio(size_t, size_b), "peak_places": [int(p) for p in places], "trough_places": [int(p) for p in low[0]],
    }
