"""The same functions on numpy arrays, for fits on the driver and inside pandas UDFs."""

from __future__ import annotations

import math

import numpy as np

SHIFT = 8
SERIES, FRACTION, SWITCH = 60, 60, 3.0


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y, product = x + SHIFT, x.copy()
    for k in range(1, SHIFT):
        product = product * (x + k)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360)))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + SHIFT
    below = sum(1 / (x + k) for k in range(SHIFT))
    r = 1 / (y * y)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760))))))
    return np.log(y) - 0.5 / y - series - below


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + SHIFT
    below = sum(1 / ((x + k) * (x + k)) for k in range(SHIFT))
    r = 1 / (y * y)
    series = r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66)))))
    return (1 + series) / y + 0.5 * r + below


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, with full relative accuracy in the lower tail; NaN for NaN."""
    z = np.asarray(z, float)
    a = np.abs(z)
    square = z * z
    density = np.exp(-square / 2) / math.sqrt(2 * math.pi)
    near = a < SWITCH
    inner = np.ones_like(z)
    for k in range(SERIES, 0, -1):
        inner = 1 + np.where(near, square, 0) / (2 * k + 1) * inner
    fraction = far = np.where(near, SWITCH, a)
    for k in range(FRACTION, 0, -1):
        fraction = far + k / fraction
    tail = density / fraction
    return np.where(near, 0.5 + density * z * inner, np.where(z < 0, tail, 1 - tail))


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function, by series below a + 1 and by continued fraction above."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.zeros(a.shape)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - lgamma(a))
    low = (x > 0) & (x < a + 1)
    high = x >= a + 1
    if low.any():
        aa, xx = a[low], x[low]
        term = total = 1 / aa
        k = aa.copy()
        while np.any(term > total * 1e-17):
            k = k + 1
            term = term * xx / k
            total = total + term
        out[low] = total * front[low]
    if high.any():
        aa, xx = a[high], x[high]
        tiny = 1e-300
        b = xx + 1 - aa
        c = np.full(b.shape, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1)


def mixture_quantile(p: float, w: np.ndarray, a1, b1, a2, b2) -> np.ndarray:
    """The quantile of a mixture of two gamma distributions (weight w, shapes a, rates b), by bisection."""
    w, a1, b1, a2, b2 = (np.asarray(v, float) for v in np.broadcast_arrays(w, a1, b1, a2, b2))

    def cdf(x: np.ndarray) -> np.ndarray:
        return w * gamma_p(a1, b1 * x) + (1 - w) * gamma_p(a2, b2 * x)

    low, high = np.zeros(w.shape), np.ones(w.shape)
    while np.any(short := cdf(high) < p):
        high = np.where(short, high * 2, high)
    for _ in range(200):
        middle = (low + high) / 2
        below = cdf(middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        if np.all(high - low <= 1e-12 * np.maximum(high, 1e-12)):
            break
    return (low + high) / 2


def hypergeom_pmf(k, total, successes, draws) -> np.ndarray:
    k, total, successes, draws = (np.asarray(v, float) for v in (k, total, successes, draws))

    def choose(n, r):
        return lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)

    ok = (k >= 0) & (k <= successes) & (k <= draws) & (draws - k <= total - successes)
    with np.errstate(all="ignore"):
        p = np.exp(choose(successes, k) + choose(total - successes, draws - k) - choose(total, draws))
    return np.where(ok, p, 0.0)


def hypergeom_upper(k, total, successes, draws) -> np.ndarray:
    """P(X >= k): sums outward from the mode's side, by the ratio of neighbouring probabilities."""
    k, total, successes, draws = (np.array(v, float) for v in np.broadcast_arrays(k, total, successes, draws))
    mean = successes * draws / np.maximum(total, 1)
    up = k > mean
    # Upwards from k, or 1 minus what lies downwards from k - 1.
    at = np.where(up, k, k - 1)
    term = hypergeom_pmf(at, total, successes, draws)
    sums = term.copy()
    live = term > 0
    while live.any():
        x = at[live]
        t, s, d, u = total[live], successes[live], draws[live], up[live]
        more = (s - x) * (d - x) / ((x + 1) * (t - s - d + x + 1))
        with np.errstate(all="ignore"):
            less = x * (t - s - d + x) / ((s - x + 1) * (d - x + 1))
        ratio = np.where(u, more, less)
        term[live] = term[live] * np.where(np.isfinite(ratio) & (ratio > 0), ratio, 0)
        at[live] = x + np.where(u, 1, -1)
        sums[live] += term[live]
        live &= term > sums * 1e-18
    out = np.where(up, sums, 1 - sums)
    out = np.where(k <= np.maximum(0, draws - (total - successes)), 1.0, out)
    return np.clip(out, 0, 1)


def t_quantile(p: float, df: float) -> float:
    """The quantile of Student's t distribution, by bisection on its distribution function."""

    def beta_part(x: float, a: float, b: float) -> float:
        # Regularised incomplete beta by its continued fraction.
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta_part(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 1000):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                      -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + n * d)
                c = 1 + n / c
                h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return front * h

    def cdf(t: float) -> float:
        tail = beta_part(df / (df + t * t), df / 2, 0.5) / 2
        return 1 - tail if t > 0 else tail

    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2
