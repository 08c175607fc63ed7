"""SetSketch: registers of exponentially spaced truncated minima, and joint estimation from them.

Register i holds floor(1 - log_b(h_i)), cut to 0..q+1, where h_i is the least of the exponential
variates that the set's elements take there. Registers of a union are the larger of the two, so
sketches merge; two sets agree on a register with about their Jaccard similarity when b is near 1.
"""

from __future__ import annotations

import numpy as np

from ridgeline.llm.textblocks import U, mix

B, A, Q = 1.001, 20.0, 2**16 - 2
_SEEDS = np.random.default_rng(77).integers(1, 2**63, 1024, dtype=np.uint64)


def registers(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """A row of m registers (uint16) for each of the sets elements[bounds[i]:bounds[i+1]]."""
    n = len(bounds) - 1
    least = np.full((m, n), 2**64 - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at, tmp = bounds[full], np.empty(len(elements), np.uint64)
        for i in range(m):
            np.bitwise_xor(elements, _SEEDS[i], out=tmp)
            np.multiply(tmp, _SEEDS[m + i] | U(1), out=tmp)
            least[i, full] = np.minimum.reduceat(tmp, at)
    u = (least.T.astype(np.float64) + 1.0) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    return np.clip(np.floor(1.0 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of neighbouring registers, different between bands."""
    n, m = regs.shape
    rows = m // bands
    parts = regs[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + U(1), (n, bands)).copy()
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _log_p(x: np.ndarray) -> np.ndarray:
    """p_b: the chance that a register differs in one direction, at least tiny."""
    return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12)


def joint(above: np.ndarray, below: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of two sets of known sizes, and how far it is from `at`.

    above, below, equal: numbers of registers where the first sketch is larger, smaller, the same.
    The second value is twice the log-likelihood ratio of the estimate against `at`.
    """
    total = na + nb
    u, v = na / total, nb / total
    most = np.minimum(u / v, v / u)

    def loglik(j: np.ndarray) -> np.ndarray:
        p, q = _log_p(u - v * j), _log_p(v - u * j)
        return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    lo, hi = np.zeros_like(most), most.copy()
    for _ in range(steps // 2):  # concave: golden sections close in on the maximum
        x, y = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        left = loglik(x) > loglik(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    best = (lo + hi) / 2
    return best, 2 * (loglik(best) - loglik(np.minimum(at, most)))


def worth_verifying(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float, doubt: float = 36.0) -> np.ndarray:
    """Pairs that the likelihood does not rule out at six standard deviations, by sizes and registers."""
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    keep = np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9
    at = np.flatnonzero(keep)
    if len(at):
        x, y = a[at], b[at]
        above, below = (x > y).sum(1), (x < y).sum(1)
        best, far = joint(above, below, x.shape[1] - above - below, na[at], nb[at], similarity, 40)
        keep[at] = (best >= similarity) | (far <= doubt)
    return keep
