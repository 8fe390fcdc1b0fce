"""Chi-square tail probabilities (pure Python; no Spark import)."""

from __future__ import annotations

import math



def chi2_sf(x: float, dof: int) -> float:
    """Upper tail P(X > x) of the chi-square distribution with integer dof.

    Closed forms of the regularised upper incomplete gamma Q(dof/2, x/2):
    even dof give a finite Poisson sum, odd dof add terms to erfc.
    """
    if dof is None or x is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    dof = int(dof)
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        total = 0.0
        for i in range(dof // 2):
            total += math.exp(-h + i * math.log(h) - math.lgamma(i + 1))
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    for i in range((dof - 1) // 2):
        total += math.exp(-h + (i + 0.5) * math.log(h) - math.lgamma(i + 1.5))
    return min(1.0, total)


def chi2_isf(alpha: float, dof: int) -> float:
    """x with chi2_sf(x, dof) = alpha, by bisection (monotone in x)."""
    lo, hi = 0.0, 1.0
    while chi2_sf(hi, dof) > alpha:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if chi2_sf(mid, dof) > alpha:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0
