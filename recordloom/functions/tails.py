"""Tail probabilities of one already computed test statistic."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_upper(x: float, dof: int) -> float:
    """P(X >= x): closed sums over half-integer steps of the gamma function."""
    if x <= 0:
        return 1.0
    half = x / 2
    if dof % 2:
        total, start = math.erfc(math.sqrt(half)), 0.5
    else:
        total, start = math.exp(-half), 1.0
    shape = start
    while shape < dof / 2 - 0.25:
        total += math.exp(shape * math.log(half) - half - math.lgamma(shape + 1))
        shape += 1
    return min(total, 1.0)


_STEPS = 100_000
# Beyond these degrees the gamma differences below lose digits; the tail is normal by then.
_NORMAL_DOF = 1e7


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz's method)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_ratio(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    value = c = 1.0
    d = 0.0
    for step in range(_STEPS):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            return front * (value - 1.0)
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def t_two_sided(t: float, dof: float) -> float:
    if dof >= _NORMAL_DOF:
        # First correction term of the expansion in 1 / dof.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return normal_two_sided(t) + density * (abs(t) ** 3 + abs(t)) / (2 * dof)
    return _beta_ratio(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, dof_between: float, dof_within: float) -> float:
    if f <= 0:
        return 1.0
    if dof_between == 1:
        return t_two_sided(math.sqrt(f), dof_within)
    return _beta_ratio(dof_within / 2, dof_between / 2, dof_within / (dof_within + dof_between * f))
