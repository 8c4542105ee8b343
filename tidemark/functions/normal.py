"""The complementary error function, natively: Cody's rational approximations as SQL text and in numpy.

The SQL text is valid in Spark and in DuckDB, which both lack ``erfc``.
"""

from __future__ import annotations

import numpy as np

# Coefficients of W. J. Cody, "Rational Chebyshev approximations for the error function" (1969), as in CALERF.
A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
INV_SQRT_PI, SQRT_HALF, INV_SQRT_2PI = 0.56418958354775628695, 0.70710678118654752440, 0.39894228040143267794


def _ratio(top, bottom, lead, x):
    """The two polynomials of a quotient, Horner's rule from ``lead * x`` and ``x``; works on numbers, arrays and SQL text."""
    num, den = lead * x, x
    for a, b in zip(top[:-1], bottom[:-1], strict=True):
        num, den = (num + a) * x, (den + b) * x
    return (num + top[-1]) / (den + bottom[-1])


class _Sql:
    """Builds SQL text by Python arithmetic."""

    def __init__(self, text: str):
        self.text = text

    @staticmethod
    def of(v) -> str:
        return v.text if isinstance(v, _Sql) else f"{v!r}e0" if "e" not in repr(v) else repr(v)

    def _op(self, op: str, v, swap: bool = False) -> _Sql:
        a, b = (self.of(v), self.text) if swap else (self.text, self.of(v))
        return _Sql(f"({a} {op} {b})")

    __add__ = lambda s, v: s._op("+", v)
    __radd__ = lambda s, v: s._op("+", v, True)
    __mul__ = lambda s, v: s._op("*", v)
    __rmul__ = lambda s, v: s._op("*", v, True)
    __truediv__ = lambda s, v: s._op("/", v)
    __rsub__ = lambda s, v: s._op("-", v, True)


def erfc_sql(x: str) -> str:
    """SQL for erfc of a column or short expression."""
    y, raw = _Sql(f"abs({x})"), _Sql(f"({x})")
    sq, inv = _Sql(f"({x} * {x})"), _Sql(f"(1e0 / ({x} * {x}))")
    small = 1.0 - raw * _ratio(A[:4], B, A[4], sq)
    middle = _ratio(C[:8], D, C[8], y)
    far = (INV_SQRT_PI - inv * _ratio(P[:5], Q, P[5], inv)) / y
    tail = f"exp(-({x} * {x})) * (CASE WHEN abs({x}) <= 4e0 THEN {middle.text} ELSE {far.text} END)"
    return f"(CASE WHEN abs({x}) <= 0.46875e0 THEN {small.text} WHEN {x} > 26.5e0 THEN 0e0 WHEN {x} < -26.5e0 THEN 2e0 WHEN {x} > 0e0 THEN {tail} ELSE 2e0 - {tail} END)"


def cdf_sql(x: str) -> str:
    """SQL for the normal distribution function of a column."""
    return f"(0.5e0 * {erfc_sql(f'({x} * {-SQRT_HALF!r}e0)')})"


def pdf_sql(x: str) -> str:
    return f"({INV_SQRT_2PI!r}e0 * exp(-0.5e0 * {x} * {x}))"


def erfc(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = np.abs(x)
    near, mid, far = y <= 0.46875, (y > 0.46875) & (y <= 4), y > 4
    out = np.zeros_like(y)
    out[near] = 1 - x[near] * _ratio(A[:4], B, A[4], x[near] ** 2)
    with np.errstate(under="ignore"):
        out[mid] = np.exp(-(y[mid] ** 2)) * _ratio(C[:8], D, C[8], y[mid])
        inv = 1 / y[far] ** 2
        out[far] = np.exp(-(y[far] ** 2)) * (INV_SQRT_PI - inv * _ratio(P[:5], Q, P[5], inv)) / y[far]
    return np.where(near | (x > 0), out, 2 - out)


def cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) * SQRT_HALF)
