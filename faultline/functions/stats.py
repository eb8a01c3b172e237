"""Tail probabilities for test statistics (ST2, ST4).

Spark has no distribution functions. The tails are the regularized
incomplete beta (Student t of a correlation) and gamma (chi-square)
functions, computed with the standard series and continued fractions.
They run on already aggregated rows (one per column pair or category) as
JVM Column expressions: a Lanczos log-gamma and a bounded ``aggregate`` over
``sequence`` for the iterations, so no Python worker is involved. The plain
Python functions below are the same methods, used as the test reference.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-15
_TINY = 1e-300
_MAX_ITER = 10000


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_MAX_ITER):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_fraction(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_upper(x: float, df: float) -> float:
    """P(X > x) for a chi-square variable with df degrees of freedom."""
    if x is None or df is None or not (df > 0) or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    if y < a + 1.0:
        return max(0.0, 1.0 - _gamma_p_series(a, y))
    return _gamma_q_fraction(a, y)


def _beta_fraction(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_ITER):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_regularized(x: float, a: float, b: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def corr_p_value(r: float, n: float) -> float:
    """ST2: two-sided p of a correlation r over n rows, Student t with df n-2.

    t = r*sqrt((n-2)/(1-r^2)) and P(|T|>t) = I_{df/(df+t^2)}(df/2, 1/2); the
    beta argument simplifies to 1 - r^2. |r| = 1 gives 0. Fewer than 5 rows or
    an undefined r give NaN (reported as NULL)."""
    if r is None or n is None or math.isnan(r) or n < 5:
        return float("nan")
    df = n - 2.0
    x = max(0.0, 1.0 - r * r)
    return beta_regularized(x, df / 2.0, 0.5)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# ---------------------------------------------------------------------------
# JVM forms of the same tails (no Python worker): Column expressions built
# from Spark's math functions and a bounded ``aggregate`` over ``sequence``.

# Lanczos approximation (g = 7, 9 terms), the standard published coefficients.
_LANCZOS_G = 7.0
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
            1.5056327351493116e-7]


def _steps(size: str) -> str:
    """Steps after which series and fractions of these tails have converged:
    both need a multiple of the square root of the larger parameter."""
    return f"sequence(1, CAST(200 + 12 * sqrt({size}) AS INT))"


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _lgamma_sql(x: str) -> str:
    """log Gamma(x) for x >= 0.5 (Lanczos), as SQL text."""
    xm1 = f"(({x}) - 1D)"
    terms = " + ".join([_d(_LANCZOS[0])] + [f"{_d(c)} / ({xm1} + {float(i)!r}D)" for i, c in enumerate(_LANCZOS) if i])
    t = f"({xm1} + {_d(_LANCZOS_G + 0.5)})"
    return f"({_d(0.5 * math.log(2 * math.pi))} + ({xm1} + 0.5D) * ln({t}) - {t} + ln({terms}))"


def _clamp_sql(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {_d(_TINY)} THEN {_d(_TINY)} ELSE {v} END)"


def _let(bindings: dict, body: str) -> str:
    """Bind named values once (Spark SQL has no LET): a one-element
    ``transform`` whose lambda sees them as ``v.<name>``."""
    fields = ", ".join(f"'{k}', {e}" for k, e in bindings.items())
    return f"element_at(transform(array(named_struct({fields})), v -> {body}), 1)"


def _beta_cf_sql(a: str, b: str, x: str) -> str:
    """Continued fraction of I_x(a, b) (modified Lentz) as half-steps: step j
    uses the coefficient of level m = (j+1) div 2, the "even" form for odd j
    and the "odd" form for even j. Fixed step count; each step binds its
    coefficient and the new (c, d) once."""
    qab, qap, qam = f"({a} + {b})", f"({a} + 1D)", f"({a} - 1D)"
    d0 = f"(1D / {_clamp_sql(f'1D - {qab} * {x} / {qap}')})"
    m = "CAST((j + 1) div 2 AS DOUBLE)"
    coef = (f"(CASE WHEN j % 2 = 1 THEN {m} * ({b} - {m}) * {x} / (({qam} + 2D * {m}) * ({a} + 2D * {m})) "
            f"ELSE -({a} + {m}) * ({qab} + {m}) * {x} / (({a} + 2D * {m}) * ({qap} + 2D * {m})) END)")
    new_cd = (f"element_at(transform(array({coef}), k -> named_struct("
              f"'c', {_clamp_sql('1D + k / acc.c')}, 'd', 1D / {_clamp_sql('1D + k * acc.d')})), 1)")
    step = f"element_at(transform(array({new_cd}), w -> named_struct('c', w.c, 'd', w.d, 'h', acc.h * w.d * w.c)), 1)"
    return (f"aggregate({_steps(f"greatest({a}, {b})")}, named_struct('c', 1D, 'd', {d0}, 'h', {d0}), "
            f"(acc, j) -> {step}, acc -> acc.h)")


def _beta_regularized_sql(x: str, a: str, b: str) -> str:
    front = (f"exp({_lgamma_sql('v.a + v.b')} - {_lgamma_sql('v.a')} - {_lgamma_sql('v.b')} "
             f"+ v.a * ln(v.x) + v.b * log1p(-v.x))")
    direct = f"(v.f * {_beta_cf_sql('v.a', 'v.b', 'v.x')} / v.a)"
    mirrored = f"(1D - v.f * {_beta_cf_sql('v.b', 'v.a', '(1D - v.x)')} / v.b)"
    inner = _let({"x": "v.x", "x0": "v.x0", "a": "v.a", "b": "v.b", "f": front},
                 f"CASE WHEN v.x0 <= 0D THEN 0D WHEN v.x0 >= 1D THEN 1D "
                 f"WHEN v.x < (v.a + 1D) / (v.a + v.b + 2D) THEN {direct} ELSE {mirrored} END")
    return _let({"x": f"least(greatest({x}, 1e-300), {_d(1.0 - 1e-16)})", "x0": x, "a": a, "b": b}, inner)


def _name(c) -> str:
    if not isinstance(c, str):
        raise TypeError("pass a column name")
    return f"`{c}`"


def beta_regularized_col(x: str, a: str, b: str) -> Column:
    """I_x(a, b) for columns named x, a, b (same method as ``beta_regularized``)."""
    return F.expr(_beta_regularized_sql(f"CAST({_name(x)} AS DOUBLE)", f"CAST({_name(a)} AS DOUBLE)",
                                        f"CAST({_name(b)} AS DOUBLE)"))


def corr_p_value_col(r: str, n: str) -> Column:
    """ST2 in the JVM: I_{1-r^2}((n-2)/2, 1/2); NULL when r is NULL or n < 5.
    Built as SQL text: one parser call instead of hundreds of Column calls."""
    rc, nc = _name(r), f"CAST({_name(n)} AS DOUBLE)"
    a = f"(({nc} - 2D) / 2D)"
    return F.expr(f"(CASE WHEN {rc} IS NULL OR {nc} < 5D THEN CAST(NULL AS DOUBLE) "
                  f"WHEN abs({rc}) >= 1D THEN 0D "
                  f"ELSE {_beta_regularized_sql(f'(1D - {rc} * {rc})', a, '0.5D')} END)")


def chi2_upper_jvm(x: str, df: str) -> Column:
    """ST4 tail for any df in the JVM: regularized gamma by its series below
    a+1 and by its continued fraction above (Lentz), a = df/2, y = x/2."""
    xc, dc = f"CAST({_name(x)} AS DOUBLE)", f"CAST({_name(df)} AS DOUBLE)"
    a, ys = f"({dc} / 2D)", f"greatest({xc} / 2D, 1e-300)"
    prefix = f"exp(-{ys} + {a} * ln({ys}) - {_lgamma_sql(a)})"
    step_term = f"acc.term * {ys} / ({a} + CAST(k AS DOUBLE))"
    series = (f"aggregate({_steps(a)}, named_struct('term', 1D / {a}, 'total', 1D / {a}), "
              f"(acc, k) -> named_struct('term', {step_term}, 'total', acc.total + {step_term}), acc -> acc.total)")
    b0 = f"({ys} + 1D - {a})"
    an = f"(-CAST(i AS DOUBLE) * (CAST(i AS DOUBLE) - {a}))"
    d = f"(1D / {_clamp_sql(f'{an} * acc.d + acc.b + 2D')})"
    c = _clamp_sql(f"acc.b + 2D + {an} / acc.c")
    fraction = (f"aggregate({_steps(a)}, named_struct('c', {_d(1.0 / _TINY)}, "
                f"'d', 1D / {_clamp_sql(b0)}, 'h', 1D / {_clamp_sql(b0)}, 'b', {b0}), "
                f"(acc, i) -> named_struct('c', {c}, 'd', {d}, 'h', acc.h * {d} * {c}, 'b', acc.b + 2D), "
                f"acc -> acc.h)")
    upper = (f"(CASE WHEN {ys} < {a} + 1D THEN greatest(0D, 1D - {prefix} * {series}) "
             f"ELSE {prefix} * {fraction} END)")
    return F.expr(f"(CASE WHEN {xc} IS NULL OR {dc} IS NULL OR {dc} <= 0D THEN CAST(NULL AS DOUBLE) "
                  f"WHEN {xc} <= 0D THEN 1D ELSE {upper} END)")


def lgamma_col(x: str) -> Column:
    """log Gamma of a named column (x >= 0.5)."""
    return F.expr(_lgamma_sql(f"CAST({_name(x)} AS DOUBLE)"))
