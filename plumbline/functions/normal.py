"""The normal distribution and its inverse as column expressions, and the same as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the distribution, from the highest power down.
HART_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_END, ROOT_TWO_PI = 7.07106781186547, 2.506628274631000502
# Wichura's AS 241 for the inverse: centre, tail and far tail, from the highest power down.
CENTRE_UP = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
CENTRE_DOWN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
TAIL_UP = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
TAIL_DOWN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
FAR_UP = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
FAR_DOWN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def polynomial(x: Column, down: tuple[float, ...]) -> Column:
    """The polynomial with these coefficients, from the highest power down."""
    out = F.lit(down[0])
    for c in down[1:]:
        out = out * x + c
    return out


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once however often f names it: nested polynomials of a long expression would grow too large
    to compile."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution's probability up to x; missing stays missing."""
    return bound(x, _cdf)


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * polynomial(a, HART_UP) / polynomial(a, HART_DOWN)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_TWO_PI
    tail = F.when(a > 37, 0.0).when(a < HART_END, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_inverse(p: Column) -> Column:
    """The x up to which the standard normal distribution has probability p; missing unless 0 < p < 1."""
    return bound(p, _inverse)


def _inverse(p: Column) -> Column:
    q = p - 0.5
    ratio = lambda up, down: lambda x: polynomial(x, up) / polynomial(x, down)
    centre = q * bound(0.180625 - q * q, ratio(CENTRE_UP, CENTRE_DOWN))
    side = F.when(q <= 0, p).otherwise(1 - p)
    size = bound(F.sqrt(-F.ln(side)), lambda r: F.when(r <= 5, bound(r - 1.6, ratio(TAIL_UP, TAIL_DOWN))).otherwise(bound(r - 5.0, ratio(FAR_UP, FAR_DOWN))))
    value = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -size).otherwise(size)
    return F.when((p > 0) & (p < 1), value)


def polynomial_sql(x: str, down: tuple[float, ...]) -> str:
    out = repr(down[0]) + "::DOUBLE"
    for c in down[1:]:
        out = f"({out} * ({x}) + {c!r}::DOUBLE)"
    return out


def normal_cdf_sql(x: str) -> str:
    """normal_cdf() of a SQL expression, for the SQL that queries are compared with."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {polynomial_sql(a, HART_UP)} / {polynomial_sql(a, HART_DOWN)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / {ROOT_TWO_PI}::DOUBLE"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < {HART_END} THEN {near} ELSE {far} END"
    return f"CASE WHEN ({x}) > 0 THEN 1 - ({tail}) ELSE {tail} END"


def normal_inverse_sql(p: str) -> str:
    """normal_inverse() of a SQL expression."""
    q, r = f"(({p}) - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - ({p}))))"
    c = f"(0.180625::DOUBLE - {q} * {q})"
    centre = f"{q} * {polynomial_sql(c, CENTRE_UP)} / {polynomial_sql(c, CENTRE_DOWN)}"
    tail = f"{polynomial_sql(f'{r} - 1.6', TAIL_UP)} / {polynomial_sql(f'{r} - 1.6', TAIL_DOWN)}"
    far = f"{polynomial_sql(f'{r} - 5', FAR_UP)} / {polynomial_sql(f'{r} - 5', FAR_DOWN)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * (CASE WHEN {r} <= 5 THEN {tail} ELSE {far} END) END"
