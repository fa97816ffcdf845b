"""The inverse normal distribution function, which Spark lacks, and d'.

Wichura's rational approximations (algorithm AS 241, 16 digits), as an expression that stays in generated code, and the same in
SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-6

# fixed values: the published coefficients, lowest power first; numerator and denominator for the middle, the sides, the far ends
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
SIDE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _double(x: float) -> str:
    """A number that any SQL reads as a double."""
    text = repr(float(x))
    return text.replace("e", "E") if "e" in text else text + "E0"


def _ratio(tables: tuple[tuple[float, ...], tuple[float, ...]], r: str) -> str:
    def polynomial(c: tuple[float, ...]) -> str:
        out = _double(c[-1])
        for x in reversed(c[:-1]):
            out = f"({out} * {r} + {_double(x)})"
        return out

    return f"({polynomial(tables[0])} / {polynomial(tables[1])})"


def clipped_sql(p: str) -> str:
    return f"least(greatest({p}, {_double(CLIP)}), {_double(1 - CLIP)})"


def quantile_sql(p: str) -> str:
    """The quantile of a double expression, in SQL; null unless it lies between 0 and 1."""
    q, tail = f"({p} - 0.5E0)", f"sqrt(-ln(least({p}, 1E0 - {p})))"
    middle = f"{q} * {_ratio(MIDDLE, f'(0.180625E0 - {q} * {q})')}"
    side = f"CASE WHEN {tail} <= 5E0 THEN {_ratio(SIDE, f'({tail} - 1.6E0)')} ELSE {_ratio(FAR, f'({tail} - 5E0)')} END"
    return f"CASE WHEN {p} > 0E0 AND {p} < 1E0 THEN CASE WHEN abs({q}) <= 0.425E0 THEN {middle} WHEN {q} < 0E0 THEN -({side}) ELSE {side} END END"


def d_prime_sql(hits: str, false_alarms: str) -> str:
    """d' of two rates, which are clipped first, in SQL."""
    return f"({quantile_sql(clipped_sql(hits))}) - ({quantile_sql(clipped_sql(false_alarms))})"


def normal_quantile(p: str) -> Column:
    """The quantile of a column of doubles."""
    return F.expr(quantile_sql(p))


def d_prime(hits: str, false_alarms: str) -> Column:
    """d' of two columns of rates."""
    return F.expr(d_prime_sql(hits, false_alarms))
