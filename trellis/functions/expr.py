"""Column expressions for expression values, curves and aggregates; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int | float) else F.col(x)


# aggregates over rows -------------------------------------------------------------------------


def mean_pos(x) -> Column:
    """Mean of the positive values; null without any."""
    return F.avg(F.when(_c(x) > 0, _c(x)))


def mean_of_logs(x, n=None, base: float = 2.0) -> Column:
    """Log of the mean of unlogged values, plus one. ``n``: members of the group, where zeros have no rows."""
    total = F.sum(F.pow(_c(base), _c(x)) - 1)
    return F.log(float(base), F.try_divide(total, F.count(F.lit(1)) if n is None else _c(n)) + 1)


def sum_of_logs(x, base: float = 2.0) -> Column:
    return F.log(float(base), F.sum(F.pow(_c(base), _c(x)) - 1) + 1)


def mean_of_logs_pos(x, base: float = 2.0) -> Column:
    return F.coalesce(F.log(float(base), F.avg(F.when(_c(x) > 0, F.pow(_c(base), _c(x)) - 1)) + 1), F.lit(0.0))


def prop_exp(x, threshold: float = 0.0, n=None) -> Column:
    return F.try_divide(F.count_if(_c(x) > threshold), F.count(F.lit(1)) if n is None else _c(n))


def prop_nonexp(x) -> Column:
    return F.try_divide(F.count_if(_c(x) <= 0), F.count(F.lit(1)))


def num_mean(x) -> Column:
    return F.avg(_c(x).try_cast("double"))


def combine_probs(p) -> Column:
    """Probability that at least one of independent events happens."""
    return F.when(F.max(_c(p)) >= 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.when(_c(p) < 1, F.log1p(-_c(p))))))


def output_uniform(x, ignore_null: bool = False) -> Column:
    """The only distinct value, null if there are several; a null is a value unless ignored."""
    one = F.count_distinct(_c(x)) == 1
    return F.when(one if ignore_null else one & (F.count(_c(x)) == F.count(F.lit(1))), F.max(_c(x)))


# row by row -----------------------------------------------------------------------------------


def pmax_abs(x, y) -> Column:
    return F.when(F.abs(_c(x)) > F.abs(_c(y)), _c(x)).otherwise(_c(y))


def preference(x, y, signed: bool = False) -> Column:
    """The difference over the sum, zero where both are; unsigned, the difference alone is absolute."""
    d = _c(x) - _c(y)
    return F.coalesce(F.try_divide(d if signed else F.abs(d), _c(x) + _c(y)), F.lit(0.0))


def logistic(x, x0, k, c=1.0) -> Column:
    return _c(c) / (1 + F.exp(-_c(k) * (_c(x) - _c(x0))))


def inv_logistic(x, x0, k, c=1.0) -> Column:
    return F.ln(_c(c) / _c(x) - 1) / -_c(k) + _c(x0)


def sigmoid(x, a, b, c, d) -> Column:
    return _c(c) / (1 + F.exp(-_c(a) * (_c(x) - _c(b)))) + _c(d)


def d_dx_sigmoid(x, a, b, c) -> Column:
    """Slope of the sigmoid, from its share of the height, so that no exponential of a large number is divided by another."""
    s = logistic(x, b, a)
    return _c(a) * _c(c) * s * (1 - s)


def inv_sigmoid(y, a, b, c, d) -> Column:
    return -F.ln(_c(c) / (_c(y) - _c(d)) - 1) / _c(a) + _c(b)


def impulse_single(x, b1, h0, h1, t1) -> Column:
    return _c(h0) + (_c(h1) - _c(h0)) / (1 + F.exp(_c(b1) * (_c(x) - _c(t1))))


def impulse_double(x, b1, b2, h0, h1, h2, t1, t2) -> Column:
    return impulse_single(x, b1, h0, h1, t1) * impulse_single(x, b2, h2, h1, t2) / _c(h1)


def impulse_slope_single(x, b1, h0, h1, t1) -> Column:
    e = F.exp(_c(b1) * (_c(x) - _c(t1)))
    return (_c(h0) - _c(h1)) * _c(b1) * e / F.pow(1 + e, 2.0)


def impulse_bend_single(x, b1, h0, h1, t1) -> Column:
    e = F.exp(_c(b1) * (_c(x) - _c(t1)))
    return (_c(h1) - _c(h0)) * _c(b1) * _c(b1) * e * (e - 1) / F.pow(1 + e, 3.0)


def impulse_slope_double(x, b1, b2, h0, h1, h2, t1, t2) -> Column:
    s1, s2 = impulse_single(x, b1, h0, h1, t1), impulse_single(x, b2, h2, h1, t2)
    return (impulse_slope_single(x, b1, h0, h1, t1) * s2 + s1 * impulse_slope_single(x, b2, h2, h1, t2)) / _c(h1)


def impulse_bend_double(x, b1, b2, h0, h1, h2, t1, t2) -> Column:
    s1, s2 = impulse_single(x, b1, h0, h1, t1), impulse_single(x, b2, h2, h1, t2)
    d1, d2 = impulse_slope_single(x, b1, h0, h1, t1), impulse_slope_single(x, b2, h2, h1, t2)
    return (impulse_bend_single(x, b1, h0, h1, t1) * s2 + 2 * d1 * d2 + s1 * impulse_bend_single(x, b2, h2, h1, t2)) / _c(h1)


def is_whole(x) -> Column:
    return F.ceil(_c(x)) == F.floor(_c(x))


def cut_string(x, delimiter: str, field: int) -> Column:
    return F.get(F.split(_c(x), delimiter), field - 1)


def decode_barcode(name: str, length: int = 16) -> Column:
    """Two bits a letter, the most significant first."""
    return F.expr(f"array_join(transform(sequence({length - 1}, 0, -1), k -> substr('ACGT', cast(shiftright(`{name}`, 2 * k) & 3 as int) + 1, 1)), '')")
