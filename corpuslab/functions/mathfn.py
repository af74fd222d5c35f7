"""Math scalar functions over score arrays.

All are Column expressions (array higher-order functions), evaluated per row
in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 rational approximation of erf
# (|error| < 1.5e-7): p, then a1..a5.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def _logsumexp(v: Column) -> tuple:
    m = F.array_max(v)
    z = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return m, z


def softmax(v) -> Column:
    """M1: exp(x - max) / sum exp(x - max)."""
    arr = _c(v)
    m, z = _logsumexp(arr)
    return F.transform(arr, lambda x: F.exp(x - m) / z)


def log_softmax(v) -> Column:
    """M1: x - max - ln(sum exp(x - max))."""
    arr = _c(v)
    m, z = _logsumexp(arr)
    return F.transform(arr, lambda x: x - m - F.ln(z))


def erf(x) -> Column:
    """erf by the fixed rational approximation (odd extension for x < 0)."""
    z = F.abs(_c(x))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    y = F.lit(1.0) - poly * F.exp(-(z * z))
    return F.when(_c(x) < 0, -y).otherwise(y)


def gelu(x) -> Column:
    """M2: x * Phi(x) = 0.5 x (1 + erf(x / sqrt 2))."""
    c = _c(x)
    return F.lit(0.5) * c * (F.lit(1.0) + erf(c / F.lit(math.sqrt(2.0))))


def kl_loss(logp, label) -> Column:
    """M3: KL divergence to a one-hot target = -log p[label] (label 0-based)."""
    return -F.element_at(_c(logp), _c(label) + 1)


def cross_entropy(scores, label) -> Column:
    """M4: -log_softmax(scores)[label]."""
    return kl_loss(log_softmax(scores), label)


def scaled(c, factor: float = 1.0, digits: int = 4) -> Column:
    """M5: round(factor * x, digits)."""
    return F.round(F.lit(factor) * _c(c), digits)


def argmax(v) -> Column:
    """First 0-based index of the maximum."""
    arr = _c(v)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def linear_head(vec, weights, bias) -> Column:
    """M7: W x + b with W given as a list of rows (one per output)."""
    x = _c(vec)
    outs = []
    for row, b in zip(weights, bias):
        w = F.array(*[F.lit(float(v)) for v in row])
        outs.append(F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(float(b)), lambda acc, y: acc + y))
    return F.array(*outs)


def rule_weights(n_out: int, n_in: int) -> list:
    """Deterministic small weights w[k][j] = ((k+1)(j+1) mod 7 - 3) / 10 for demos and tests."""
    return [[(((k + 1) * (j + 1)) % 7 - 3) / 10.0 for j in range(n_in)] for k in range(n_out)]
