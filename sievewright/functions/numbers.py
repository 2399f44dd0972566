"""Guards and formulas over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bind


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or(c: Column, default: float | None = 0.0) -> Column:
    """The number, or the default where it is missing, not a number or infinite."""
    v = c.try_cast("double")
    return F.when(is_finite(v), v).otherwise(F.lit(default).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def clipped_margin(p: Column, eps: float = 1e-6) -> Column:
    """As ``clipped_logit``, but the rest to one is cut below only: a probability of 0 gives ``ln(eps)``."""
    return F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)) / F.least(F.greatest(1 - p, F.lit(eps)), F.lit(1.0)))


def sane_perplexity(c: Column) -> Column:
    """1 where the value is no positive finite number."""
    return F.when(is_finite(c) & (c > 0), c).otherwise(1.0)


def burstiness(values: Column) -> Column:
    """Population standard deviation by mean of an array; 0 for fewer than two values or a mean that is not positive."""

    def of(v: Column, mean: Column) -> Column:
        spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v))
        return F.when((F.size(v) < 2) | (mean <= 0), 0.0).otherwise(spread / mean)

    return bind(values, lambda v: F.when(F.size(v) == 0, 0.0).otherwise(bind(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), lambda mean: of(v, mean))))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars at prices per million tokens, rounded to six places."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)


def curvature(ll: Column, mean: Column, std: Column | None = None) -> Column:
    """Log-likelihood minus the mean of its perturbations; with ``std`` in units of it (1 where it is 0 or null)."""
    d = ll - mean
    return d if std is None else d / F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))


def metric_name(metric: str, target: float) -> str:
    """``tpr_at_0_1pct_fpr`` for ``tpr`` and 0.001."""
    return f"{metric}_at_{f'{target * 100:.8g}'.replace('.', '_').replace('-', 'neg_')}pct_fpr"
