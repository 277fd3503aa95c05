"""Probability algebra on ragged arrays of doubles: K candidates, then the null slot."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The clips of the metrics, of calibration fits and of cross-entropies against soft gold.
CLIP, FIT_CLIP, GOLD_CLIP = 1e-12, 1e-300, 1e-6


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def bound(x: Column, f) -> Column:
    """f of x, which is evaluated once: inside a lambda an expression would be evaluated again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def shares(xs: Column) -> Column:
    """Each by their total."""
    return bound(xs, lambda e: bound(total(e), lambda s: F.transform(e, lambda x: x / s)))


def candidates(p: Column) -> Column:
    """Without the null slot."""
    return F.slice(p, F.lit(1), F.size(p) - 1)


def null_of(p: Column) -> Column:
    return F.element_at(p, -1)


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return bound(z, lambda zs: bound(F.array_max(zs), lambda top: shares(F.transform(zs, lambda x: F.exp((x - top) / t)))))


def log_sum_exp(z: Column) -> Column:
    return bound(z, lambda zs: bound(F.array_max(zs), lambda top: top + F.ln(F.aggregate(zs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))


def with_null_offset(z: Column, b: Column | float) -> Column:
    """b is added to the null slot's logit."""
    return F.concat(candidates(z), F.array(F.element_at(z, -1) + b))


def factored(null_logit: Column, scores: Column, temperature: float = 1.0) -> Column:
    """P(null) by its own logit; the rest by a softmax over the candidates, so the temperature leaves the null alone."""
    r = 1.0 / (1.0 + F.exp(-null_logit))
    s = softmax(scores, temperature)
    return F.concat(F.transform(s, lambda x: (1.0 - r) * x), F.array(r))


def over_labels(p: Column) -> Column:
    """Without the null, renormalised; all zero stays all zero."""
    return bound(candidates(p), lambda c: bound(total(c), lambda s: F.transform(c, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))))


def argmax(p: Column) -> Column:
    """The first place of the maximum, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(n: Column, at: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def full_target(target: Column, p_null: Column) -> Column:
    return F.concat(F.transform(target, lambda t: (1.0 - p_null) * t), F.array(p_null))


def _clipped(x: Column, low: float = CLIP) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(low), x))


def nll(p: Column, target: Column, low: float = CLIP) -> Column:
    return -total(F.zip_with(p, target, lambda a, t: t * F.ln(_clipped(a, low))))


def brier(p: Column, target: Column) -> Column:
    return total(F.zip_with(p, target, lambda a, t: (a - t) * (a - t)))


def jsd(p: Column, q: Column) -> Column:
    """Natural logarithms, clipped."""
    half = lambda a, m: _clipped(a) * (F.ln(_clipped(a)) - F.ln(_clipped(m)))
    return total(F.zip_with(p, q, lambda a, b: 0.5 * half(a, 0.5 * (a + b)) + 0.5 * half(b, 0.5 * (a + b))))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: _clipped(a) * (F.ln(_clipped(a)) - F.ln(_clipped(b)))))


def jsd_maps(p: Column, q: Column) -> Column:
    """Base 2 over the union of keys, not below 0."""
    keys = F.array_distinct(F.concat(F.map_keys(p), F.map_keys(q)))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0.0))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    s = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + 0.5 * part(at(p, k), (at(p, k) + at(q, k)) / 2) + 0.5 * part(at(q, k), (at(p, k) + at(q, k)) / 2))
    return F.greatest(F.lit(0.0), s)


def tempered(p: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return shares(F.transform(p, lambda x: F.pow(x, 1.0 / t)))


def confidence(p: Column) -> Column:
    """(max - 1/K) / (1 - 1/K); 1 for one label."""
    k = F.size(p)
    return F.when(k <= 1, 1.0).otherwise((F.array_max(p) - 1.0 / k) / (1.0 - 1.0 / k))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def entropy(p: Column) -> Column:
    """Relative to the uniform one; 0 for one label."""
    h = -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))
    return F.when(F.size(p) > 1, h / F.ln(F.size(p).cast("double"))).otherwise(0.0)


def margin(p: Column) -> Column:
    """The greatest minus the next (0 for a lone label's next)."""
    s = F.reverse(F.array_sort(p))
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def set_statistics(scores: Column) -> Column:
    """max, margin (0 for one), mean and logsumexp minus log K of a set of scores."""
    s = F.reverse(F.array_sort(scores))
    return F.struct(
        F.array_max(scores).alias("top"),
        F.when(F.size(scores) > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(0.0).alias("margin"),
        (total(scores) / F.size(scores)).alias("mean"),
        (log_sum_exp(scores) - F.ln(F.size(scores).cast("double"))).alias("lse"),
    )


def cumulative_link(x: Column, first: Column, steps: Column) -> Column:
    """Ordinal probabilities: thresholds are first plus running sums of softplus(steps); differences of sigmoids, the last takes the rest."""
    soft = F.transform(steps, lambda s: F.ln(1.0 + F.exp(s)))
    cuts = F.transform(F.sequence(F.lit(0), F.size(soft)), lambda i: first + total(F.slice(soft, F.lit(1), i)))
    below = F.transform(cuts, lambda c: 1.0 / (1.0 + F.exp(x - c)))
    return F.zip_with(F.concat(below, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), below), lambda b, a: b - a)


def composed(support: Column, choice: Column) -> Column:
    """P(null) = 1 - support, the rest by a conditional choice."""
    return F.concat(F.transform(choice, lambda x: support * x), F.array(1.0 - support))


def fused(z_a: Column, z_b: Column, g: Column | float, mode: str = "log") -> Column:
    """Two scorers' candidates: log-linear (a + g b) or a mixture of their probabilities; the null slot is left to the gate."""
    g = g if isinstance(g, Column) else F.lit(float(g))
    if mode == "log":
        return softmax(F.zip_with(z_a, z_b, lambda a, b: a + g * b))
    return F.zip_with(softmax(z_a), softmax(z_b), lambda a, b: (1.0 - g) * a + g * b)


def permuted(values: Column, order: Column) -> Column:
    """The values in the order given by places from 0."""
    return F.transform(order, lambda i: F.get(values, i))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * total(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def decision_loss(z: Column, target: Column, teacher: Column, alpha: float, beta: float, t: float, brier_weight: float) -> Column:
    """alpha cross-entropy + weighted Brier + beta T^2 KL(teacher || student) over the candidates."""
    p = softmax(z)
    student = softmax(candidates(z), t)
    soft = tempered(teacher, t)
    return alpha * nll(p, target) + brier_weight * brier(p, target) + beta * t * t * kl(soft, student)
