"""Closed-form scores of decoding and training, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def hypothesis_score(logp: Column, length: Column, attention: Column, sources: Column, steps: Column, alpha: float = 0.2, beta: float = 0.8, gamma: float = 0.2) -> Column:
    """Length-normalised log probability, plus coverage of the source by attention, plus the length ratio.

    ``attention`` holds each source position's mass over all steps.
    """
    coverage = total(F.transform(attention, lambda m: F.log(F.least(m, F.lit(1.0)))))
    return logp / F.pow((length + 5) / 6.0, F.lit(alpha)) + beta * coverage + gamma * sources / steps


def log_softmax(values: Column) -> Column:
    """Of the given values alone, such as the best few of a vocabulary."""
    top = F.array_max(values)
    norm_ = F.log(total(F.transform(values, lambda x: F.exp(x - top)))) + top
    return F.transform(values, lambda x: x - norm_)


def softmax(values: Column) -> Column:
    return F.transform(log_softmax(values), lambda x: F.exp(x))


def safe_log(p: Column) -> Column:
    """Logarithm with 1e-20 for what is not a positive finite number."""
    good = (p > 0) & ~F.isnan(p) & (p < float("inf"))
    return F.log(F.when(good, p).otherwise(F.lit(1e-20)))


def label_smoothed_nll(logp: Column, target: Column, eps: float, size: int) -> Column:
    """(1 - eps - eps_i) of the target's loss plus eps_i of all, eps_i = eps / (size - 1)."""
    each = eps / (size - 1)
    return -(1.0 - eps - each) * F.element_at(logp, target) - each * total(logp)


def inverse_sqrt_rate(step: Column, peak: float, warm_up: int) -> Column:
    """Learning rate: linear to the peak, then with the inverse square root of the step."""
    return F.when(step <= warm_up, peak * step / warm_up).otherwise(peak * F.sqrt(F.lit(float(warm_up))) / F.sqrt(step))


def annealed_rate(step: Column, peak: float, warm_up: int, end: int, style: str, least: float = 0.0) -> Column:
    """Learning rate after a linear warm-up: linear, cosine, exponential or constant, never under ``least``."""
    last = F.least(step, F.lit(end)).cast("double")
    share = (last - warm_up) / float(end - warm_up)
    shapes = {
        "linear": peak * (end - last) / float(end - warm_up),
        "cosine": peak / 2.0 * (F.cos(F.lit(3.141592653589793) * share) + 1),
        "exponential": peak * F.exp(-0.693 * share),
        "constant": F.lit(peak),
    }
    return F.when((step <= warm_up) & (F.lit(warm_up) > 0), peak * step / warm_up).otherwise(F.greatest(shapes[style], F.lit(least)))


def relative_bucket(distance: Column, buckets: int = 32, most: int = 128) -> Column:
    """Bucket of a relative position: both directions, half of them exact, half by logarithm."""
    half = buckets // 2
    exact = half // 2
    n = F.abs(distance)
    far = exact + F.floor(F.log(n / float(exact)) / F.log(F.lit(most / exact)) * (half - exact))
    return F.when(distance > 0, half).otherwise(0) + F.when(n < exact, n).otherwise(F.least(far, F.lit(half - 1)))


def adamw(param: Column, grad: Column, m: Column, v: Column, step: int, rate: float, b1: float = 0.9, b2: float = 0.98, eps: float = 1e-6, decay: float = 0.01) -> tuple[Column, Column, Column]:
    """Parameters and both moments after one bias-corrected step with decoupled decay."""
    m1 = F.zip_with(m, grad, lambda a, g: b1 * a + (1 - b1) * g)
    v1 = F.zip_with(v, grad, lambda a, g: b2 * a + (1 - b2) * g * g)
    size = rate / (1 - b1**step)
    root = (1 - b2**step) ** 0.5
    moved = F.zip_with(m1, v1, lambda a, b: size * a / (F.sqrt(b) / root + eps))
    return F.zip_with(param, moved, lambda p, d: p * (1 - rate * decay) - d), m1, v1


def vaccinated(own: Column, other: Column, target: Column) -> Column:
    """A task's gradient, turned towards another task's where their cosine is under its target."""
    cos = dot(own, other) / (norm(own) * norm(other))
    weight = norm(own) * (target * F.sqrt(1 - cos * cos) - cos * F.sqrt(1 - target * target)) / (norm(other) * F.sqrt(1 - target * target))
    return F.when(cos < target, F.zip_with(own, other, lambda a, b: a + weight * b)).otherwise(own)
