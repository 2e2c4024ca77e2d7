"""Expressions on arrays of logits: scores, and the filters a sampler applies before it draws.

All are higher-order functions on one array per row; the array is never exploded, so a vocabulary of any
size stays one value of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits in a nat.
NATS_TO_BITS = 1.4426950408889634


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; within a lambda, an expression is worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def log_sum_exp(logits: Column) -> Column:
    """ln of the sum of e^x, with the maximum taken out first."""
    return let(F.array_max(logits), lambda top: top + F.ln(_sum(logits, lambda x: F.exp(x - top))))


def log_softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda z: F.transform(logits, lambda x: x - z))


def softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda z: F.transform(logits, lambda x: F.exp(x - z)))


def nll(logits: Column, target: Column) -> Column:
    """Negative log-likelihood (nats) of the target id, from 0. Null where there is no such id."""
    return log_sum_exp(logits) - F.get(logits, target)


def _entropy(logits: Column, z: Column, nan_safe: bool) -> Column:
    if nan_safe:
        return -_sum(logits, lambda x: F.when(F.exp(x - z) == 0, F.lit(0.0)).otherwise(F.exp(x - z) * (x - z)))
    return -_sum(logits, lambda x: F.exp(x - z) * (x - z))


def entropy(logits: Column, nan_safe: bool = False) -> Column:
    """Entropy (nats) of the softmax. A logit of minus infinity gives NaN, as 0 times infinity is; 0 with nan_safe."""
    return let(log_sum_exp(logits), lambda z: _entropy(logits, z, nan_safe))


def scores(logits: Column, target: Column, nan_safe: bool = False) -> Column:
    """Struct (entropy, nll), with one pass less than both apart."""
    return let(log_sum_exp(logits), lambda z: F.struct(_entropy(logits, z, nan_safe).alias("entropy"), (z - F.get(logits, target)).alias("nll")))


def argmax(logits: Column) -> Column:
    """The first id with the highest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def suppress(logits: Column, ids: Column) -> Column:
    """Minus infinity for the given ids."""
    return let(ids, lambda out: F.transform(logits, lambda x, i: F.when(F.array_contains(out, i), F.lit(float("-inf"))).otherwise(x)))


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Ids seen before, each once: divided by the penalty if positive, else multiplied by it."""
    return let(F.array_distinct(seen), lambda ids: F.transform(logits, lambda x, i: F.when(~F.array_contains(ids, i), x).when(x < 0, x * penalty).otherwise(x / penalty)))


def temperature(logits: Column, t: float) -> Column:
    """Logits over t; for t of 0 or less all but the first highest are minus infinity."""
    if t <= 0:
        return let(argmax(logits), lambda best: F.transform(logits, lambda x, i: F.when(i == best, x).otherwise(F.lit(float("-inf")))))
    return F.transform(logits, lambda x: x / t)


def _ranked(logits: Column) -> Column:
    """Structs (neg, i), highest logit first, lowest id first among equals."""
    return F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))


def _upto(logits: Column, last: Column) -> Column:
    """Minus infinity for what comes after last in _ranked's order."""
    return let(last, lambda r: F.transform(logits, lambda x, i: F.when((-x < r["neg"]) | ((-x == r["neg"]) & (i <= r["i"])), x).otherwise(F.lit(float("-inf")))))


def top_k(logits: Column, k: int) -> Column:
    """Minus infinity outside the k highest; the lower id comes first among equals."""
    return _upto(logits, F.get(_ranked(logits), F.least(F.lit(k), F.size(logits)) - 1))


def _nucleus(logits: Column, p: float, k: int | None) -> Column:
    """How many of the highest logits the nucleus holds."""
    zero = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))

    def counted(z: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            mass = acc["mass"] + F.exp(-r["neg"] - z)
            return F.struct(mass.alias("mass"), (acc["n"] + F.when(mass <= p, 1).otherwise(0)).alias("n"))

        return F.aggregate(_ranked(logits), zero, step, lambda acc: F.greatest(acc["n"], F.lit(1)))

    n = let(log_sum_exp(logits), counted)
    return n if k is None else F.least(n, F.lit(k))


def nucleus(logits: Column, p: float, k: int | None = None) -> Column:
    """The ids that stay, highest first: while the probability summed up to and with an id is at most p, and the highest always; at most k."""
    return F.transform(F.slice(_ranked(logits), F.lit(1), _nucleus(logits, p, k)), lambda r: r["i"])


def top_p(logits: Column, p: float, k: int | None = None) -> Column:
    """Minus infinity outside the nucleus."""
    return _upto(logits, F.get(_ranked(logits), _nucleus(logits, p, k) - 1))


def min_p(logits: Column, p: float) -> Column:
    """Minus infinity where the probability is below p times the highest."""
    return let(F.array_max(logits) + F.ln(F.lit(p)), lambda least: F.transform(logits, lambda x: F.when(x >= least, x).otherwise(F.lit(float("-inf")))))


def race(logits: Column, noise: Column) -> Column:
    """A categorical draw: the id with the highest probability over an exponential variate, -ln of uniform noise."""
    return let(F.zip_with(softmax(logits), noise, lambda x, u: x / -F.ln(F.greatest(u, F.lit(1e-300)))), argmax)


def sample(logits: Column, noise: Column, t: float, k: int = 0, p: float = 0.0) -> Column:
    """A frame sampler's draw: the first highest id for t of 0 or less, else a race at temperature t among the k best (all for 0) within the nucleus of p (none unless 0 < p < 1).

    Logits are made log-probabilities only where a nucleus needs them.
    """
    if t <= 0:
        return argmax(logits)
    kept = logits
    if 0 < p < 1:
        kept = let(log_softmax(logits), lambda lg: top_p(lg, p, k or None))
    elif k:
        kept = top_k(logits, k)
    return let(kept, lambda lg: race(temperature(lg, t), noise))


def fused_filters(logits: Column, temperature_: float, k: int, p: float, least: float, eos: int) -> Column:
    """Temperature, then top-k, then top-p and min-p on what is left; the end token keeps its logit."""
    scaled = F.transform(logits, lambda x: x / temperature_)
    cut = let(scaled, lambda lg: top_k(lg, k))
    cut = let(cut, lambda lg: top_p(lg, p)) if 0 < p < 1 else cut
    cut = let(cut, lambda lg: min_p(lg, least)) if least > 0 else cut
    return let(F.get(scaled, F.lit(eos)), lambda end: F.transform(cut, lambda x, i: F.when(i == eos, end).otherwise(x)))


def repetition_aware(logits: Column, recent: Column, noise: Column, again: Column, p: float, k: int, low: int, high: int, high_p: float = 0.9) -> Column:
    """A draw from the nucleus; drawn once more, with other noise and a nucleus of high_p, if it is semantic (low to high) and among the recent ones."""
    first, second = race(top_p(logits, p, k), noise), race(top_p(logits, high_p, k), again)
    return F.when(first.between(low, high) & F.array_contains(recent, first), second).otherwise(first)
