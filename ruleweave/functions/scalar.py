"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import BARE


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def norm_value(value: Column | str) -> Column:
    """Value spelling of the text exports: lower case, no dots (``1.01`` -> ``101``)."""
    return F.regexp_replace(F.lower(as_col(value).cast("string")), r"\.", "")


def quoted_term(value: Column | str) -> Column:
    """A constant as a term of a rule, in quotes where it would read as something else."""
    value = as_col(value)
    in_quotes = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.rlike(f"^(?:{BARE})$"), value).otherwise(in_quotes)


def unquoted_term(term: Column | str) -> Column:
    """The value of a constant term."""
    term = as_col(term)
    inner = F.replace(F.regexp_extract(term, "^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(term.rlike("^'.*'$"), inner).otherwise(term)


def split_dummy(name: Column | str) -> tuple[Column, Column]:
    """``tumor_size_Big`` -> (``tumor_size``, ``big``): the value follows the last ``_``."""
    name = as_col(name)
    pred = F.regexp_replace(name, r"_[^_]*$", "")
    return pred, norm_value(F.substring_index(name, "_", -1))


def to_utility(phi: Column | str, truncate: bool = False) -> Column:
    """Fixed-point size of an attribution, in thousandths.

    ``truncate`` rounds to three digits first and then cuts the product, so that
    1.001 becomes 1000; otherwise the product is rounded once.
    """
    phi = as_col(phi)
    if truncate:
        return F.abs((F.round(phi, 3) * 1000).cast("int")).cast("bigint")
    return F.abs(F.round(phi * 1000)).cast("bigint")


def info_value(p: Column, n: Column) -> Column:
    """Bits needed to signal that a covered case is positive; 0 when none is."""
    return F.when(p == 0, F.lit(0.0)).otherwise(-F.log2(p / (p + n)))


def information_gain(
    p: Column, n: Column, p_parent: Column, n_parent: Column, retained: Column | None = None
) -> Column:
    """Gain of a specialization: retained positives x bits saved per positive.

    ``p`` and ``n`` count bindings. ``retained`` counts positive cases and differs from
    ``p`` only when the clause binds new variables.
    """
    retained = p if retained is None else retained
    saved = info_value(p_parent, n_parent) - info_value(p, n)
    return F.when(retained == 0, F.lit(0.0)).otherwise(retained * saved)


def log2_factorial(n: int) -> float:
    return math.lgamma(n + 1) / math.log(2)


def log2_choose(n: int, k: int) -> float:
    return log2_factorial(n) - log2_factorial(k) - log2_factorial(n - k)


def lgamma_col(x: Column | str) -> Column:
    """Log-gamma of a positive column: Stirling's series after moving ``x`` ten up."""
    x = as_col(x).cast("double")
    z = x + 10
    series = (
        (z - 0.5) * F.log(z)
        - z
        + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * z)
        - 1 / (360 * F.pow(z, F.lit(3.0)))
        + 1 / (1260 * F.pow(z, F.lit(5.0)))
        - 1 / (1680 * F.pow(z, F.lit(7.0)))
    )
    shift = reduce(lambda acc, i: acc + F.log(x + i), range(1, 10), F.log(x))
    return series - shift


def log2_choose_col(n: Column | str, k: Column | str) -> Column:
    """log2 of n choose k as a column; no overflow at any size."""
    n, k = as_col(n), as_col(k)
    nats = lgamma_col(n + 1) - lgamma_col(k + 1) - lgamma_col(n - k + 1)
    return nats / math.log(2)


def explicit_bits(total: int, covered: int) -> float:
    """Bits to point at ``covered`` of ``total`` cases one by one."""
    if covered == 0:
        return 0.0
    return math.log2(total) + log2_choose(total, covered)


def clause_bits(literal_bits: float, body_size: int) -> float:
    """Bits to write down a clause body; the order of its literals is free."""
    return body_size * (literal_bits + 1) - log2_factorial(body_size)
