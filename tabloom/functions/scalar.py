"""Scalar expressions that are not in `pyspark.sql.functions`."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.hashing import as_col

# The strings that stand for a missing cell, compared after trim and lower.
SENTINELS = ("", "n/a", "na", "null", "none", "nan", "-", "?")

BLANKS = " \t\n\r\f\v"

# Coefficients of the rational approximation of the inverse normal CDF
# (P. J. Acklam, 2003), relative error below 1.15e-9.
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0)
PPF_LOW = 0.02425


def clean_text(c: Column | str) -> Column:
    """Trimmed text, with the sentinel strings turned into NULL."""
    text = F.btrim(as_col(c), F.lit(BLANKS))
    return F.when(~F.lower(text).isin(*SENTINELS), text)


def to_number(c: Column | str) -> Column:
    """Cast to double; what does not parse becomes NULL."""
    return as_col(c).try_cast("double")


#: Texts that are numbers, and those that are whole numbers.
NUMBER = r"(?i)^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)$"
WHOLE = r"^[+-]?[0-9]+$"


def parse_number(c: Column) -> Column:
    """Text to double, by the pattern of numbers alone ("1d" is not one)."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_whole(c: Column) -> Column:
    """Text to bigint; NULL for what is no whole number or does not fit."""
    return F.when(c.rlike(WHOLE), c.try_cast("bigint"))


def is_missing(c: Column, type_name: str) -> Column:
    return (c.isNull() | F.isnan(c)) if type_name in ("double", "float") else c.isNull()


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for value in coefficients[1:]:
        out = out * x + F.lit(value)
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF as a column expression."""
    q = p - 0.5
    centre = _poly(PPF_A, q * q) * q / _poly(PPF_B, q * q)
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    return (
        F.when(p < PPF_LOW, _poly(PPF_C, low) / _poly(PPF_D, low))
        .when(p <= 1 - PPF_LOW, centre)
        .otherwise(-_poly(PPF_C, high) / _poly(PPF_D, high))
    )


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_quantile(p: float, dof: int) -> float:
    """Chi-square quantile by bisection on the regularised lower incomplete gamma series."""
    import math

    def cdf(x: float) -> float:
        a, half = dof / 2.0, x / 2.0
        term = total = 1.0 / a
        n = a
        for _ in range(10_000):
            n += 1.0
            term *= half / n
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 1e-12, float(dof) + 10.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def join_items(c: Column) -> Column:
    return F.array_join(F.array_sort(c), " + ")


def rule_text(antecedent: Column, consequent: Column) -> Column:
    return F.concat_ws(" => ", join_items(antecedent), join_items(consequent))
