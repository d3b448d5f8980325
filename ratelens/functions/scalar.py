"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelens.roles import Roles


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_even(x, digits: int) -> Column:
    """half-even rounding (``F.round`` is half-up)."""
    return F.bround(_c(x), digits)


def safe_ratio(a, b) -> Column:
    """F8: a / b, and 0.0 when b is 0 (``try_divide`` gives null under ANSI)."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def pct_text(x, digits: int = 1) -> Column:
    """``12.3%``."""
    return F.format_string(f"%.{digits}f%%", _c(x))


def money_text(x) -> Column:
    """``$6,503``."""
    return F.concat(F.lit("$"), F.format_number(_c(x), 0))


def count_text(x) -> Column:
    """``1,470``."""
    return F.format_number(_c(x), 0)


# fixed values: risk tiers by descending probability cut-off (strictly greater than)
RISK_TIERS = [
    (0.7, "RIESGO CRÍTICO (>70%)"),
    (0.5, "RIESGO ALTO (50-70%)"),
    (0.3, "RIESGO MODERADO (30-50%)"),
]
RISK_TIER_LOW = "RIESGO BAJO (<30%)"

# fixed values: risk factor messages
FACTOR_OVERTIME = "🔴 Trabajo con horas extra"
FACTOR_TRAVEL_FREQUENT = "🔴 Viajes frecuentes"
FACTOR_TRAVEL_RARE = "🟡 Viajes ocasionales"
FACTOR_NEW = "🟡 Empleado relativamente nuevo"
FACTOR_LOW_PAY = "🟡 Salario por debajo del promedio"
NEW_TENURE_BELOW = 2
LOW_PAY_BELOW = 3000


def risk_tier(prob) -> Column:
    """tier of a probability by the cut-offs above, first match wins."""
    expr = None
    for cut, label in RISK_TIERS:
        cond = _c(prob) > F.lit(cut)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(RISK_TIER_LOW)


def risk_factors(roles: Roles, low_pay_below: float = LOW_PAY_BELOW,
                 new_tenure_below: float = NEW_TENURE_BELOW) -> Column:
    """the list of rules that fire for a row, in rule order."""
    travel = F.col(roles.travel)
    return F.array_compact(F.array(
        F.when(F.col(roles.overtime) == roles.yes, F.lit(FACTOR_OVERTIME)),
        F.when(travel == roles.travel_frequent, F.lit(FACTOR_TRAVEL_FREQUENT))
         .when(travel == roles.travel_rare, F.lit(FACTOR_TRAVEL_RARE)),
        F.when(F.col(roles.tenure) < new_tenure_below, F.lit(FACTOR_NEW)),
        F.when(F.col(roles.income) < low_pay_below, F.lit(FACTOR_LOW_PAY)),
    ))
