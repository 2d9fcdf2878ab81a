"""Pricing Column expressions: shock -> P&L of a position.

A scenario shock is a log-return ``r`` of the position's risk factor. It moves
the spot by ``dS = S * (exp(r) - 1)``. Linear instruments earn
``q * delta * dS``; instruments with gamma use the second-order expansion
``q * (delta * dS + 0.5 * gamma * dS^2)``. With gamma = 0 both agree, so the
pricer choice is one expression.

Because every position on the same factor sees the same ``dS / S``, a
portfolio's positions on one factor collapse exactly into two numbers before
any scenario is applied::

    lin  = sum(q * delta * S)          quad = sum(0.5 * q * gamma * S^2)
    pnl(r) = lin * m + quad * m^2      with m = exp(r) - 1

``exposure_columns`` builds them; ``exposure_pnl`` applies a shock. That keeps
the scenario join at (portfolio, factor) grain instead of position grain.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def price_move(spot, log_return) -> Column:
    """Absolute price change implied by a log-return: S * (exp(r) - 1)."""
    return _c(spot) * (F.exp(_c(log_return)) - F.lit(1.0))


def pnl_linear(quantity, delta, spot, log_return) -> Column:
    return _c(quantity) * _c(delta) * price_move(spot, log_return)


def pnl_delta_gamma(quantity, delta, gamma, spot, log_return) -> Column:
    ds = price_move(spot, log_return)
    return _c(quantity) * (_c(delta) * ds + F.lit(0.5) * _c(gamma) * ds * ds)


def pnl_auto(quantity, delta, gamma, spot, log_return) -> Column:
    """Pricer choice: delta-gamma when gamma != 0, else linear. A null shock is no move."""
    r = F.coalesce(_c(log_return), F.lit(0.0))
    return (F.when(_c(gamma) != 0, pnl_delta_gamma(quantity, delta, gamma, spot, r))
            .otherwise(pnl_linear(quantity, delta, spot, r)))


# Registry of pricers: name -> builder taking (quantity, delta, gamma, spot, r).
PRICERS: dict[str, Callable[..., Column]] = {
    "auto": pnl_auto,
    "linear": lambda q, d, g, s, r: pnl_linear(q, d, s, r),
    "delta_gamma": pnl_delta_gamma,
}


def register_pricer(name: str, fn: Callable[..., Column]) -> None:
    PRICERS[name] = fn


def exposure_columns(quantity="quantity", delta="delta", gamma="gamma", spot="spot_price"):
    """Aggregates that collapse positions on one factor (see module doc)."""
    q, d, g, s = _c(quantity), _c(delta), _c(gamma), _c(spot)
    return [
        F.sum(q * d * s).alias("lin_exposure"),
        F.sum(F.lit(0.5) * q * g * s * s).alias("quad_exposure"),
    ]


def exposure_pnl(lin="lin_exposure", quad="quad_exposure", log_return="r") -> Column:
    m = F.exp(_c(log_return)) - F.lit(1.0)
    return _c(lin) * m + _c(quad) * m * m
