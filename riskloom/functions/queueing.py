"""Exact M/M/1 and M/M/c formulas as column expressions; null where the queue is unstable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(lam: Column, mu: Column) -> Column:
    return (mu > 0) & (lam >= 0) & (lam < mu)


def mm1(lam: Column, mu: Column) -> dict[str, Column]:
    """w, wq, l, lq."""
    ok, rho = stable(lam, mu), lam / F.when(mu != 0, mu)
    return {k: F.when(ok, v) for k, v in {"w": 1 / (mu - lam), "wq": rho / (mu - lam), "l": rho / (1 - rho), "lq": rho * rho / (1 - rho)}.items()}


def mm1_percentile(lam: Column, mu: Column, p: float) -> Column:
    """Time within which a share p of requests leaves the system."""
    return F.when(stable(lam, mu), -F.ln(F.lit(1.0 - p)) / (mu - lam))


def erlang_b(servers: Column, load: Column) -> Column:
    """Blocking probability by the recurrence that stays finite for any number of servers."""
    steps = F.when(servers >= 1, F.sequence(F.lit(1), servers.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda b, k: load * b / (k + load * b))


def mmc(servers: Column, lam: Column, mu: Column) -> dict[str, Column]:
    """c_wait (probability to wait), wq, w."""
    rho = lam / F.when(servers * mu != 0, servers * mu)
    ok = (servers >= 1) & (mu > 0) & (lam >= 0) & (rho < 1)
    b = erlang_b(servers, lam / F.when(mu != 0, mu))
    wait = b / (1 - rho * (1 - b))
    wq = wait / (servers * mu - lam)
    return {"c_wait": F.when(ok, wait), "wq": F.when(ok, wq), "w": F.when(ok, wq + 1 / mu)}


def safe_rps(mu: Column, sla_seconds: float = 0.5) -> Column:
    """Largest arrival rate at which the mean wait stays within the limit."""
    return F.when(mu <= 0, F.lit(0.0)).otherwise(sla_seconds * mu * mu / (1 + sla_seconds * mu))


def queueing_risk(utilization: Column) -> Column:
    """Risk by utilisation: steeper beyond 0.6 and 0.8, 1 from full use on and for values that are no number."""
    u = utilization
    odd = F.isnan(u) | (F.abs(u) == float("inf"))
    return F.when(odd, 1.0).when(u < 0.6, u / 0.6 * 0.3).when(u < 0.8, 0.3 + (u - 0.6) / 0.2 * 0.3).when(u < 1.0, 0.6 + (u - 0.8) / 0.2 * 0.3).otherwise(1.0)
