"""Thresholds, as parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """Per cent where a name ends in pct, fractions otherwise."""

    up_limit_pct: float = 9.5
    wide_up_limit_pct: float = 19.5
    down_limit_pct: float = -9.5
    rps_hard_min: float = 80.0
    rps_min: float = 90.0
    inflow_days: int = 3
    volume_ratio: float = 1.5
    min_price: float = 2.0
    scan_low_pct: float = 0.5
    scan_high_pct: float = 9.8
    cap_min_yi: float = 30.0
    cap_max_yi: float = 500.0
    pool_size: int = 15
    account: float = 100_000.0
    risk_share: float = 0.01
    min_amount: float = 5_000.0


def settings(**overrides: object) -> Settings:
    """The defaults with overrides; unknown names and wrong kinds are refused."""
    base = Settings()
    for name, value in overrides.items():
        if not hasattr(base, name):
            raise ValueError(f"no setting named {name}")
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{name} must be a number")
    return replace(base, **overrides)
