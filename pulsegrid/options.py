"""Job options, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

ROOTS = tuple(f"{i:02d}" for i in range(1, 21))
#: Theme markers by category, in category order.
THEMES = {
    "security": ("ARMEDCONFLICT", "TERROR", "TERRORISM", "KILL", "KILLING", "WOUND", "WOUNDED", "KIDNAP", "VIOLENCE", "GENERALCRIME", "SECURITY_SERVICES", "MILITARY"),
    "political": ("EPU_POLICY", "ELECTION", "GENERAL_GOVERNMENT", "LEGISLATION", "CORRUPTION", "REGULATION", "SANCTION", "BAN", "POLITICAL"),
    "economic": ("EPU_ECONOMY", "ECON_", "TRADE", "FINANCIAL", "DEBT", "INFLATION", "TAX_ECON_PRICE", "JOBS", "ENTERPRISE", "INDUSTRY"),
    "infrastructure": ("INFRASTRUCTURE", "TRANSPORT", "ENERGY", "POWER", "WATER", "LOGISTICS", "MARITIME", "SUPPLY_CHAIN"),
    "social": ("PROTEST", "UNREST", "LABOR", "MIGRATION", "ARREST", "SOCIAL_PROTECTION"),
    "health": ("GENERAL_HEALTH", "MEDICAL", "DISEASE", "PUBLIC_HEALTH", "PANDEMIC", "HEALTH_NUTRITION"),
}
CATEGORIES = tuple(THEMES)
#: Organisation aliases.
ALIASES = (
    "huawei", "zte", "alibaba", "tencent", "bytedance", "tiktok", "catl", "byd", "sinopec", "petrochina", "cnpc", "cnooc",
    "state grid", "cosco", "lenovo", "xiaomi", "geely", "china mobile", "china telecom", "china railway",
)


@dataclass(frozen=True)
class Options:
    """Weights, root groups and gates of the scores."""

    # The defaults of weights, root groups, gates and codes.
    attitude: tuple[float, float, float] = (0.7, 0.2, 0.1)
    risk: tuple[float, float, float] = (0.5, 0.25, 0.15)
    media: float = 0.1
    enterprise: tuple[float, ...] = (0.24, 0.2, 0.2, 0.14, 0.12, 0.05, 0.05)
    security_roots: tuple[str, ...] = ("15", "18", "19", "20")
    social_roots: tuple[str, ...] = ("14", "17")
    political_roots: tuple[str, ...] = ("10", "11", "12", "13", "16")
    tone_divisor: float = 8.0
    prior: float = 20.0
    power: float = 0.5
    momentum_days: int = 1
    sensitivity: float = 25.0
    min_events: int = 20
    min_docs: int = 20
    home_actor: str = "CHN"
    home_geo: str = "CH"
    excluded_geo: tuple[str, ...] = ("TW", "HK", "MC")
    excluded_actors: tuple[str, ...] = ("TWN", "HKG", "MAC")
    themes: dict = field(default_factory=lambda: THEMES)
    aliases: tuple[str, ...] = ALIASES

    def __post_init__(self):
        for name, group in (("attitude", self.attitude), ("risk", (*self.risk, self.media)), ("enterprise", self.enterprise)):
            if any(not math.isfinite(w) or w < 0 for w in group) or abs(sum(group) - 1) > 1e-6:
                raise ValueError(f"{name} weights must be finite, not negative, and sum to 1")
        roots = [*self.security_roots, *self.social_roots, *self.political_roots]
        if len(set(roots)) != len(roots) or not set(roots) <= set(ROOTS):
            raise ValueError("root groups must be disjoint and made of 01..20")
        if not self.prior > 0 or not 0 < self.power <= 1 or not 1 <= self.momentum_days <= 30:
            raise ValueError("prior > 0, power in (0, 1] and 1..30 momentum days are needed")
        if self.min_events < 1 or self.min_docs < 1:
            raise ValueError("gates are at least 1")
