"""Scalar functions and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import CATEGORIES, Options

HOUR, DAY, SLOT = 3600, 86_400, 900


def num(x) -> Column:
    return F.col(x).cast("double") if isinstance(x, str) else x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def bucket(ts, size: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c - F.pmod(c, F.lit(size))).cast("long")


def mention_weight(n) -> Column:
    return F.lit(1.0) + F.least(F.greatest(num(n), F.lit(0.0)), F.lit(20.0)) / F.lit(10.0)


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), num(x)))


def unit(v) -> Column:
    """A -10..10 value as -1..1; null is 0."""
    return F.coalesce(clip(num(v) / F.lit(10.0), -1, 1), F.lit(0.0))


def quad_direction(q) -> Column:
    c = F.col(q) if isinstance(q, str) else q
    return F.when(c == 1, 0.4).when(c == 2, 1.0).when(c == 3, -0.4).when(c == 4, -1.0).otherwise(0.0)


def negativity(tone) -> Column:
    return clip(-num(tone) / F.lit(10.0), 0, 1)


def response(density, power: float) -> Column:
    return F.lit(100.0) * F.pow(clip(density, 0, 1), F.lit(power))


def saturation(rate, scale: float) -> Column:
    return F.lit(0.0) if scale <= 0 else clip(F.lit(100.0) * (F.lit(1.0) - F.exp(-F.greatest(F.lit(0.0), num(rate)) / F.lit(float(scale)))), 0, 100)


def evidence(n, prior: float = 20.0) -> Column:
    return F.coalesce(F.round(F.lit(100.0) * num(n) / (num(n) + F.lit(float(prior))), 1), F.lit(0.0))


def shrink(score, ev) -> Column:
    return clip(F.lit(50.0) + (num(score) - F.lit(50.0)) * clip(ev, 0, 100) / F.lit(100.0), 0, 100)


def safe_div(a, b, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num(a), num(b)), F.lit(float(default)))


def risk_level(score) -> Column:
    s = num(score)
    return F.when(s >= 75, "extreme").when(s >= 60, "high").when(s >= 40, "elevated").when(s >= 20, "low").otherwise("minimal")


def iso_stamp(ts) -> Column:
    return F.date_format(F.timestamp_seconds(F.col(ts) if isinstance(ts, str) else ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def add_attitude(df: DataFrame, o: Options = Options()) -> DataFrame:
    """attitude_score, evidence and display columns from summed relation measures."""
    n = F.greatest(num("n_events"), F.lit(1.0))
    direction = safe_div(F.lit(o.attitude[0]) * num("sum_gold_w") + F.lit(o.attitude[1]) * num("sum_quad_w") + F.lit(o.attitude[2]) * num("sum_tone_w"), "sum_w")
    return df.withColumns({
        "evidence": evidence("n_events", o.prior),
        "attitude_score": F.lit(100.0) * direction * evidence("n_events", o.prior) / F.lit(100.0),
        "avg_goldstein": F.lit(10.0) * num("sum_gold") / n,
        "avg_tone": F.lit(10.0) * num("sum_tone") / n,
        "conflict_share": F.lit(100.0) * (num("n_quad3") + num("n_quad4")) / n,
    })


def add_country_risk(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Sub-scores, intensity and risk_score from masses of negative strength."""
    ev = evidence("n_events", o.prior)
    whole = F.when(F.coalesce(num("sum_w"), F.lit(0.0)) == 0, 1.0).otherwise(num("sum_w"))
    tone = F.lit(10.0) * num("sum_tone") / F.greatest(num("n_events"), F.lit(1.0))
    density = [clip(num(f"w_{k}") / whole, 0, 1) for k in ("sec", "soc", "pol")]
    intensity = sum((d * F.lit(w) for d, w in zip(density, o.risk)), F.lit(0.0)) / F.lit(max(o.risk))
    media = clip(F.greatest(F.lit(0.0), -tone) / F.lit(o.tone_divisor) * F.lit(100.0), 0, 100) * ev / F.lit(100.0)
    return df.withColumns({
        "evidence": ev, "avg_tone": tone,
        **{k: response(d, o.power) * ev / F.lit(100.0) for k, d in zip(("security", "social", "political"), density)},
        "media": media,
        "risk_score": F.lit(1 - o.media) * response(intensity, o.power) * ev / F.lit(100.0) + F.lit(o.media) * media,
        "conflict": F.lit(100.0) * (num("n_quad3") + num("n_quad4")) / F.greatest(num("n_events"), F.lit(1.0)),
    })


def add_enterprise_risk(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Densities with the estimate for rows without joint measures, sub-scores and risk_score."""
    total = F.when(F.coalesce(num("total_docs"), F.lit(0.0)) == 0, 1.0).otherwise(num("total_docs"))
    legacy = F.greatest(F.lit(0.0), total - F.coalesce(num("modeled_docs"), F.lit(0.0)))
    mean = F.when(legacy > 0, clip(-((num("sum_tone") - F.coalesce(num("sum_modeled_tone"), F.lit(0.0))) / legacy) / F.lit(10.0), 0, 1)).otherwise(0.0)
    ev = evidence("total_docs", o.prior)
    mass = {c: F.coalesce(num(f"{c}_negative"), F.lit(0.0)) + F.greatest(F.lit(0.0), num(f"{c}_docs") - F.coalesce(num(f"{c}_modeled_docs"), F.lit(0.0))) * mean for c in CATEGORIES}
    mass["negativity"] = F.coalesce(num("sum_negative_tone"), F.lit(0.0)) + legacy * mean
    density = {c: clip(m / total, 0, 1) for c, m in mass.items()}
    score = {c: response(d, o.power) * ev / F.lit(100.0) for c, d in density.items()}
    return df.withColumns({
        "evidence": ev,
        **{f"{c}_density": d for c, d in density.items()},
        **{f"{c}_score": s for c, s in score.items()},
        "risk_score": sum((F.lit(w) * s for w, s in zip(o.enterprise, score.values())), F.lit(0.0)),
        "joint_coverage": F.lit(100.0) * F.coalesce(num("modeled_docs"), F.lit(0.0)) / total,
        "measure": F.when(F.coalesce(num("modeled_docs"), F.lit(0.0)) >= num("total_docs"), "measured").otherwise("legacy-estimate"),
        "avg_tone": num("sum_tone") / F.greatest(num("total_docs"), F.lit(1.0)),
        "avg_polarity": num("sum_polarity") / F.greatest(num("total_docs"), F.lit(1.0)),
    })
