"""Column expressions for verdicts, severities, confidences and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: str | Column, digits: int = 4) -> Column:
    """Half-up rounding done on decimals, so that every engine gives the same digits."""
    return F.round(_col(c).cast("decimal(24,12)"), digits).cast("double")


def verdict(signature_hit: Column, malicious: Column) -> Column:
    hit, bad = F.coalesce(signature_hit, F.lit(False)), F.coalesce(malicious, F.lit(False))
    return (
        F.when(hit & bad, "confirmed").when(hit, "signature_only").when(bad, "ml_only").otherwise("benign")
    )


def overridden(source: Column, prediction: Column, severity: Column, confidence: Column, s2: Column, s3: Column) -> dict[str, Column]:
    """Headline label, severity and confidence once the verdict is known.

    The model's own family and leaf stay untouched. Where both detectors or only the model fired, the confidence is the
    product of family and leaf probability, if both are there and not zero.
    """
    both = (F.coalesce(s2, F.lit(0.0)) != 0) & (F.coalesce(s3, F.lit(0.0)) != 0)
    product = F.when(both, round_to(s2 * s3)).otherwise(confidence)
    confirmed, signature, model = source == "confirmed", source == "signature_only", source == "ml_only"
    return {
        "prediction": F.when(confirmed | signature, "Malicious").when(model, "Suspicious").otherwise(prediction),
        "severity": F.when(confirmed & (severity == "Low"), "Medium").when(signature, "High").otherwise(severity),
        "confidence": F.when(confirmed | model, product).when(signature, F.lit(0.0)).otherwise(confidence),
    }


def hierarchical_severity(leaf_p: Column, family_p: Column) -> Column:
    (high3, high2), (med3, med2) = fixed.HIER_HIGH, fixed.HIER_MEDIUM
    return (
        F.when((leaf_p >= high3) & (family_p >= high2), "High")
        .when((leaf_p >= med3) & (family_p >= med2), "Medium")
        .otherwise("Low")
    )


def single_severity(p: Column) -> Column:
    return F.when(p > fixed.SINGLE_HIGH, "High").when(p > fixed.SINGLE_MEDIUM, "Medium").otherwise("Low")


def confidence_band(c: str | Column, bands=tuple(fixed.CONFIDENCE_BANDS)) -> Column:
    c = _col(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, low, high in bands:
        out = out.when((c >= low) & (c < high), name)
    return out.when(c >= 0.95, "very_high").otherwise("low")


def severity_rank(severity: str | Column) -> Column:
    s = _col(severity)
    return F.when(s == "High", 3).when(s == "Medium", 2).when(s == "Low", 1).otherwise(0)


def quality(family_p: str | Column) -> Column:
    p = _col(family_p)
    (best, high), (good, medium) = fixed.QUALITY_BANDS
    return F.when(p >= high, best).when(p >= medium, good).when(p.isNotNull(), "Uncertain")


def risk_level(prediction: str | Column, severity: str | Column) -> Column:
    p, s = _col(prediction), _col(severity)
    return (
        F.when(p == "Malicious", F.when(s == "High", "Critical").when(s == "Medium", "High").otherwise("Medium"))
        .when(p == "Suspicious", "Medium")
        .otherwise("None")
    )


def age_bucket(seconds: str | Column) -> Column:
    s = _col(seconds)
    return F.when(s.isNull() | (s < 300), "fresh").when(s < 1800, "aging").when(s < 14400, "stale").otherwise("overdue")


def compact_age(seconds: str | Column) -> Column:
    s = F.floor(_col(seconds))

    def unit(size: int, letter: str) -> Column:
        return F.concat(F.floor(s / size).cast("string"), F.lit(letter))

    return (
        F.when(s.isNull(), "-").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m"))
        .when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
    )


def best_entry(probs: str | Column) -> Column:
    """Most probable entry of a class map as struct(minus_p, label), null for a null map; the alphabetically first label wins
    a tie. The probability is stored negated so that one ``array_min`` finds it."""
    return F.array_min(F.transform(F.map_entries(_col(probs)), lambda e: F.struct((-e["value"]).alias("minus_p"), e["key"].alias("label"))))


def top_entries(probs: str | Column, n: int) -> Column:
    """The ``n`` most probable entries of a class map, most probable first, as array<struct<key,value>>."""
    number = F.map_filter(_col(probs), lambda k, v: v.isNotNull() & ~F.isnan(v))
    pairs = F.array_sort(F.transform(F.map_entries(number), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.transform(F.slice(pairs, 1, n), lambda e: F.struct(e["k"].alias("key"), (-e["n"]).alias("value")))


def chained_confidence(p1: Column, p2: Column, p3: Column) -> Column:
    return round_to(p1 * p2 * p3)
