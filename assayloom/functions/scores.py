"""Scalar scoring rules: affinities, probabilities, weights, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score ranges and cut points that define risk classes.
AFFINITY_STRONGEST, AFFINITY_WEAKEST = -12.0, -4.0
AFFINITY_HIGH, AFFINITY_MODERATE = -8.0, -6.0
RISK_LOW_BELOW, RISK_HIGH_FROM = 0.3, 0.7
PIC50_FLOOR, PIC50_SPAN = 5.0, 3.0
UNKNOWN_SCORE = 0.5
# Van der Waals radii in angstroms, water probe radius, volume per heavy atom.
VDW_RADII = {
    "H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47,
    "P": 1.8, "S": 1.8, "Cl": 1.75, "Br": 1.85, "I": 1.98,
}
DEFAULT_RADIUS, PROBE_RADIUS = 1.7, 1.4
HEAVY_ATOM_VOLUME = 18.0


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Value limited to [low, high]; null stays null (least/greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def affinity_to_risk(affinity: Column) -> Column:
    """Binding energy to 0..1: linear between the weakest and the strongest value, 0.5 when unknown."""
    span = AFFINITY_STRONGEST - AFFINITY_WEAKEST
    return F.coalesce(clip((affinity - F.lit(AFFINITY_WEAKEST)) / F.lit(span)), F.lit(UNKNOWN_SCORE))


def affinity_band(affinity: Column) -> Column:
    return (
        F.when(affinity < AFFINITY_HIGH, "high").when(affinity < AFFINITY_MODERATE, "moderate").otherwise("low")
    )


def regression_risk(value: Column, endpoint: Column) -> Column:
    """pIC50 ramp for herg; other regressions are taken as already scaled and clipped."""
    return F.when(endpoint == "herg", clip((value - PIC50_FLOOR) / PIC50_SPAN)).otherwise(clip(value))


def pic50_to_risk(value: Column) -> Column:
    return clip((value - PIC50_FLOOR) / PIC50_SPAN)


def class_risk(probability: Column, prediction: Column) -> Column:
    return F.coalesce(probability, prediction.cast("double"), F.lit(UNKNOWN_SCORE))


def risk_level(score: Column) -> Column:
    return (
        F.when(score < RISK_LOW_BELOW, "low")
        .when(score < RISK_HIGH_FROM, "moderate")
        .when(score.isNotNull(), "high")
    )


def normalise_weights(first: float, second: float) -> tuple[float, float]:
    """Weights scaled to sum 1. A zero weight is kept; two zeros are an error."""
    total = first + second
    if total == 0:
        raise ValueError("both weights are zero")
    return first / total, second / total


def shape_class(npr1: Column, npr2: Column) -> Column:
    """Rod / disc / sphere corner of the normalised inertia plot; null unless both ratios are positive."""
    return F.when(
        (npr1 > 0) & (npr2 > 0),
        F.when((npr1 < 0.3) & (npr2 > 0.7), "elongated").when((npr1 > 0.6) & (npr2 < 0.4), "flat").otherwise("spherical"),
    )


def vdw_radius(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in VDW_RADII.items() for x in pair])
    return F.coalesce(F.try_element_at(table, element), F.lit(DEFAULT_RADIUS))


def atom_surface(element: Column) -> Column:
    """Half-exposed probe sphere of one atom; a molecule's estimate is the sum over its atoms."""
    r = vdw_radius(element) + F.lit(PROBE_RADIUS)
    return F.lit(4.0) * F.pi() * r * r * F.lit(0.5)


def volume_fallback(heavy_atoms: Column) -> Column:
    return heavy_atoms * F.lit(HEAVY_ATOM_VOLUME)


def log_uniform(low: float, high: float, u: Column) -> Column:
    """Log-uniform value in [low, high) from a uniform draw ``u``."""
    lo, hi = F.log(F.lit(low)), F.log(F.lit(high))
    return F.exp(lo + (hi - lo) * u)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities to null."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def sanitise_name(name: Column) -> Column:
    """Every run of other characters becomes one underscore; outer underscores go; lower case."""
    return F.lower(F.trim(F.regexp_replace(name, "[^\\p{L}\\p{N}]+", "_"), F.lit("_")))
