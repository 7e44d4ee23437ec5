"""Composite risk tables: integrated assessment, ensembles, binding compatibility, enhanced scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.labels import label_text
from assayloom.functions.scores import (
    UNKNOWN_SCORE,
    affinity_to_risk,
    class_risk,
    clip,
    normalise_weights,
    pic50_to_risk,
    regression_risk,
    risk_level,
    shape_class,
)
from assayloom.functions.text import recommendation_text
from assayloom.operators.lookup import ENDPOINTS

# Weights of the two sides, confidences, modifiers of the enhanced score.
ML_WEIGHT, DOCKING_WEIGHT = 0.7, 0.3
DEFAULT_DOMAIN_CONFIDENCE, OUTSIDE_CONFIDENCE = 0.8, 0.5
DOCKED_CONFIDENCE, NOT_DOCKED_CONFIDENCE = 0.9, 0.3
SHAPE_MODIFIER = {"good": 1.1, "poor": 0.8}
PHARMACOPHORE_MODIFIER = {"high": 1.15, "moderate": 1.0, "low": 0.85}
SIZE_MODIFIER = {"poor": 0.9}
# What each binding site prefers. hepatotox and cyp2c9 have no profile.
TARGET_PROFILES = {
    "herg": {
        "preferred_shape": "elongated", "max_volume": 600, "min_aromatic": 1,
        "key_features": ("Aromatic", "HBA", "Hydrophobic"), "risk_threshold": {"n_aromatic": 2, "n_hba": 2},
    },
    "cyp3a4": {
        "preferred_shape": "any", "max_volume": 800, "min_aromatic": 0,
        "key_features": ("HBA", "Hydrophobic"), "risk_threshold": {},
    },
    "cyp2d6": {
        "preferred_shape": "any", "max_volume": 500, "min_aromatic": 1,
        "key_features": ("HBD", "Aromatic", "PosIonizable"), "risk_threshold": {"n_pos_ionizable": 1},
    },
    "ar": {
        "preferred_shape": "flat", "max_volume": 500, "min_aromatic": 1,
        "key_features": ("Aromatic", "HBA", "Hydrophobic"), "risk_threshold": {},
    },
    "er_alpha": {
        "preferred_shape": "flat", "max_volume": 450, "min_aromatic": 2,
        "key_features": ("Aromatic", "HBD", "Hydrophobic"), "risk_threshold": {},
    },
}
# Count column of each pharmacophore type, and type of each feature family.
FEATURE_COLUMNS = {
    "HBA": "n_hba", "HBD": "n_hbd", "Aromatic": "n_aromatic",
    "Hydrophobic": "n_hydrophobic", "PosIonizable": "n_pos_ionizable", "NegIonizable": "n_neg_ionizable",
}
FAMILY_TYPES = {
    "Donor": "HBD", "Acceptor": "HBA", "Aromatic": "Aromatic", "Hydrophobe": "Hydrophobic",
    "PosIonizable": "PosIonizable", "NegIonizable": "NegIonizable", "LumpedHydrophobe": "Hydrophobic",
}


def endpoint_scores(preds: DataFrame) -> DataFrame:
    """Adds score and level to prediction rows (endpoint, task_type, prediction, probability)."""
    score = F.when(
        F.col("task_type") == "regression", regression_risk(F.col("prediction").cast("double"), F.col("endpoint"))
    ).otherwise(class_risk(F.col("probability"), F.col("prediction")))
    return preds.withColumn("score", score).withColumn("level", risk_level(F.col("score")))


def _ranked(scores: DataFrame, key: str, endpoints: Sequence[str], ok: Column) -> DataFrame:
    """One row per key with ``_r``: array of struct(neg, pos, endpoint), highest score first, then by place.

    Scores are first combined per key and endpoint, so a key with very many rows is no burden and the array
    has one entry per endpoint that occurs. Endpoints outside the list come behind it, by name; an endpoint
    scored twice counts with its higher score; a null endpoint has no entry.
    """
    one = scores.groupBy(key, "endpoint").agg(F.max(F.when(ok, F.col("score"))).alias("_s"))
    place = F.array_position(F.array(*map(F.lit, endpoints)), F.col("endpoint"))
    pos = F.when(place > 0, place - 1).otherwise(F.lit(len(endpoints))).cast("int")
    known = F.col("endpoint").isNotNull() & F.col("_s").isNotNull()
    entry = F.when(known, F.struct((-F.col("_s")).alias("neg"), pos.alias("pos"), F.col("endpoint").alias("endpoint")))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_r"))


def integrated_assessment(
    preds: DataFrame, key: str, endpoints: Sequence[str] = ENDPOINTS, ok: str = "success"
) -> DataFrame:
    """One row per key: overall risk (maximum), critical endpoint, ranking, maps, recommendation.

    All endpoints of the rows count; the endpoint list gives the order that decides ties. Keys whose predictions all failed keep a row
    with an error text.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    rows = _ranked(endpoint_scores(preds), key, endpoints, good)
    ranked = F.col("_r")
    top = F.get(ranked, F.lit(0))
    overall = -top["neg"]
    by_pos = F.array_sort(F.transform(ranked, lambda e: F.struct(e["pos"], e["endpoint"], (-e["neg"]).alias("score"))))
    level, critical = risk_level(overall), top["endpoint"]
    return rows.select(
        key,
        F.round(overall, 4).alias("overall_risk_score"),
        level.alias("overall_risk_level"),
        critical.alias("critical_endpoint"),
        F.when(overall != 0, F.round(overall, 4)).alias("critical_endpoint_score"),
        F.map_from_entries(F.transform(by_pos, lambda e: F.struct(e["endpoint"], F.round(e["score"], 4)))).alias("endpoint_risk_scores"),
        F.map_from_entries(F.transform(by_pos, lambda e: F.struct(e["endpoint"], risk_level(e["score"])))).alias("endpoint_risk_levels"),
        F.transform(ranked, lambda e: e["endpoint"]).alias("endpoint_ranking"),
        recommendation_text(level, critical).alias("recommendation"),
        F.when(F.size(ranked) == 0, F.lit("No valid predictions")).alias("error"),
    )


def endpoint_ranking(scores: DataFrame, key: str, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """Endpoints of each key by falling score; endpoint order decides ties."""
    rows = _ranked(scores, key, endpoints, F.lit(True))
    return rows.select(key, F.transform("_r", lambda e: e["endpoint"]).alias("endpoint_ranking"))


def ensemble_columns(ml_weight: float = ML_WEIGHT, docking_weight: float = DOCKING_WEIGHT) -> dict[str, Column]:
    """Ensemble of a prediction row and its docking columns (dock_success, dock_affinity).

    A missing side counts 0.5. Weights are scaled to sum 1; a zero weight stays zero.
    """
    w_ml, w_dock = normalise_weights(ml_weight, docking_weight)
    ml_ok = F.coalesce(F.col("success"), F.lit(False))
    dock_ok = F.coalesce(F.col("dock_success"), F.lit(False))
    from_model = F.when(F.col("task_type") == "regression", pic50_to_risk(F.col("prediction").cast("double"))).otherwise(
        F.coalesce(F.col("probability"), F.col("prediction").cast("double"), F.lit(0.0))
    )
    ml = F.when(ml_ok, from_model).otherwise(F.lit(UNKNOWN_SCORE))
    dock = F.when(dock_ok, affinity_to_risk(F.col("dock_affinity"))).otherwise(F.lit(UNKNOWN_SCORE))
    score = F.lit(w_ml) * ml + F.lit(w_dock) * dock
    return {
        "ensemble_score": F.round(score, 4),
        "risk_level": risk_level(score),
        "ml_score": F.round(ml, 4),
        "ml_weight": F.lit(round(w_ml, 2)),
        "docking_score": F.round(dock, 4),
        "docking_weight": F.lit(round(w_dock, 2)),
        "confidence": ensemble_confidence(ml_ok, dock_ok),
    }


def ensemble_confidence(ml_ok: Column, dock_ok: Column) -> Column:
    """Mean of the factors that apply: domain confidence, docking outcome, agreement of both scores."""
    inside = F.coalesce(F.col("in_domain"), F.lit(True))
    domain = F.when(inside, F.coalesce(F.col("domain_confidence"), F.lit(DEFAULT_DOMAIN_CONFIDENCE))).otherwise(OUTSIDE_CONFIDENCE)
    agreement = F.lit(1.0) - F.abs(
        F.coalesce(F.col("probability"), F.lit(UNKNOWN_SCORE)) - affinity_to_risk(F.col("dock_affinity"))
    )
    factors = F.array_compact(
        F.array(
            F.when(ml_ok, domain),
            F.when(dock_ok, F.lit(DOCKED_CONFIDENCE)).otherwise(NOT_DOCKED_CONFIDENCE),
            F.when(ml_ok & dock_ok, agreement),
        )
    )
    return F.round(F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors), 3)


def ensemble_score(joined: DataFrame, ml_weight: float = ML_WEIGHT, docking_weight: float = DOCKING_WEIGHT) -> DataFrame:
    return joined.withColumns(ensemble_columns(ml_weight, docking_weight))


def _profile_value(target: Column, field) -> Column:
    out = None
    for name, profile in TARGET_PROFILES.items():
        value = field(profile)
        out = F.when(target == name, value) if out is None else out.when(target == name, value)
    return out


def compatibility_columns(target: Column, ok: Column) -> dict[str, Column]:
    """Shape, size, pharmacophore and risk fit of 3D descriptors (npr1, npr2, molecular_volume, counts).

    Unknown targets and failed descriptor rows give "unknown" everywhere.
    """
    t = F.lower(target)
    known = ok & t.isin(*TARGET_PROFILES)
    shape = shape_class(F.col("npr1"), F.col("npr2"))
    preferred = _profile_value(t, lambda p: F.lit(p["preferred_shape"]))
    shape_fit = F.when((preferred == "any") | (shape == preferred), "good").otherwise("moderate")
    volume = F.col("molecular_volume")
    size_fit = F.when(volume <= _profile_value(t, lambda p: F.lit(float(p["max_volume"]))), "good").otherwise("poor")

    def matched(p):
        hits = sum(((F.col(FEATURE_COLUMNS[f]) > 0).cast("int") for f in p["key_features"]), F.lit(0))
        return hits / F.lit(float(len(p["key_features"])))

    def factors(p):
        return sum(((F.col(c) >= cut).cast("int") for c, cut in p["risk_threshold"].items()), F.lit(0))

    ratio, n_factors = _profile_value(t, matched), _profile_value(t, factors)
    unknown = F.lit("unknown")
    return {
        "shape_compatibility": F.when(known & shape.isNotNull(), shape_fit).otherwise(unknown),
        "size_compatibility": F.when(known & (volume > 0), size_fit).otherwise(unknown),
        "pharmacophore_match": F.when(
            known, F.when(ratio >= 0.7, "high").when(ratio >= 0.4, "moderate").otherwise("low")
        ).otherwise(unknown),
        "binding_risk": F.when(
            known, F.when(n_factors >= 2, "high").when(n_factors >= 1, "moderate").otherwise("low")
        ).otherwise(unknown),
        "compatibility_notes": F.array_compact(
            F.array(
                F.when(
                    known & shape.isNotNull() & (shape_fit == "moderate"),
                    F.concat(F.lit("Shape ("), shape, F.lit(") may not be optimal for "), target, F.lit(" binding")),
                ),
                F.when(
                    known & (volume > 0) & (size_fit == "poor"),
                    F.concat(F.lit("Molecule may be too large for "), target, F.lit(" binding site")),
                ),
            )
        ),
    }


def binding_compatibility(df: DataFrame, target: str = "target", ok: str = "descriptors_success") -> DataFrame:
    return df.withColumns(compatibility_columns(F.col(target), F.coalesce(F.col(ok), F.lit(False))))


def _modifier(column: str, table: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for value, factor in table.items():
        out = F.when(F.col(column) == value, F.lit(factor)).otherwise(out)
    return out


def enhanced_score(df: DataFrame, dock_ok: str = "success", descriptors_ok: str = "descriptors_success") -> DataFrame:
    """Docking score times the shape, pharmacophore and size modifiers, clipped; failures give 0.5 / low / unknown."""
    both = F.coalesce(F.col(dock_ok), F.lit(False)) & F.coalesce(F.col(descriptors_ok), F.lit(False))
    base = affinity_to_risk(F.col("affinity"))
    shape, pharm, size = (
        _modifier("shape_compatibility", SHAPE_MODIFIER),
        _modifier("pharmacophore_match", PHARMACOPHORE_MODIFIER),
        _modifier("size_compatibility", SIZE_MODIFIER),
    )
    value = clip(base * shape * pharm * size)
    return df.withColumns(
        {
            "enhanced_score": F.when(both, F.round(value, 4)).otherwise(UNKNOWN_SCORE),
            "base_docking_score": F.when(both, F.round(base, 4)),
            "shape_modifier": F.when(both, shape),
            "pharmacophore_modifier": F.when(both, pharm),
            "size_modifier": F.when(both, size),
            "enhanced_confidence": F.when(both, "high").otherwise("low"),
            "enhanced_risk": F.when(
                both, F.when(value >= 0.7, "high").when(value >= 0.3, "moderate").otherwise("low")
            ).otherwise("unknown"),
        }
    )


def pharm_counts(features: DataFrame, key: str, family: str = "family") -> DataFrame:
    """Counts of the six pharmacophore types per key, from a table of perceived features."""
    types = F.create_map(*[F.lit(x) for pair in FAMILY_TYPES.items() for x in pair])
    kind = F.try_element_at(types, F.col(family))
    return features.groupBy(key).agg(*[F.count_if(kind == name).alias(column) for name, column in FEATURE_COLUMNS.items()])


def endpoint_table(preds: DataFrame) -> DataFrame:
    """Report rows: result text, probability text, level, in-domain flag; failed rows stay, marked ERROR."""
    scored = endpoint_scores(preds)
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    classified = F.col("task_type") != "regression"
    result = F.when(
        classified, F.coalesce(F.col("label"), label_text(F.col("prediction"), F.col("endpoint")))
    ).otherwise(F.format_string("%.2f", F.col("prediction").cast("double")))
    prob = F.when(classified, F.format_string("%.1f%%", F.coalesce(F.col("probability"), F.lit(0.0)) * 100)).otherwise(
        F.coalesce(F.col("unit"), F.lit("pIC50"))
    )
    keep = [c for c in preds.columns if c in ("key", "endpoint", "smiles", "name")]
    dash = F.lit("-")
    return scored.select(
        *keep,
        F.when(failed, "ERROR").otherwise(result).alias("result"),
        F.when(failed, dash).otherwise(prob).alias("probability_text"),
        F.when(failed, dash).otherwise(F.initcap("level")).alias("risk"),
        F.when(~failed, F.coalesce(F.col("in_domain"), F.lit(False))).alias("in_domain"),
    )
