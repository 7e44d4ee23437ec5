"""Queries over scores, risk tables, screening results, attributions, alerts and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import scores as S
from assayloom.functions import text as W
from assayloom.operators import explain as E
from assayloom.operators import lookup as J
from assayloom.operators import risk as R
from assayloom.operators import screening as G
from assayloom.operators import similarity as Y
from assayloom.operators.validation import rank_in_group, sort_summary
from assayloom.plans import jobs
from assayloom.plans.catalogue import Tables, register
from assayloom.plans.feature_queries import _EMB_SQL
from assayloom.plans.metric_queries import fold_table
from assayloom.sources.tables import spread

# Docking results: one row per (part, target of the supplier) with an affinity from the highest price.
TARGETS = ("herg", "hepatotox", "cyp2d6", "cyp2c9", "ar", "er_alpha")
_TARGET_LIST = "['" + "','".join(TARGETS) + "']"
_DOCK_SQL = f"""
    dock AS (SELECT key, target_pos, ({_TARGET_LIST})[CAST(target_pos AS INTEGER) + 1] AS target, success, CASE WHEN success THEN a END AS affinity FROM
      (SELECT l_partkey AS key, l_suppkey % 6 AS target_pos, 0.5 - max(l_extendedprice) / 8751.0 AS a, bool_or(l_returnflag <> 'N') AS success FROM lineitem GROUP BY 1, 2))"""


def docking(spark, d):
    rows = Tables(spark, d).lineitem.groupBy(F.col("l_partkey").alias("key"), (F.col("l_suppkey") % 6).alias("target_pos")).agg(
        (F.lit(0.5) - F.max("l_extendedprice") / 8751.0).alias("a"), F.bool_or(F.col("l_returnflag") != "N").alias("success")
    )
    names = F.array(*[F.lit(t) for t in TARGETS])
    return rows.select(
        "key", "target_pos", F.element_at(names, (F.col("target_pos") + 1).cast("int")).alias("target"), "success",
        F.when(F.col("success"), F.col("a")).alias("affinity"),
    )


# Predictions: one row per (user, event type); the type stands for an endpoint.
_ENDPOINT_SQL = "CASE event_type WHEN 'view' THEN 'herg' WHEN 'signup' THEN 'hepatotox' WHEN 'purchase' THEN 'nephrotox' WHEN 'error' THEN 'ames' ELSE 'cytotox' END"
_POS_SQL = "CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 5 END"
_PRED_SQL = f"""
    pred AS (SELECT user_id AS key, {_ENDPOINT_SQL} AS endpoint, {_POS_SQL} AS endpoint_pos,
        CASE event_type WHEN 'view' THEN 'regression' ELSE 'classification' END AS task_type,
        CASE event_type WHEN 'view' THEN 5 + max(value) / 101 ELSE CAST(max(value) > 150 AS INTEGER) END AS prediction,
        CASE WHEN event_type NOT IN ('view', 'error') THEN least(1, max(value) / 300) END AS probability,
        min(value) < 3 AS success, avg(value) < 55 AS in_domain, CASE WHEN min(value) < 1 THEN 0.9 END AS domain_confidence
      FROM events GROUP BY user_id, event_type)"""
_SCORE_SQL = """
    scored AS (SELECT *, CASE WHEN task_type = 'regression' THEN least(greatest((prediction - 5) / 3, 0), 1) ELSE coalesce(probability, prediction) END AS score FROM pred),
    lev AS (SELECT *, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'moderate' ELSE 'high' END AS level FROM scored)"""


def predictions(spark, d):
    kind = F.col("event_type")
    rows = Tables(spark, d).events.groupBy("user_id", "event_type").agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mean")
    )
    endpoint = F.when(kind == "view", "herg").when(kind == "signup", "hepatotox").when(kind == "purchase", "nephrotox").when(kind == "error", "ames").otherwise("cytotox")
    pos = F.when(kind == "view", 0).when(kind == "signup", 1).when(kind == "purchase", 2).when(kind == "error", 3).otherwise(5)
    return rows.select(
        F.col("user_id").alias("key"), endpoint.alias("endpoint"), pos.alias("endpoint_pos"),
        F.when(kind == "view", "regression").otherwise("classification").alias("task_type"),
        F.when(kind == "view", F.lit(5) + F.col("hi") / 101).otherwise((F.col("hi") > 150).cast("double")).alias("prediction"),
        F.when(~kind.isin("view", "error"), F.least(F.lit(1.0), F.col("hi") / 300)).alias("probability"),
        (F.col("lo") < 3).alias("success"), (F.col("mean") < 55).alias("in_domain"),
        F.when(F.col("lo") < 1, 0.9).alias("domain_confidence"),
    )


def joined_text(column):
    return F.array_join(column, ",")


@register("endpoint_scores", f"WITH {_PRED_SQL}, {_SCORE_SQL} SELECT key, endpoint, round(score, 6) AS score, level FROM lev")
def endpoint_scores(spark, d):
    return R.endpoint_scores(predictions(spark, d)).select("key", "endpoint", F.round("score", 6).alias("score"), "level")


@register("integrated_assessment", f"""
    WITH {_PRED_SQL}, {_SCORE_SQL},
      a AS (SELECT key, max(score) FILTER (WHERE success) AS o, first(endpoint ORDER BY score DESC, endpoint_pos) FILTER (WHERE success) AS c,
        string_agg(endpoint, ',' ORDER BY score DESC, endpoint_pos) FILTER (WHERE success) AS ranking,
        string_agg(endpoint || ':' || level, ',' ORDER BY endpoint_pos) FILTER (WHERE success) AS levels,
        round(sum(round(score, 4)) FILTER (WHERE success), 4) AS score_sum FROM lev GROUP BY 1)
    SELECT key, round(o, 4) AS overall_risk_score, CASE WHEN o < 0.3 THEN 'low' WHEN o < 0.7 THEN 'moderate' WHEN o >= 0.7 THEN 'high' END AS overall_risk_level, c AS critical_endpoint,
      CASE WHEN o <> 0 THEN round(o, 4) END AS critical_endpoint_score, coalesce(ranking, '') AS endpoint_ranking, coalesce(levels, '') AS endpoint_risk_levels, coalesce(score_sum, 0) AS score_sum,
      CASE WHEN o < 0.3 THEN 'Compound shows low toxicity risk across endpoints' WHEN o < 0.7 THEN 'Monitor ' || c || ' - moderate risk detected'
        WHEN o >= 0.7 THEN 'Caution: High ' || c || ' risk - consider structural optimization' END AS recommendation,
      CASE WHEN o IS NULL THEN 'No valid predictions' END AS error FROM a""")
def integrated_assessment(spark, d):
    out = R.integrated_assessment(predictions(spark, d), "key")
    levels = F.transform(F.map_entries("endpoint_risk_levels"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    total = F.aggregate(F.map_values("endpoint_risk_scores"), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "key", "overall_risk_score", "overall_risk_level", "critical_endpoint", "critical_endpoint_score",
        joined_text("endpoint_ranking").alias("endpoint_ranking"), joined_text(levels).alias("endpoint_risk_levels"),
        F.round(total, 4).alias("score_sum"), "recommendation", "error",
    )


@register("endpoint_ranking", f"""
    WITH {_PRED_SQL}, {_SCORE_SQL} SELECT key, string_agg(endpoint, ',' ORDER BY round(score, 1) DESC, endpoint_pos) AS endpoint_ranking FROM lev GROUP BY 1""")
def endpoint_ranking(spark, d):
    scores = R.endpoint_scores(predictions(spark, d)).withColumn("score", F.round("score", 1))
    return R.endpoint_ranking(scores, "key").withColumn("endpoint_ranking", joined_text("endpoint_ranking"))


@register("endpoint_table", f"""
    WITH {_PRED_SQL}, {_SCORE_SQL} SELECT key, endpoint, CASE WHEN NOT success THEN 'ERROR' WHEN task_type = 'regression' THEN printf('%.2f', prediction)
      WHEN endpoint = 'hepatotox' THEN CASE WHEN prediction = 1 THEN 'Hepatotoxic' ELSE 'Non-hepatotoxic' END
      WHEN endpoint = 'nephrotox' THEN CASE WHEN prediction = 1 THEN 'Nephrotoxic' ELSE 'Non-nephrotoxic' END
      WHEN endpoint = 'ames' THEN CASE WHEN prediction = 1 THEN 'Mutagenic' ELSE 'Non-mutagenic' END
      ELSE CASE WHEN prediction = 1 THEN 'Cytotoxic' ELSE 'Non-cytotoxic' END END AS result,
      CASE WHEN NOT success THEN '-' ELSE upper(level[1]) || level[2:] END AS risk, CASE WHEN success THEN in_domain END AS in_domain FROM lev""")
def endpoint_table(spark, d):
    rows = predictions(spark, d).withColumns({"label": F.lit(None).cast("string"), "unit": F.lit("pIC50")})
    return R.endpoint_table(rows).drop("probability_text")


@register("affinity_risk", f"""
    WITH {_DOCK_SQL} SELECT key, target, round(CASE WHEN affinity IS NULL THEN 0.5 ELSE least(greatest((affinity + 4) / -8, 0), 1) END, 6) AS risk,
      CASE WHEN affinity < -8 THEN 'high' WHEN affinity < -6 THEN 'moderate' ELSE 'low' END AS band FROM dock""")
def affinity_risk(spark, d):
    a = F.col("affinity")
    return docking(spark, d).select("key", "target", F.round(S.affinity_to_risk(a), 6).alias("risk"), S.affinity_band(a).alias("band"))


@register("scalar_scores", """
    SELECT event_id, round(least(greatest((value / 20 - 5) / 3, 0), 1), 6) AS pic50_risk, CASE WHEN value / 100 < 0.3 THEN 'low' WHEN value / 100 < 0.7 THEN 'moderate' ELSE 'high' END AS level,
      round(exp(ln(0.01) + (ln(0.3) - ln(0.01)) * least(value / 500, 1)), 6) AS draw, CAST(user_id * 18 AS DOUBLE) AS volume,
      CASE WHEN user_id > 0 AND value > 0 THEN CASE WHEN value / 100 < 0.3 AND user_id / 150.0 > 0.7 THEN 'elongated' WHEN value / 100 > 0.6 AND user_id / 150.0 < 0.4 THEN 'flat' ELSE 'spherical' END END AS shape FROM events""")
def scalar_scores(spark, d):
    v, u = F.col("value"), F.col("user_id")
    return Tables(spark, d).events.select(
        "event_id", F.round(S.pic50_to_risk(v / 20), 6).alias("pic50_risk"), S.risk_level(v / 100).alias("level"),
        F.round(S.log_uniform(0.01, 0.3, F.least(v / 500, F.lit(1.0))), 6).alias("draw"), S.volume_fallback(u.cast("double")).alias("volume"),
        S.shape_class(v / 100, u / 150.0).alias("shape"),
    )


@register("surface_estimate", """
    WITH a AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 1.7 WHEN 'N' THEN 1.55 ELSE 1.75 END AS r FROM lineitem)
    SELECT l_partkey, round(sum(4 * pi() * (r + 1.4) * (r + 1.4) * 0.5), 3) AS sasa, count(*) AS n_atoms FROM a GROUP BY 1""")
def surface_estimate(spark, d):
    element = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "N").otherwise("Cl")
    return Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.round(F.sum(S.atom_surface(element)), 3).alias("sasa"), F.count(F.lit(1)).alias("n_atoms"))


_BEST_SQL = """best AS (SELECT key, min(affinity) FILTER (WHERE success AND affinity < 0) AS best_affinity,
      first(target ORDER BY affinity, target_pos) FILTER (WHERE success AND affinity < 0) AS best_target FROM dock GROUP BY 1)"""


@register("best_target", f"WITH {_DOCK_SQL}, {_BEST_SQL} SELECT * FROM best")
def best_target(spark, d):
    return G.best_target(docking(spark, d), ["key"])


@register("results_pivot", f"WITH {_DOCK_SQL}, {_BEST_SQL}, w AS (SELECT key, " + ", ".join(
    f"max(affinity) FILTER (WHERE target = '{t}') AS {t}_affinity, coalesce(bool_or(success) FILTER (WHERE target = '{t}'), false) AS {t}_success" for t in TARGETS
) + " FROM dock GROUP BY 1) SELECT w.*, best_affinity, best_target FROM w JOIN best ON w.key = best.key")
def results_pivot(spark, d):
    return G.pivot_results(docking(spark, d), ["key"], TARGETS)


@register("screen_summary", f"""
    WITH {_DOCK_SQL} SELECT target, round(count(*) FILTER (WHERE success) * 100.0 / (SELECT count(DISTINCT key) FROM dock), 4) AS success_rate, round(avg(affinity), 4) AS mean_affinity,
      min(affinity) AS min_affinity, max(affinity) AS max_affinity, round(stddev_pop(affinity), 4) AS std_affinity, count(*) FILTER (WHERE affinity < -8) AS strong_binders,
      count(*) FILTER (WHERE affinity >= -8 AND affinity < -6) AS moderate_binders, count(*) FILTER (WHERE affinity >= -6) AS weak_binders FROM dock GROUP BY 1""")
def screen_summary(spark, d):
    out = G.screen_summary(docking(spark, d), "key")
    return out.withColumns({c: F.round(c, 4) for c in ("success_rate", "mean_affinity", "std_affinity")})


@register("risk_distribution", f"""
    WITH {_DOCK_SQL}, {_BEST_SQL} SELECT count(*) FILTER (WHERE best_affinity < -8) AS high_risk, count(*) FILTER (WHERE best_affinity >= -8 AND best_affinity < -6) AS moderate_risk,
      count(*) FILTER (WHERE best_affinity >= -6) AS low_risk, count(*) FILTER (WHERE best_affinity IS NULL) AS no_binding_data FROM best""")
def risk_distribution(spark, d):
    return G.risk_distribution(best_target(spark, d))


@register("batch_totals", f"WITH {_DOCK_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful FROM dock")
def batch_totals(spark, d):
    return G.batch_totals(docking(spark, d))


@register("docking_features", f"WITH {_DOCK_SQL} SELECT key, " + ", ".join(
    f"coalesce(max(affinity) FILTER (WHERE target = '{t}' AND success), 0) AS dock_{t}_affinity, "
    f"round(coalesce(max(least(greatest((affinity + 4) / -8, 0), 1)) FILTER (WHERE target = '{t}' AND success), 0.5), 6) AS dock_{t}_score, "
    f"CAST(coalesce(bool_or(success) FILTER (WHERE target = '{t}'), false) AS INTEGER) * 1.0 AS dock_{t}_success" for t in TARGETS
) + " FROM dock GROUP BY 1")
def docking_features(spark, d):
    out = G.docking_features(docking(spark, d), "key", TARGETS)
    return out.withColumns({f"dock_{t}_score": F.round(f"dock_{t}_score", 6) for t in TARGETS})


_MLDOCK_SQL = """
    j AS (SELECT pred.*, CASE endpoint WHEN 'hepatotox' THEN 'hepatotox' WHEN 'ames' THEN NULL ELSE 'herg' END AS target FROM pred),
    e AS (SELECT j.*, coalesce(dock.success, false) AS ds, dock.affinity AS da FROM j LEFT JOIN dock ON j.key = dock.key AND j.target = dock.target)"""


@register("ml_with_docking", f"WITH {_PRED_SQL}, {_DOCK_SQL}, {_MLDOCK_SQL} SELECT key, endpoint, target, ds AS dock_success, da AS dock_affinity FROM e")
def ml_with_docking(spark, d):
    out = J.ml_with_docking(predictions(spark, d), docking(spark, d), "key")
    return out.select("key", "endpoint", "target", F.coalesce("dock_success", F.lit(False)).alias("dock_success"), "dock_affinity")


@register("ensemble_score", f"""
    WITH {_PRED_SQL}, {_DOCK_SQL}, {_MLDOCK_SQL},
      s AS (SELECT *, CASE WHEN NOT success THEN 0.5 WHEN task_type = 'regression' THEN least(greatest((prediction - 5) / 3, 0), 1) ELSE coalesce(probability, prediction) END AS ml,
        CASE WHEN ds THEN coalesce(least(greatest((da + 4) / -8, 0), 1), 0.5) ELSE 0.5 END AS dk FROM e),
      t AS (SELECT *, 0.7 * ml + 0.3 * dk AS sc FROM s)
    SELECT key, endpoint, round(sc, 4) AS ensemble_score, CASE WHEN sc < 0.3 THEN 'low' WHEN sc < 0.7 THEN 'moderate' ELSE 'high' END AS risk_level, round(ml, 4) AS ml_score, 0.7 AS ml_weight,
      round(dk, 4) AS docking_score, 0.3 AS docking_weight FROM t""")
def ensemble_score(spark, d):
    out = R.ensemble_score(J.ml_with_docking(predictions(spark, d), docking(spark, d), "key"), 7, 3)
    return out.select("key", "endpoint", "ensemble_score", "risk_level", "ml_score", "ml_weight", "docking_score", "docking_weight")


@register("ensemble_confidence", f"""
    WITH {_PRED_SQL}, {_DOCK_SQL}, {_MLDOCK_SQL},
      f AS (SELECT key, endpoint, CASE WHEN success THEN CASE WHEN in_domain THEN coalesce(domain_confidence, 0.8) ELSE 0.5 END END AS f1, CASE WHEN ds THEN 0.9 ELSE 0.3 END AS f2,
        CASE WHEN success AND ds THEN 1 - abs(coalesce(probability, 0.5) - coalesce(least(greatest((da + 4) / -8, 0), 1), 0.5)) END AS f3 FROM e)
    SELECT key, endpoint, round((coalesce(f1, 0) + f2 + coalesce(f3, 0)) / (1 + CAST(f1 IS NOT NULL AS INTEGER) + CAST(f3 IS NOT NULL AS INTEGER)), 3) AS confidence FROM f""")
def ensemble_confidence(spark, d):
    out = R.ensemble_score(J.ml_with_docking(predictions(spark, d), docking(spark, d), "key"))
    return out.select("key", "endpoint", "confidence")


# 3D descriptors per part, from its own columns; cyp3a4 replaces hepatotox so that every profile occurs.
_DESC_SQL = """
    des AS (SELECT p_partkey AS key, p_size <> 13 AS dok, (p_partkey % 10) / 10.0 AS npr1, (p_size % 11) / 10.0 AS npr2, p_retailprice / 2 - p_size * 5 AS vol, p_size % 4 AS n_hba, p_size % 3 AS n_hbd,
      p_partkey % 4 AS n_aromatic, p_partkey % 2 AS n_hydrophobic, p_size % 2 AS n_pos, 0 AS n_neg FROM part),
    prof(target, shape, maxvol) AS (VALUES ('herg', 'elongated', 600), ('cyp3a4', 'any', 800), ('cyp2d6', 'any', 500), ('ar', 'flat', 500), ('er_alpha', 'flat', 450)),
    rows_ AS (SELECT dock.key, CASE WHEN dock.target = 'hepatotox' THEN 'cyp3a4' ELSE dock.target END AS target, target_pos, success, affinity, des.* EXCLUDE (key) FROM dock JOIN des ON dock.key = des.key),
    sh AS (SELECT r.*, p.shape AS pref, maxvol, CASE WHEN npr1 > 0 AND npr2 > 0 THEN CASE WHEN npr1 < 0.3 AND npr2 > 0.7 THEN 'elongated' WHEN npr1 > 0.6 AND npr2 < 0.4 THEN 'flat' ELSE 'spherical' END END AS shp,
      CASE r.target WHEN 'herg' THEN ((n_aromatic > 0)::INT + (n_hba > 0)::INT + (n_hydrophobic > 0)::INT) / 3.0 WHEN 'cyp3a4' THEN ((n_hba > 0)::INT + (n_hydrophobic > 0)::INT) / 2.0
        WHEN 'cyp2d6' THEN ((n_hbd > 0)::INT + (n_aromatic > 0)::INT + (n_pos > 0)::INT) / 3.0 WHEN 'ar' THEN ((n_aromatic > 0)::INT + (n_hba > 0)::INT + (n_hydrophobic > 0)::INT) / 3.0
        WHEN 'er_alpha' THEN ((n_aromatic > 0)::INT + (n_hbd > 0)::INT + (n_hydrophobic > 0)::INT) / 3.0 END AS ratio,
      CASE r.target WHEN 'herg' THEN (n_aromatic >= 2)::INT + (n_hba >= 2)::INT WHEN 'cyp2d6' THEN (n_pos >= 1)::INT ELSE 0 END AS nrisk
      FROM rows_ r LEFT JOIN prof p ON r.target = p.target),
    comp AS (SELECT *, dok AND pref IS NOT NULL AS known FROM sh),
    fit AS (SELECT *, CASE WHEN known AND shp IS NOT NULL THEN CASE WHEN pref = 'any' OR shp = pref THEN 'good' ELSE 'moderate' END ELSE 'unknown' END AS shape_compatibility,
      CASE WHEN known AND vol > 0 THEN CASE WHEN vol <= maxvol THEN 'good' ELSE 'poor' END ELSE 'unknown' END AS size_compatibility,
      CASE WHEN known THEN CASE WHEN ratio >= 0.7 THEN 'high' WHEN ratio >= 0.4 THEN 'moderate' ELSE 'low' END ELSE 'unknown' END AS pharmacophore_match,
      CASE WHEN known THEN CASE WHEN nrisk >= 2 THEN 'high' WHEN nrisk >= 1 THEN 'moderate' ELSE 'low' END ELSE 'unknown' END AS binding_risk FROM comp),
    enh AS (SELECT *, success AND dok AS both_ok, least(greatest(least(greatest((affinity + 4) / -8, 0), 1) * CASE shape_compatibility WHEN 'good' THEN 1.1 ELSE 1.0 END
      * CASE pharmacophore_match WHEN 'high' THEN 1.15 WHEN 'low' THEN 0.85 ELSE 1.0 END * CASE size_compatibility WHEN 'poor' THEN 0.9 ELSE 1.0 END, 0), 1) AS ev FROM fit),
    es AS (SELECT *, CASE WHEN both_ok THEN round(ev, 4) ELSE 0.5 END AS enhanced_score, CASE WHEN both_ok THEN CASE WHEN ev >= 0.7 THEN 'high' WHEN ev >= 0.3 THEN 'moderate' ELSE 'low' END ELSE 'unknown' END AS enhanced_risk FROM enh)"""


def descriptors(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    return Tables(spark, d).part.select(
        key.alias("key"), (size != 13).alias("descriptors_success"), ((key % 10) / 10.0).alias("npr1"), ((size % 11) / 10.0).alias("npr2"),
        (F.col("p_retailprice") / 2 - size * 5).alias("molecular_volume"), (size % 4).alias("n_hba"), (size % 3).alias("n_hbd"), (key % 4).alias("n_aromatic"),
        (key % 2).alias("n_hydrophobic"), (size % 2).alias("n_pos_ionizable"), F.lit(0).alias("n_neg_ionizable"),
    )


def compatible(spark, d):
    rows = docking(spark, d).join(descriptors(spark, d), "key")
    rows = rows.withColumn("target", F.when(F.col("target") == "hepatotox", "cyp3a4").otherwise(F.col("target")))
    return R.binding_compatibility(rows)


@register("binding_compatibility", f"""
    WITH {_DOCK_SQL}, {_DESC_SQL} SELECT key, target, shape_compatibility, size_compatibility, pharmacophore_match, binding_risk,
      concat_ws('; ', CASE WHEN shape_compatibility = 'moderate' THEN 'Shape (' || shp || ') may not be optimal for ' || target || ' binding' END,
        CASE WHEN size_compatibility = 'poor' THEN 'Molecule may be too large for ' || target || ' binding site' END) AS notes FROM fit""")
def binding_compatibility(spark, d):
    return compatible(spark, d).select(
        "key", "target", "shape_compatibility", "size_compatibility", "pharmacophore_match", "binding_risk", F.array_join("compatibility_notes", "; ").alias("notes")
    )


@register("enhanced_score", f"WITH {_DOCK_SQL}, {_DESC_SQL} SELECT key, target, enhanced_score, enhanced_risk, CASE WHEN both_ok THEN 'high' ELSE 'low' END AS enhanced_confidence FROM es")
def enhanced_score(spark, d):
    return R.enhanced_score(compatible(spark, d)).select("key", "target", "enhanced_score", "enhanced_risk", "enhanced_confidence")


_VERDICT_SQL = "CASE WHEN coalesce(max(enhanced_score), 0) >= 0.7 THEN 'high' WHEN coalesce(max(enhanced_score), 0) >= 0.4 THEN 'moderate' ELSE 'low' END"


@register("endpoint_summary", f"""
    WITH {_DOCK_SQL}, {_DESC_SQL} SELECT key, count(*) AS num_targets, count(affinity) AS successful_docks, round(min(affinity), 2) AS best_affinity, round(max(enhanced_score), 4) AS max_enhanced_score,
      coalesce(string_agg(target, ',' ORDER BY list_position(['herg', 'hepatotox', 'cyp3a4', 'cyp2d6', 'cyp2c9', 'ar', 'er_alpha'], target)) FILTER (WHERE enhanced_risk = 'high'), '') AS high_risk_targets, {_VERDICT_SQL} AS overall_risk FROM es GROUP BY 1""")
def endpoint_summary(spark, d):
    out = G.endpoint_summary(R.enhanced_score(compatible(spark, d)), ["key"])
    return out.select("key", "num_targets", "successful_docks", "best_affinity", "max_enhanced_score", joined_text("high_risk_targets").alias("high_risk_targets"), "overall_risk")


@register("enhanced_by_endpoint", """
    WITH """ + _DOCK_SQL + """, m(endpoint, target_pos, target) AS (VALUES ('hepatotox', 0, 'hepatotox'), ('hepatotox', 1, 'cyp2d6'), ('hepatotox', 2, 'cyp2c9'), ('reproductive_tox', 0, 'ar'), ('reproductive_tox', 1, 'er_alpha')),
      p AS (SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN 'hepatotox' WHEN p_size > 10 THEN 'reproductive_tox' ELSE 'ames' END AS endpoint FROM part)
    SELECT p.key, p.endpoint, count(*) AS num_targets, count(dock.affinity) AS successful_docks, round(min(dock.affinity), 2) AS best_affinity
    FROM p JOIN m ON p.endpoint = m.endpoint LEFT JOIN dock ON dock.key = p.key AND dock.target = m.target GROUP BY ALL""")
def enhanced_by_endpoint(spark, d):
    size = Tables(spark, d).part.select(F.col("p_partkey").alias("key"), "p_size")
    endpoint = F.when(F.col("p_size") > 25, "hepatotox").when(F.col("p_size") > 10, "reproductive_tox").otherwise("ames")
    rows = descriptors(spark, d).join(size, "key").withColumn("endpoint", endpoint)
    _, summary = jobs.enhanced_by_endpoint(rows, docking(spark, d).drop("target_pos"), "key")
    return summary.select("key", "endpoint", "num_targets", "successful_docks", "best_affinity")


@register("enhanced_by_target", """
    WITH """ + _DOCK_SQL + """ SELECT p_partkey AS key, affinity, coalesce(success, false) AND p_size <> 13 AS both_ok FROM part LEFT JOIN dock ON key = p_partkey AND target = 'herg'""")
def enhanced_by_target(spark, d):
    out = jobs.enhanced_by_target(descriptors(spark, d), docking(spark, d).drop("target_pos"), "key", "herg")
    return out.select("key", "affinity", (F.col("enhanced_risk") != "unknown").alias("both_ok"))


@register("pharm_counts", """
    SELECT l_partkey AS key, count(*) FILTER (WHERE l_suppkey % 8 = 0) AS n_hbd, count(*) FILTER (WHERE l_suppkey % 8 = 1) AS n_hba, count(*) FILTER (WHERE l_suppkey % 8 = 2) AS n_aromatic,
      count(*) FILTER (WHERE l_suppkey % 8 IN (3, 6)) AS n_hydrophobic, count(*) FILTER (WHERE l_suppkey % 8 = 4) AS n_pos_ionizable, count(*) FILTER (WHERE l_suppkey % 8 = 5) AS n_neg_ionizable FROM lineitem GROUP BY 1""")
def pharm_counts(spark, d):
    families = F.array(*[F.lit(f) for f in ("Donor", "Acceptor", "Aromatic", "Hydrophobe", "PosIonizable", "NegIonizable", "LumpedHydrophobe", "Other")])
    rows = Tables(spark, d).lineitem.select(F.col("l_partkey").alias("key"), F.element_at(families, (F.col("l_suppkey") % 8 + 1).cast("int")).alias("family"))
    return R.pharm_counts(rows, "key")


@register("pharmacophore_notes", f"""
    WITH {_DOCK_SQL}, {_DESC_SQL} SELECT key, concat_ws('; ', CASE WHEN n_aromatic >= 2 THEN 'Multiple aromatic rings may increase hERG binding risk' END,
      CASE WHEN n_hba + n_hbd >= 5 THEN 'High HBA count - good for solubility, may affect permeability' END, CASE WHEN n_pos >= 1 THEN 'Positive ionizable groups increase CYP2D6 binding likelihood' END) AS notes FROM des""")
def pharmacophore_notes(spark, d):
    notes = W.pharmacophore_notes(n_aromatic=F.col("n_aromatic"), n_hba=F.col("n_hba") + F.col("n_hbd"), n_pos_ionizable=F.col("n_pos_ionizable"))
    return descriptors(spark, d).select("key", F.array_join(notes, "; ").alias("notes"))


@register("override_config", """
    SELECT n_nationkey AS target, CASE WHEN n_nationkey < 5 THEN r_name ELSE n_name END AS name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey""")
def override_config(spark, d):
    t = Tables(spark, d)
    defaults = t.nation.select(F.col("n_nationkey").alias("target"), F.col("n_name").alias("name"))
    return G.override_config(defaults, t.region.select(F.col("r_regionkey").alias("target"), F.col("r_name").alias("name")))


@register("screen_library", f"""
    WITH {_DOCK_SQL}, lib AS (SELECT p_partkey AS pos, p_name AS name, 'S' || p_partkey AS smiles FROM part),
      r AS (SELECT lib.*, t.tp, t.target, coalesce(dock.success, false) AS success, dock.affinity FROM lib, (VALUES (0, 'herg'), (1, 'cyp2d6')) t(tp, target) LEFT JOIN dock ON dock.key = lib.pos AND dock.target = t.target)
    SELECT pos, name, smiles, min(affinity) FILTER (WHERE success AND affinity < 0) AS best_affinity, first(target ORDER BY affinity, tp) FILTER (WHERE success AND affinity < 0) AS best_target,
      max(affinity) FILTER (WHERE target = 'herg') AS herg_affinity, bool_or(success) FILTER (WHERE target = 'herg') AS herg_success,
      max(affinity) FILTER (WHERE target = 'cyp2d6') AS cyp2d6_affinity, bool_or(success) FILTER (WHERE target = 'cyp2d6') AS cyp2d6_success FROM r GROUP BY ALL""")
def screen_library(spark, d):
    part = Tables(spark, d).part.select(F.col("p_name").alias("name"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("smiles"), "p_partkey")
    results = docking(spark, d).select(F.concat(F.lit("S"), F.col("key").cast("string")).alias("smiles"), "target", "success", "affinity")
    scorer = lambda requests: requests.select("smiles", "target").join(results, ["smiles", "target"])
    return jobs.screen(part, "p_partkey", ["herg", "cyp2d6"], scorer)["wide"]


_TOP_SQL = f"""
    top AS (SELECT vec_id, label, idx, x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, idx) AS rk FROM {_EMB_SQL})"""


@register("top_features", f"""
    WITH {_TOP_SQL} SELECT vec_id, CAST(rk AS INTEGER) AS rank, idx, round(x, 6) AS value, CASE WHEN x > 0 THEN 'increases' ELSE 'decreases' END AS contribution FROM top WHERE rk <= 10""")
def top_features(spark, d):
    rows = Tables(spark, d).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = E.top_features(rows, "v", 10, keep=["vec_id"])
    return out.select("vec_id", "rank", "idx", F.round("value", 6).alias("value"), "contribution")


# Attribution of endpoint = label within panels of fifty vectors: mean value per dimension.
_PANEL_SQL = f"""
    pan AS (SELECT vec_id // 100 AS panel, label AS endpoint, idx, round(avg(x), 9) AS x FROM {_EMB_SQL} GROUP BY ALL),
    pt AS (SELECT *, 'f' || idx AS feature, row_number() OVER (PARTITION BY panel, endpoint ORDER BY abs(x) DESC, 'f' || idx) AS rk FROM pan)"""


def panel_top(spark, d):
    e = Tables(spark, d).embeddings
    long = e.select(F.floor(F.col("vec_id") / 100).alias("panel"), F.col("label").alias("endpoint"), F.posexplode("embedding").alias("idx", "x"))
    mean = long.groupBy("panel", "endpoint", "idx").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("value"))
    mean = mean.withColumn("feature", F.concat(F.lit("f"), F.col("idx").cast("string")))
    return E.top_features_long(mean, ["panel", "endpoint"], "feature", "value", 10)


@register("top_features_long", f"WITH {_PANEL_SQL} SELECT panel, endpoint, feature, CAST(rk AS INTEGER) AS rank, round(x, 6) AS value FROM pt WHERE rk <= 10")
def top_features_long(spark, d):
    return panel_top(spark, d).select("panel", "endpoint", "feature", "rank", F.round("value", 6).alias("value"))


@register("common_features", f"""
    WITH {_PANEL_SQL}, c AS (SELECT panel, feature, count(*) AS n, string_agg(endpoint || CASE WHEN x > 0 THEN '+' ELSE '-' END, ',' ORDER BY endpoint) AS impacts FROM pt WHERE rk <= 10 GROUP BY ALL HAVING count(*) >= 2)
    SELECT panel, feature, n AS endpoints_affected, impacts, CAST(pl AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, feature) AS pl FROM c) WHERE pl <= 10""")
def common_features(spark, d):
    out = E.common_features(panel_top(spark, d), ["panel"])
    sign = F.transform("impacts", lambda i: F.concat(i["endpoint"].cast("string"), F.when(i["value"] > 0, "+").otherwise("-")))
    return out.select("panel", "feature", "endpoints_affected", joined_text(sign).alias("impacts"), "place")


@register("opposite_effects", f"""
    WITH {_PANEL_SQL}, o AS (SELECT panel, feature, min(endpoint) AS a, list_sort(list(DISTINCT endpoint))[2] AS b FROM pt WHERE rk <= 5 GROUP BY ALL HAVING min(sign(x)) <> max(sign(x)))
    SELECT panel, feature, CAST(pl AS INTEGER) AS place, '''' || feature || ''' has opposite effects on ' || a || ' vs ' || b AS insight
    FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY feature) AS pl FROM o) WHERE pl <= 5""")
def opposite_effects(spark, d):
    return E.opposite_effects(panel_top(spark, d), ["panel"])


# Feature names of the 64 dimensions: named descriptors, then two families of bits.
FEATURE_NAMES = [*W.PHYSICOCHEMICAL, *[f"Morgan_{i}" for i in range(20)], *[f"MACCS_{i}" for i in range(15)], *[f"x{i}" for i in range(4)]]
_NAMED_SQL = "(['" + "','".join(FEATURE_NAMES) + "'])[idx + 1]"
_CATEGORY_SQL = "CASE WHEN idx < 25 THEN 'physicochemical' WHEN idx < 45 THEN 'structural_fingerprints' WHEN idx < 60 THEN 'substructure_keys' ELSE 'uncategorised' END"


def named_top(spark, d, k):
    rows = Tables(spark, d).embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return E.top_features(rows, "v", k, FEATURE_NAMES, ["vec_id", "label"])


@register("feature_category", f"WITH {_TOP_SQL} SELECT {_CATEGORY_SQL} AS category, {_NAMED_SQL} AS feature, count(*) AS n FROM top WHERE rk <= 10 GROUP BY ALL")
def feature_category(spark, d):
    return E.categorise(named_top(spark, d, 10)).groupBy("category", "feature").agg(F.count(F.lit(1)).alias("n"))


@register("interpretation_text", f"""
    WITH {_TOP_SQL}, n AS (SELECT *, {_NAMED_SQL} AS f FROM top WHERE rk <= 10),
      u AS (SELECT vec_id, f, rk, x, row_number() OVER (PARTITION BY vec_id, x > 0 ORDER BY rk) AS sr FROM n)
    SELECT vec_id, concat_ws('; ', 'Features increasing mutagenicity risk: ' || string_agg(f, ', ' ORDER BY rk) FILTER (WHERE x > 0 AND sr <= 3),
      'Features decreasing mutagenicity risk: ' || string_agg(f, ', ' ORDER BY rk) FILTER (WHERE x < 0 AND sr <= 3),
      string_agg(CASE f WHEN 'MolWt' THEN 'Molecular weight' WHEN 'MolLogP' THEN 'Lipophilicity (LogP)' WHEN 'TPSA' THEN 'Polar surface area' WHEN 'NumHDonors' THEN 'H-bond donors'
        WHEN 'NumHAcceptors' THEN 'H-bond acceptors' ELSE 'Aromatic ring count' END || CASE WHEN x > 0 THEN ' increases' ELSE ' decreases' END || ' mutagenicity risk', '; ' ORDER BY rk)
        FILTER (WHERE rk <= 5 AND f IN ('MolWt', 'MolLogP', 'TPSA', 'NumHDonors', 'NumHAcceptors', 'NumAromaticRings'))) AS text FROM u GROUP BY 1""")
def interpretation_text(spark, d):
    rows = Tables(spark, d).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", W.interpretation_text(E.top_of_array(F.col("v"), 10, FEATURE_NAMES), F.lit("ames")).alias("text"))


# Text patterns counted in whole pages: (alert, pattern, concern, severity).
PAGE_RULES = (
    ("script", "<script[^>]*>", "Inline code", "high"),
    ("anchor", "<a href=", "Outgoing links", "low"),
    ("paragraph", "<p>", "Prose", "low"),
    ("advert", "class=\"ad\"", "Advertising", "high"),
    ("digits", "[0-9]{3,}", "Long numbers", "moderate"),
    ("marks", "[%#*]{3}", "Mark-up noise", "high"),
)
_RULES_SQL = " UNION ALL ".join(
    f"SELECT page_id, '{a}' AS alert, '{c}' AS concern, '{s}' AS severity, CAST(len(regexp_extract_all(html, '{p}')) AS INTEGER) AS occurrences FROM pages" for a, p, c, s in PAGE_RULES
)


@register("alert_counts", f"SELECT * FROM ({_RULES_SQL}) WHERE occurrences > 0")
def alert_counts(spark, d):
    return E.alert_counts(spread(Tables(spark, d).pages), "html", PAGE_RULES, ["page_id"])


@register("annotate_alerts", """
    SELECT p_partkey, alert, CASE alert WHEN 'quinone' THEN 'Cytotoxicity, oxidative stress' WHEN 'furan' THEN 'Hepatotoxicity (metabolic activation)' WHEN 'hydrazine' THEN 'Hepatotoxicity, mutagenicity' END AS concern,
      CASE alert WHEN 'quinone' THEN 'moderate' WHEN 'furan' THEN 'moderate' WHEN 'hydrazine' THEN 'high' END AS severity
    FROM (SELECT p_partkey, (['quinone', 'furan', 'hydrazine', 'other'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS alert FROM part)""")
def annotate_alerts(spark, d):
    names = F.array(*[F.lit(a) for a in ("quinone", "furan", "hydrazine", "other")])
    return E.annotate_alerts(Tables(spark, d).part.select("p_partkey", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("alert")))


@register("recommendations", f"""
    WITH {_TOP_SQL}, a AS (SELECT page_id AS key, alert, concern FROM ({_RULES_SQL}) WHERE occurrences > 0 AND severity = 'high'),
      recs AS (SELECT key, 'high' AS priority, 'structural_modification' AS type, 'Consider removing or replacing ' || alert || ' moiety' AS recommendation, concern AS reason, 0 AS src, alert AS spot FROM a
        UNION ALL SELECT vec_id, CASE WHEN f = 'MolWt' THEN 'low' ELSE 'medium' END, CASE WHEN f = 'NumAromaticRings' THEN 'structural_modification' ELSE 'property_optimization' END,
          CASE f WHEN 'MolLogP' THEN 'Consider reducing lipophilicity (LogP)' WHEN 'MolWt' THEN 'Consider reducing molecular weight' ELSE 'Consider reducing aromatic ring count' END,
          CASE f WHEN 'MolLogP' THEN 'High LogP contributes to ' WHEN 'MolWt' THEN 'High MW contributes to ' ELSE 'Aromatic rings contribute to ' END || label || ' risk', 1, label || '|' || rk
        FROM (SELECT *, {_NAMED_SQL} AS f FROM top WHERE rk <= 3 AND x > 0) WHERE f IN ('MolLogP', 'MolWt', 'NumAromaticRings')),
      one AS (SELECT *, row_number() OVER (PARTITION BY key, recommendation ORDER BY src, spot) AS dup FROM recs)
    SELECT key, priority, type, recommendation, reason, CAST(row_number() OVER (PARTITION BY key ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, src, spot) AS INTEGER) AS place FROM one WHERE dup = 1""")
def recommendations(spark, d):
    alerts = alert_counts(spark, d).withColumnRenamed("page_id", "key")
    top = named_top(spark, d, 3).withColumnRenamed("vec_id", "key").withColumnRenamed("label", "endpoint")
    return E.design_recommendations(alerts, top, ["key"])


@register("linear_attribution", f"""
    WITH e AS (SELECT * FROM {_EMB_SQL}), m AS (SELECT idx, avg(x) AS mu, avg(x) FILTER (WHERE label >= 5) - avg(x) FILTER (WHERE label < 5) AS c FROM e GROUP BY 1)
    SELECT vec_id, round(sum(c * (x - mu)), 6) + 0.0 AS attribution_sum FROM e JOIN m ON e.idx = m.idx GROUP BY 1""")
def linear_attribution(spark, d):
    rows = Tables(spark, d).embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    long = rows.select("label", F.posexplode("v").alias("idx", "x")).groupBy("idx").agg(
        F.avg("x").alias("mu"), (F.avg(F.when(F.col("label") >= 5, F.col("x"))) - F.avg(F.when(F.col("label") < 5, F.col("x")))).alias("c")
    )
    state = long.orderBy("idx").collect()
    out = E.linear_attribution(rows, "v", [r.c for r in state], [r.mu for r in state])
    return out.select("vec_id", (F.round("attribution_sum", 6) + F.lit(0.0)).alias("attribution_sum"))


@register("sort_summary", "SELECT model, representation, CAST(row_number() OVER (ORDER BY model, representation) AS INTEGER) AS place FROM (SELECT DISTINCT l_returnflag AS model FROM lineitem), (VALUES ('2D'), ('3D'), ('Hybrid')) r(representation)")
def sort_summary_query(spark, d):
    rows = sort_summary(fold_table(spark, d).select("model", "representation").distinct())
    every = rows.groupBy().agg(F.collect_list(F.struct("model", "representation")).alias("r"))
    return every.select(F.posexplode("r").alias("p", "r")).select("r.model", "r.representation", (F.col("p") + 1).alias("place"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
_BITS = "list_sort(list_distinct(list_transform(" + _WORDS + ", lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 2048 AS INTEGER))))"


def fingerprints(df, key, text="text"):
    return spread(df).select(key, Y.hashed_fingerprint(F.col(text), method="md5").alias("bits"))


@register("fingerprint_bits", f"""
    SELECT doc_id, len(b) AS n_bits, CAST(coalesce(list_sum(b), 0) AS BIGINT) AS bit_sum, b[1] AS first_bit FROM (SELECT doc_id, {_BITS.format(t='text')} AS b FROM documents)""")
def fingerprint_bits(spark, d):
    rows = fingerprints(Tables(spark, d).documents, "doc_id")
    total = F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("bits").cast("long").alias("n_bits"), total.alias("bit_sum"), F.get("bits", F.lit(0)).alias("first_bit"))


@register("tanimoto_pairs", f"""
    WITH f AS (SELECT doc_id, {_BITS.format(t='text')} AS b FROM documents)
    SELECT x.doc_id AS a, x.doc_id + 1 AS b, CASE WHEN y.b IS NULL THEN 0 ELSE coalesce(len(list_intersect(x.b, y.b)) / nullif(CAST(len(list_distinct(list_concat(x.b, y.b))) AS DOUBLE), 0), 0) END AS similarity
    FROM f x LEFT JOIN f y ON y.doc_id = x.doc_id + 1""")
def tanimoto_pairs(spark, d):
    docs = Tables(spark, d).documents
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return Y.tanimoto_pairs(pairs, fingerprints(docs, "doc_id"), "doc_id", "bits", "a", "b")


_SEARCH_SQL = f"""
    WITH f AS (SELECT page_id, {_BITS.format(t='html')} AS b FROM pages), q AS (SELECT item_id, {_BITS.format(t='text')} AS b FROM benchmark)
    SELECT item_id, page_id, s AS similarity FROM (SELECT item_id, page_id, len(list_intersect(q.b, f.b)) / CAST(len(list_distinct(list_concat(q.b, f.b))) AS DOUBLE) AS s FROM q, f) WHERE s >= 0.05"""


def _search(spark, d, route=None):
    t = Tables(spark, d)
    library, queries = fingerprints(t.pages, "page_id", "html"), fingerprints(t.benchmark, "item_id")
    return Y.tanimoto_search(library, queries, "page_id", "item_id", "bits", 0.05, route=route)


@register("tanimoto_search", _SEARCH_SQL)
def tanimoto_search(spark, d):
    return _search(spark, d)


@register("tanimoto_search_prefix", _SEARCH_SQL)
def tanimoto_search_prefix(spark, d):
    """The same search through the prefix index."""
    return _search(spark, d, "index")
