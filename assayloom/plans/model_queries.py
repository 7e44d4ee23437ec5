"""Queries over training, tuning, cross-validation, scoring and resampling.

Results of fitted models have no SQL counterpart unless the features decide the label; counts and linear
explanations do. Features are the whole embeddings table, the target is its label cut at five; the second
feature set comes from the part table. Model sizes are parameters; these queries use small
ones, but for ``train_decided``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators import domain as D
from assayloom.operators import features as X
from assayloom.operators import models as M
from assayloom.operators import risk as R
from assayloom.operators import scoring as Z
from assayloom.operators.boosting import LeafwiseBooster, Settings
from assayloom.operators.comparison import REPORTED, compare
from assayloom.operators.explain import common_features, opposite_effects
from assayloom.operators.folds import fold_moments, train_moments
from assayloom.operators.kernel import CORNER_OF_TUBE, TUBE
from assayloom.operators.metrics import confusion
from assayloom.operators.neighbours import nearest
from assayloom.operators.resample import smote
from assayloom.operators.splits import repeated_kfold, repeated_stratified_kfold, stratified_split
from assayloom.operators.validation import compare_folds, cv_summary, sort_summary, unpivot_metrics
from assayloom.plans.catalogue import Tables, register
from assayloom.plans.curation_queries import fold_sql
from assayloom.plans.jobs import predict_file
from assayloom.session import stage_path

SETTINGS = {
    "forest": {"numTrees": 20, "maxDepth": 6},
    "boosted": {"maxIter": 8, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8},
    "kernel": {"C": 10.0},
}
COMPONENTS = 64


def labelled(spark, d, task="classification", positive_from=5):
    e = Tables(spark, d).embeddings
    vec = F.col("embedding").cast("array<double>")
    y = (F.col("label") >= positive_from).cast("double") if task == "classification" else F.col("label").cast("double") + F.get(vec, F.lit(0)) * 10
    return e.select(F.col("vec_id").alias("key"), vec.alias("features"), y.alias("y"))


def split_table(spark, d, task="classification"):
    rows = labelled(spark, d, task)
    strata = rows.withColumn("stratum", (F.col("y") >= 5).cast("int") if task == "regression" else F.col("y"))
    return stratified_split(strata, "key", "stratum").drop("stratum")


@register("smote_counts", """
    WITH c AS (SELECT count(*) FILTER (WHERE label >= 8) AS small, count(*) FILTER (WHERE label < 8) AS large FROM embeddings)
    SELECT y, CASE WHEN y = 1 THEN small ELSE large END AS original, large AS n FROM c, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(y)""")
def smote_counts(spark, d):
    out = smote(labelled(spark, d, positive_from=8), "key", "features", "y")
    return out.groupBy("y").agg(F.count("key").alias("original"), F.count(F.lit(1)).alias("n"))


@register("smote_rows")
def smote_rows(spark, d):
    out = smote(labelled(spark, d, positive_from=8), "key", "features", "y")
    return out.where(F.col("key").isNull()).select("y", F.size("features").alias("width"), F.round(F.get("features", F.lit(0)), 6).alias("x0"))


@register("smote_blocks", """
    SELECT count(*) FILTER (WHERE label < 8) AS n FROM embeddings""")
def smote_blocks(spark, d):
    out = smote(labelled(spark, d, positive_from=8), "key", "features", "y", block=20)
    return out.where(F.col("y") == 1).agg(F.count(F.lit(1)).alias("n"))


@register("smote_neighbours", """
    WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label >= 8),
      p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS d FROM m a JOIN m b ON a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS place FROM p)
    SELECT vec_id, CAST(place AS INTEGER) AS place, neighbour, round(d, 5) AS distance FROM r WHERE place <= 5""")
def smote_neighbours(spark, d):
    """The neighbours between which rows are made, found over blocks of 50 rows."""
    e = Tables(spark, d).embeddings.where("label >= 8")
    rows = e.select(F.col("vec_id").alias("rid"), F.col("vec_id").alias("h"), F.col("embedding").cast("array<double>").alias("v"))
    near = nearest(rows, 5, rows.count(), 64, block=50).select(F.col("rid").alias("vec_id"), F.posexplode("near").alias("place", "p"))
    return near.select("vec_id", (F.col("place") + 1).alias("place"), F.col("p")["rid"].alias("neighbour"), F.round(F.sqrt(F.col("p")["d"]), 5).alias("distance"))


def _train(task, models):
    def query(spark, d):
        _, preds = M.train_all(split_table(spark, d, task), task, SETTINGS, models, components=COMPONENTS)
        return M.all_metrics(preds, task, ["model"])

    return query


register("train_forest")(_train("classification", ["RandomForest"]))
register("train_boosted")(_train("classification", ["BoostedTrees", "LeafwiseTrees"]))
register("train_kernel")(_train("classification", ["KernelSVC"]))
register("train_regression")(_train("regression", ["RandomForest", "BoostedTrees", "KernelSVR"]))


@register("boosted_round", """
    WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      m AS (SELECT avg(y) AS mean, count(*) AS n FROM (SELECT DISTINCT vec_id, y FROM e)),
      c AS (SELECT f, unnest([quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)]) AS cut FROM e GROUP BY f),
      s AS (SELECT e.f, cut, sum(mean - y) AS g, count(*) AS h, any_value(n) AS n FROM e JOIN c ON e.f = c.f AND x <= cut, m GROUP BY ALL),
      b AS (SELECT *, g * g / (h + 1) + g * g / (n - h + 1) AS gain FROM s ORDER BY gain DESC, f, cut LIMIT 1)
    SELECT f AS feature, round(cut, 6) AS threshold, round(-g / (h + 1), 6) AS left_value, round(g / (n - h + 1), 6) AS right_value FROM b""")
def boosted_round(spark, d):
    """The first split of leaf-wise boosting at four bins: a stump on squared loss."""
    rows = M.with_vector(Tables(spark, d).embeddings.select(F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("double").alias("y")))
    t = LeafwiseBooster("regression", Settings(rounds=1, leaves=2, rate=1.0, bins=4, columns=1.0, rows=1.0)).fit(rows).trees
    stump = [(int(t.feature[0]), round(float(t.threshold[0]), 6), round(float(t.value[1]), 6), round(float(t.value[2]), 6))]
    return spark.createDataFrame(stump, "feature int, threshold double, left_value double, right_value double")


@register("train_decided", """
    WITH e AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings),
      r AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || vec_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM e),
      t AS (SELECT y FROM r WHERE rn <= ceil(n * 0.2 - 1e-9))
    SELECT model, count(*) FILTER (WHERE y = 0) AS tn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, count(*) FILTER (WHERE y = 1) AS tp, count(*) AS n
    FROM t, (VALUES ('RandomForest'), ('KernelSVC')) v(model) GROUP BY model""")
def train_decided(spark, d):
    """Full model settings on features that decide the label: every test row must come out right."""
    decides = split_table(spark, d).withColumn("features", F.array(F.col("y"), 1 - F.col("y")))
    _, preds = M.train_all(decides, "classification", M.BASELINE, ["RandomForest", "KernelSVC"])
    return confusion(preds, "y", "prediction", ["model"])


@register("kernel_tube", """
    SELECT label, count(*) AS inside, 0.1::DOUBLE AS tube FROM embeddings GROUP BY label""")
def kernel_tube(spark, d):
    """Kernel regression at full settings on features that decide the target: every residual lies in the tube."""
    rows = labelled(spark, d).join(Tables(spark, d).embeddings.select(F.col("vec_id").alias("key"), "label"), "key")
    rows = rows.select("key", "label", F.array(F.col("label") / 3.0, F.col("label") % 2.0).alias("features"), F.col("label").cast("double").alias("y"))
    model = M.model_set("regression")["KernelSVR"].fit(M.with_vector(rows))
    residual = F.abs(F.col("prediction") - F.col("y"))
    inside = M.predictions(model, rows, "regression", ["key", "label"]).where(residual <= TUBE * (1 + CORNER_OF_TUBE))
    return inside.groupBy("label").agg(F.count(F.lit(1)).alias("inside"), F.lit(TUBE).alias("tube"))


@register("cv_fold_states", f"""
    WITH f AS ({fold_sql("embeddings", "vec_id")}),
      x AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      t AS (SELECT repeat, CAST(h AS INTEGER) AS fold, vec_id FROM f, (SELECT unnest([0, 1, 2, 3, 4]) AS h) WHERE fold <> h)
    SELECT repeat, fold, idx, round(avg(x), 6) + 0.0 AS centre, round(stddev_pop(x), 6) AS scale, round(avg(CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END), 6) AS train_mean
    FROM t JOIN x USING (vec_id) GROUP BY repeat, fold, idx""")
def cv_fold_states(spark, d):
    """Scaling state and target mean of the training rows of all 15 folds, from one aggregation."""
    table = labelled(spark, d)
    folds = repeated_kfold(table.select("key"), "key").groupBy("key").pivot("repeat", [0, 1, 2]).agg(F.max("fold"))
    moments = fold_moments(table.join(folds, "key"), ["0", "1", "2"])
    parts = []
    for r, i in sorted(moments):
        train = train_moments(moments, r, i)
        parts.append(train.state(spark).select(F.lit(r).alias("repeat"), F.lit(i).alias("fold"), "*", F.lit(train.y_mean).alias("train_mean")))
    rounded = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("centre", "scale", "train_mean")]
    return reduce(DataFrame.unionByName, parts).select("repeat", "fold", "idx", *rounded)


@register("cross_validate")
def cross_validate(spark, d):
    table = labelled(spark, d)
    folds = repeated_stratified_kfold(table.select("key", "y"), "key", "y", 3, 1)
    preds, means = M.cross_validate(table, folds, "classification", 3, 1, SETTINGS, ["RandomForest", "KernelSVC"], components=COMPONENTS)
    metrics = M.cv_metrics(preds, means, "classification")
    long = unpivot_metrics(metrics.select("model", "repeat", "fold", "accuracy", "f1", "mcc", "auc"), ["model", "repeat", "fold"], ["accuracy", "f1", "mcc", "auc"])
    return cv_summary(long, ["model", "metric"])


@register("cross_validate_regression")
def cross_validate_regression(spark, d):
    table = labelled(spark, d, "regression")
    folds = repeated_kfold(table.select("key"), "key", 3, 1)
    preds, means = M.cross_validate(table, folds, "regression", 3, 1, SETTINGS, ["KernelSVR"], components=COMPONENTS)
    return M.cv_metrics(preds, means, "regression").select("model", "repeat", "fold", "r2", "q2", "rmse", "mae")


@register("tune_models")
def tune_models(spark, d):
    table = labelled(spark, d)
    folds = repeated_stratified_kfold(table.select("key", "y"), "key", "y", 2, 1)
    small = {"forest": {"numTrees": 10, "maxDepth": 5}, "boosted": {"maxIter": 4, "maxDepth": 3}}
    trials, _ = M.tune(table, folds, "classification", 2, 2, ("forest", "boosted"), small)
    return trials


def represented(spark, d):
    """Vectors as first set of features, and columns of another table as second one."""
    second = Tables(spark, d).part.select(F.col("p_partkey").alias("key"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x3d"))
    return labelled(spark, d).withColumnRenamed("features", "x2d").join(second, "key").select("key", "x2d", "x3d", "y")


@register("compare_representations")
def compare_representations(spark, d):
    aligned = represented(spark, d)
    folds = repeated_stratified_kfold(aligned.select("key", "y"), "key", "y", 3, 1)
    preds = M.compare_representations(aligned, folds, "classification", 3, 1, SETTINGS, ["RandomForest"], COMPONENTS)
    return compare_folds(M.fold_scores(preds, "classification"))


@register("compare_representations_summary")
def compare_representations_summary(spark, d):
    aligned = represented(spark, d)
    folds = repeated_stratified_kfold(aligned.select("key", "y"), "key", "y", 2, 1)
    preds = M.compare_representations(aligned, folds, "classification", 2, 1, SETTINGS, ["RandomForest"], COMPONENTS)
    return sort_summary(cv_summary(M.fold_scores(preds, "classification"), ["representation", "model"], ddof=1))


_DECIDED = """
    WITH e AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings),
      r AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || vec_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM e)
    SELECT representation, model, metric, part, n, 1.0::DOUBLE AS value
    FROM (VALUES ('2D'), ('3D'), ('Hybrid')) a(representation), (VALUES ('RandomForest')) b(model),
      (VALUES ('auc'), ('mcc'), ('balanced_accuracy'), ('average_precision')) c(metric),
      (SELECT 'holdout' AS part, count(*) FILTER (WHERE rn <= ceil(n * 0.2 - 1e-9)) AS n FROM r UNION ALL SELECT 'folds', 2) d"""


@register("compare_decided", _DECIDED)
def compare_decided(spark, d):
    """Report on forests with features that decide the label: every fold and the holdout come out right."""
    e = labelled(spark, d).select("key", "y")
    aligned = e.withColumns({"x2d": F.array(F.col("y"), 1 - F.col("y")), "x3d": F.array(F.col("y") * 3)})
    got = compare(aligned, "classification", 2, 1, settings=SETTINGS, models=["RandomForest"], components=COMPONENTS)
    ids, names = ["representation", "model"], list(REPORTED["classification"])
    held = unpivot_metrics(got.holdout, [*ids, "n"], names).withColumn("part", F.lit("holdout"))
    folds = got.folds.select(*ids, "metric", F.col("mean").alias("value"), F.col("n_folds").alias("n"), F.lit("folds").alias("part"))
    out = held.unionByName(folds)
    return out.select(*ids, "metric", "part", "n", F.round("value", 6).alias("value"))


@register("importance_topk")
def importance_topk(spark, d):
    fitted, _ = M.train_all(split_table(spark, d), "classification", SETTINGS, ["RandomForest"])
    return M.importance_topk(spark, fitted["RandomForest"], [f"f{i}" for i in range(64)], 15)


@register("importance_linear", """
    SELECT unnest(['f1', 'f0', 'f2']) AS feature, unnest([3.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE]) AS importance""")
def importance_linear(spark, d):
    """Importance in a linear model of a target that is 2 f0 - 3 f1 + f2 / 2 exactly."""
    x = lambda i: F.get("features", F.lit(i))
    rows = labelled(spark, d).select(F.slice("features", 1, 8).alias("features")).withColumn("y", 2 * x(0) - 3 * x(1) + x(2) / 2)
    model = LinearRegression(featuresCol="x", labelCol="y", regParam=0.0, solver="normal").fit(M.with_vector(rows))
    return M.importance_topk(spark, model, [f"f{i}" for i in range(8)], 3).select("feature", F.round("importance", 5).alias("importance"))


def endpoint_models(spark, d, only=("herg", "ames", "cytotox")):
    """A forest for two classification endpoints and a regression for herg, with scaler and domain."""
    out = []
    for endpoint, task, cut in (("herg", "regression", 5), ("ames", "classification", 5), ("cytotox", "classification", 7)):
        if endpoint not in only:
            continue
        rows = labelled(spark, d, task, cut)
        state = X.fit_standard(rows, "features")
        scaled = X.scale(rows, "features", state)
        model = M.model_set(task, SETTINGS)["RandomForest"].fit(M.with_vector(scaled))
        out.append(Z.EndpointModel(endpoint, task, "randomforest_baseline", model, state, D.fit_domain(scaled, "features"), "pIC50" if task == "regression" else None))
    return out


def _requests(spark, d):
    e = Tables(spark, d).embeddings
    vec = F.when(F.col("label") != 3, F.col("embedding").cast("array<double>"))
    return e.select(F.col("vec_id").alias("key"), vec.alias("features"))


@register("score_endpoints", """
    SELECT endpoint, label <> 3 AS success, CASE WHEN label = 3 THEN 'Invalid input' END AS error, count(*) AS n
    FROM embeddings, (VALUES ('herg'), ('ames'), ('cytotox')) v(endpoint) GROUP BY ALL""")
def score_endpoints(spark, d):
    scored = Z.score_all(_requests(spark, d), "key", "features", endpoint_models(spark, d))
    return scored.groupBy("endpoint", "success", "error").agg(F.count(F.lit(1)).alias("n"))


@register("score_endpoint_map", """
    SELECT vec_id AS key, CAST(3 AS INTEGER) AS n_endpoints, CASE WHEN label = 3 THEN 'Invalid input' END AS error FROM embeddings""")
def score_endpoint_map(spark, d):
    scored = Z.score_all(_requests(spark, d), "key", "features", endpoint_models(spark, d))
    out = Z.multi_endpoint_map(scored, "key")
    return out.select("key", F.size("results").alias("n_endpoints"), F.col("results")["ames"]["error"].alias("error"))


@register("score_integrated")
def score_integrated(spark, d):
    scored = Z.score_all(_requests(spark, d), "key", "features", endpoint_models(spark, d))
    out = R.integrated_assessment(scored, "key")
    return out.select("key", "overall_risk_score", "overall_risk_level", "critical_endpoint", "recommendation", "error")


@register("explain_all_endpoints", """
    WITH e AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      m AS (SELECT label, idx, avg(x) AS m FROM e GROUP BY ALL), o AS (SELECT idx, avg(x) AS mu FROM e GROUP BY 1),
      t AS (SELECT label, 'f' || m.idx AS feature, m.m - mu AS v, row_number() OVER (PARTITION BY label ORDER BY abs(m.m - mu) DESC, 'f' || m.idx) AS rk FROM m JOIN o ON m.idx = o.idx),
      c AS (SELECT feature, count(*) AS n FROM t WHERE rk <= 10 GROUP BY 1 HAVING count(*) >= 2),
      w AS (SELECT feature, list_sort(list(DISTINCT label)) AS l FROM t WHERE rk <= 5 GROUP BY 1 HAVING min(sign(v)) <> max(sign(v)))
    SELECT 'common' AS kind, feature, CAST(n AS VARCHAR) AS detail FROM (SELECT *, row_number() OVER (ORDER BY n DESC, feature) AS pl FROM c) WHERE pl <= 10
    UNION ALL SELECT 'opposite', feature, '''' || feature || ''' has opposite effects on ' || l[1] || ' vs ' || l[2]
    FROM (SELECT *, row_number() OVER (ORDER BY feature) AS pl FROM w) WHERE pl <= 5""")
def explain_all_endpoints(spark, d):
    """Linear attributions of every label against the rest, then the features they share or dispute."""
    rows = labelled(spark, d).join(Tables(spark, d).embeddings.select(F.col("vec_id").alias("key"), "label"), "key")
    long = rows.select("label", F.posexplode("features").alias("idx", "x"))
    per_label = long.groupBy("label", "idx").agg(F.avg("x").alias("m"))
    overall = long.groupBy("idx").agg(F.avg("x").alias("mu"))
    top = (
        per_label.join(overall, "idx")
        .select(F.col("label").alias("endpoint"), F.concat(F.lit("f"), F.col("idx").cast("string")).alias("feature"), (F.col("m") - F.col("mu")).alias("value"))
    )
    from assayloom.operators.explain import top_features_long

    top = top_features_long(top, ["endpoint"], "feature", "value", 10)
    shared = common_features(top).select(F.lit("common").alias("kind"), "feature", F.col("endpoints_affected").cast("string").alias("detail"))
    return shared.unionByName(opposite_effects(top).select(F.lit("opposite").alias("kind"), "feature", F.col("insight").alias("detail")))


@register("aligned_predictions", """
    SELECT 1 AS fold, 'cv_val' AS split, doc_id, CAST(toxic AS DOUBLE) AS y_true, n_chars / 1000.0 AS y_pred FROM labels JOIN documents USING (doc_id)""")
def aligned_predictions(spark, d):
    t = Tables(spark, d)
    external = t.documents.select("doc_id", "n_chars", (F.col("n_chars") / 1000.0).alias("toxic_pred"), "lang")
    return Z.aligned_predictions(external, t.labels, "doc_id", "toxic", 1)


@register("predict_lines", """
    SELECT endpoint, success, error, count(*) AS n FROM (
      SELECT endpoint, endpoint <> 'herg' AND label <> 3 AS success, CASE WHEN endpoint = 'herg' THEN 'Model not available for endpoint: herg' WHEN label = 3 THEN 'Invalid input' END AS error
      FROM embeddings, (VALUES ('herg'), ('ames')) v(endpoint)) GROUP BY ALL""")
def predict_lines(spark, d):
    """Lines of a text file (vector ids) through one endpoint model; the other endpoint has none."""
    path = stage_path(spark, "ids")
    e = Tables(spark, d).embeddings
    e.select(F.col("vec_id").cast("string")).write.text(path)
    usable = F.when(F.col("label") != 3, F.col("embedding").cast("array<double>"))
    known = e.select(F.col("vec_id").cast("string").alias("smiles"), usable.alias("features"))
    featurise = lambda lines: lines.join(known, "smiles", "left")
    out = predict_file(spark, path, featurise, endpoint_models(spark, d, ("ames",)), endpoints=["herg", "ames"])
    return out.groupBy("endpoint", "success", "error").agg(F.count(F.lit(1)).alias("n"))


@register("linear_explanation", """
    WITH e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      r AS (SELECT vec_id, idx, x * (idx % 3 - 1) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x * (idx % 3 - 1)) DESC, idx) AS rk FROM e)
    SELECT vec_id, round(0.25 + sum(v), 5) + 0.0 AS score, string_agg('f' || idx, ',' ORDER BY rk) FILTER (WHERE rk <= 3) AS top FROM r GROUP BY 1""")
def linear_explanation(spark, d):
    rows = Tables(spark, d).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = Z.linear_explanation(rows, "vec_id", "v", [float(i % 3 - 1) for i in range(64)], [0.0] * 64, [f"f{i}" for i in range(64)], 0.25, 3)
    top = F.array_join(F.transform("top_features", lambda f: f["feature"]), ",")
    return out.select("vec_id", (F.round("score", 5) + F.lit(0.0)).alias("score"), top.alias("top"))
