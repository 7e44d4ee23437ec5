"""Queries over metrics, fold summaries, tests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import metrics as M
from assayloom.operators import validation as V
from assayloom.plans.catalogue import Tables, register

_REG_SQL = "(SELECT l_linenumber, l_returnflag, l_extendedprice / 1000 AS y, 10 + l_quantity * 1.5 + l_discount * 20 AS p FROM lineitem)"


def reg_rows(spark, d):
    return Tables(spark, d).lineitem.select(
        "l_linenumber", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"),
        (F.lit(10) + F.col("l_quantity") * 1.5 + F.col("l_discount") * 20).alias("p"),
    )


def rounded(df, columns, places=4):
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


@register("regression_metrics", f"""
    SELECT l_linenumber, round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
      round(avg((y - p) ** 2), 4) AS mse, round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_variance, round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS q2,
      round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) ** 2), 4) + 0.0 AS ccc, round(avg(y - p), 4) + 0.0 AS residual_mean,
      round(stddev_pop(y - p), 4) AS residual_std, round(max(abs(y - p)), 4) AS max_abs_error, count(*) AS n FROM {_REG_SQL} GROUP BY 1""")
def regression_metrics(spark, d):
    out = M.regression_metrics(reg_rows(spark, d), "y", "p", ["l_linenumber"])
    return rounded(out, [c for c in out.columns if c not in ("l_linenumber", "n")])


@register("cv_q2", f"""
    WITH r AS (SELECT * FROM {_REG_SQL}), f AS (SELECT DISTINCT l_linenumber AS fold FROM r),
      m AS (SELECT fold, avg(y) AS tm FROM f JOIN r ON l_linenumber <> fold GROUP BY 1)
    SELECT fold, round(1 - sum((y - p) ** 2) / sum((y - tm) ** 2), 4) AS q2 FROM r JOIN m ON l_linenumber = fold GROUP BY 1""")
def cv_q2(spark, d):
    rows = reg_rows(spark, d).withColumnRenamed("l_linenumber", "fold")
    sums = rows.groupBy("fold").agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    total = sums.agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    mean = (total.select("s").scalar() - F.col("s")) / (total.select("c").scalar() - F.col("c"))
    return rounded(M.cv_q2(rows, sums.select("fold", mean.alias("train_mean")), "y", "p", ["fold"]), ["q2"])


@register("ccc_sample", f"""
    SELECT l_linenumber, l_returnflag, count(*) AS n, round(2 * covar_samp(y, p) / (var_samp(y) + var_samp(p) + (avg(y) - avg(p)) ** 2), 4) + 0.0 AS ccc
    FROM {_REG_SQL} GROUP BY ALL""")
def ccc_sample(spark, d):
    return rounded(M.ccc_sample(reg_rows(spark, d), "y", "p", ["l_linenumber", "l_returnflag"]), ["ccc"])


_CLS_SQL = """(SELECT d.lang, toxic AS y, CAST(n_chars > 2000 AS INTEGER) AS p, floor(n_chars / 100) / 50.0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_LINE_CLS_SQL = """(SELECT l_linenumber AS g, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice / 100000 AS score FROM lineitem)"""


def cls_rows(spark, d):
    t = Tables(spark, d)
    docs = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return docs.select("lang", F.col("toxic").alias("y"), (F.col("n_chars") > 2000).cast("int").alias("p"), (F.floor(F.col("n_chars") / 100) / 50.0).alias("score"))


def line_cls_rows(spark, d):
    return Tables(spark, d).lineitem.select(
        F.col("l_linenumber").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") / 100000).alias("score")
    )


@register("classification_metrics", f"""
    WITH c AS (SELECT lang, CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) AS tp FROM {_CLS_SQL} GROUP BY 1)
    SELECT lang, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, CAST(tn + fp + fn + tp AS BIGINT) AS n,
      round((tp + tn) / (tn + fp + fn + tp), 4) AS accuracy,
      round(CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tn / (tn + fp) + tp / (tp + fn)) / 2 END, 4) AS balanced_accuracy,
      round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
      round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 4) AS mcc,
      round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 4) AS specificity, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS sensitivity FROM c""")
def classification_metrics(spark, d):
    out = M.classification_metrics(cls_rows(spark, d), "y", "p", ["lang"])
    return rounded(out, [c for c in out.columns if c not in ("lang", "tn", "fp", "fn", "tp", "n")])


def _auc_sql(rows: str, g: str) -> str:
    return f"""
    WITH r AS (SELECT {g}, y, rank() OVER w + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS rk FROM {rows} WINDOW w AS (PARTITION BY {g} ORDER BY score)),
      s AS (SELECT {g}, sum(CASE WHEN y = 1 THEN rk END) AS u, CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM r GROUP BY 1)
    SELECT {g}, round(CASE WHEN np * nn = 0 THEN 0 ELSE (u - np * (np + 1) / 2) / (np * nn) END, 6) AS auc FROM s"""


def _ap_sql(rows: str, g: str) -> str:
    return f"""
    WITH s AS (SELECT {g}, score, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM {rows} GROUP BY 1, 2),
      c AS (SELECT {g}, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY {g}) AS np FROM s WINDOW w AS (PARTITION BY {g} ORDER BY score DESC))
    SELECT {g}, round(CASE WHEN max(np) = 0 THEN 0 ELSE sum(pos * cp / cn) / max(np) END, 6) AS average_precision FROM c GROUP BY 1"""


@register("roc_auc", _auc_sql(_CLS_SQL, "lang"))
def roc_auc(spark, d):
    return rounded(M.roc_auc(cls_rows(spark, d), "score", "y", ["lang"]), ["auc"], 6)


@register("average_precision", _ap_sql(_CLS_SQL, "lang"))
def average_precision(spark, d):
    return rounded(M.average_precision(cls_rows(spark, d), "score", "y", ["lang"]), ["average_precision"], 6)


@register("roc_auc_lineitem", _auc_sql(_LINE_CLS_SQL, "g"))
def roc_auc_lineitem(spark, d):
    return rounded(M.roc_auc(line_cls_rows(spark, d), "score", "y", ["g"]), ["auc"], 6)


@register("average_precision_lineitem", _ap_sql(_LINE_CLS_SQL, "g"))
def average_precision_lineitem(spark, d):
    return rounded(M.average_precision(line_cls_rows(spark, d), "score", "y", ["g"]), ["average_precision"], 6)


# Folds: one metric value per (model, representation, fold) from line items. Model = return flag,
# fold = line number, representation = predictor used.
_FOLD_SQL = """
    f AS (SELECT l_returnflag AS model, l_linenumber AS fold, corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b,
            corr(l_extendedprice, l_quantity + 10 * l_discount) AS c FROM lineitem GROUP BY ALL)"""


def fold_table(spark, d):
    rows = Tables(spark, d).lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg(
        F.corr("l_extendedprice", "l_quantity").alias("2D"),
        F.corr("l_extendedprice", "l_discount").alias("3D"),
        F.corr("l_extendedprice", F.col("l_quantity") + F.col("l_discount") * 10).alias("Hybrid"),
    )
    return rows.unpivot(["model", "fold"], ["2D", "3D", "Hybrid"], "representation", "value")


_SUMMARY_SQL = f"""WITH {_FOLD_SQL}, u AS (SELECT model, '2D' AS representation, a AS v FROM f UNION ALL SELECT model, '3D', b FROM f UNION ALL SELECT model, 'Hybrid', c FROM f)"""


@register("cv_summary_pop", _SUMMARY_SQL + " SELECT model, representation, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n_folds FROM u GROUP BY ALL")
def cv_summary_pop(spark, d):
    return rounded(V.cv_summary(fold_table(spark, d), ["model", "representation"]), ["mean", "sd"], 6)


@register("cv_summary_sample", _SUMMARY_SQL + """
    SELECT model, representation, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n_folds, printf('%.4f +/- %.4f', avg(v), stddev_samp(v)) AS mean_sd FROM u GROUP BY ALL""")
def cv_summary_sample(spark, d):
    return rounded(V.cv_summary(fold_table(spark, d), ["model", "representation"], ddof=1), ["mean", "sd"], 6)


# Seven folds, six degrees of freedom: the t distribution has a closed form in SQL.
_T_SQL = """SELECT model, '{name}' AS comparison, count(*) AS n_folds, avg({l}) AS ml, avg({r}) AS mr, avg({l} - {r}) AS md,
      avg({l} - {r}) / (stddev_samp({l} - {r}) / sqrt(count(*))) AS t FROM f GROUP BY 1"""


@register("paired_t", f"""
    WITH {_FOLD_SQL}, q AS ({_T_SQL.format(name='2D vs 3D', l='a', r='b')} UNION ALL {_T_SQL.format(name='2D vs Hybrid', l='a', r='c')}),
      z AS (SELECT *, t * t / (6 + t * t) AS s2, 6 / (6 + t * t) AS c2 FROM q),
      p AS (SELECT *, 1 - sqrt(s2) * (1 + c2 / 2 + 3 * c2 * c2 / 8) AS p FROM z)
    SELECT model, comparison, n_folds, round(ml, 6) AS mean_left, round(mr, 6) AS mean_right, round(md, 6) AS mean_difference, round(t, 4) AS t_statistic,
      round(p, 8) AS p_value, p < 0.05 AS significant FROM p""")
def paired_t(spark, d):
    out = rounded(V.compare_folds(fold_table(spark, d)), ["mean_left", "mean_right", "mean_difference"], 6)
    return rounded(rounded(out, ["t_statistic"], 4), ["p_value"], 8)


_MODEL_METRICS_SQL = """
    m AS (SELECT CASE g WHEN 1 THEN 'ames' WHEN 2 THEN 'cytotox' WHEN 3 THEN 'skin_sens' ELSE 'herg' END AS endpoint, 'model_' || g AS model, g AS pos,
      tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, (tp + tn) / (tp + tn + fp + fn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1
    FROM (SELECT l_linenumber AS g, CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) AS tp
      FROM (SELECT l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS y, CAST(l_extendedprice > 30000 - 1500 * l_linenumber AS INTEGER) AS p FROM lineitem) GROUP BY 1))"""
_TARGET_SQL = """t(endpoint, metric, cut) AS (VALUES ('ames', 'accuracy', 0.8), ('ames', 'sensitivity', 0.8), ('ames', 'specificity', 0.8), ('cytotox', 'accuracy', 0.8),
      ('cytotox', 'sensitivity', 0.8), ('skin_sens', 'accuracy', 0.75), ('skin_sens', 'sensitivity', 0.75)),
    u AS (SELECT endpoint, model, 'sensitivity' AS metric, sensitivity AS value FROM m UNION ALL SELECT endpoint, model, 'specificity', specificity FROM m
      UNION ALL SELECT endpoint, model, 'accuracy', accuracy FROM m UNION ALL SELECT endpoint, model, 'f1', f1 FROM m)"""


def model_metrics(spark, d):
    rows = Tables(spark, d).lineitem.select(
        "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("y"),
        (F.col("l_extendedprice") > F.lit(30000) - F.col("l_linenumber") * 1500).cast("int").alias("p"),
    )
    g = F.col("l_linenumber")
    endpoint = F.when(g == 1, "ames").when(g == 2, "cytotox").when(g == 3, "skin_sens").otherwise("herg")
    return M.classification_metrics(rows, "y", "p", ["l_linenumber"]).select(
        endpoint.alias("endpoint"), F.concat(F.lit("model_"), g.cast("string")).alias("model"), g.alias("pos"), "sensitivity", "specificity", "accuracy", "f1"
    )


def _long(spark, d):
    return V.unpivot_metrics(model_metrics(spark, d), ["endpoint", "model"], ["sensitivity", "specificity", "accuracy", "f1"])


@register("check_targets", f"WITH {_MODEL_METRICS_SQL}, {_TARGET_SQL} SELECT model, u.endpoint, u.metric, value >= cut AS met FROM u JOIN t ON u.endpoint = t.endpoint AND u.metric = t.metric")
def check_targets(spark, d):
    return V.check_targets(_long(spark, d), V.target_table(spark), ["model"])


@register("all_targets_met", f"""
    WITH {_MODEL_METRICS_SQL}, {_TARGET_SQL}, c AS (SELECT model, u.endpoint, bool_and(value >= cut) AS a FROM u JOIN t ON u.endpoint = t.endpoint AND u.metric = t.metric GROUP BY ALL)
    SELECT m.model, m.endpoint, coalesce(a, false) AS all_met FROM m LEFT JOIN c ON m.model = c.model AND m.endpoint = c.endpoint""")
def all_targets_met(spark, d):
    return V.all_targets_met(_long(spark, d), V.target_table(spark), ["model"]).withColumnRenamed("all", "all_met")


@register("validation_report", f"""
    WITH {_MODEL_METRICS_SQL} SELECT endpoint, first(model ORDER BY f1 DESC, pos) AS best_model, round(max(f1), 6) AS best_score, count(*) AS n_models_evaluated,
      string_agg(model, ',' ORDER BY pos) AS models, 0.5 AS ad_coverage FROM m GROUP BY 1""")
def validation_report(spark, d):
    metrics = model_metrics(spark, d)
    cv = V.cv_summary(_long(spark, d), ["endpoint", "model", "metric"])
    coverage = metrics.select("endpoint").distinct().withColumn("coverage", F.lit(0.5))
    out = V.validation_report(metrics, cv, V.target_table(spark), coverage, "classification")
    return out.select(
        "endpoint", "best_model", F.round("best_score", 6).alias("best_score"), "n_models_evaluated",
        F.array_join(F.transform("models", lambda m: m["model"]), ",").alias("models"), "ad_coverage",
    )


@register("best_model", """
    WITH a AS (SELECT p_brand AS endpoint, (['svc', 'randomforest', 'xgboost', 'svr', 'lightgbm', 'mlp'])[CAST(p_partkey % 6 AS INTEGER) + 1]
        || (['_optimized', '_baseline', '_draft'])[p_size % 3 + 1] AS artifact FROM part),
      r AS (SELECT *, CASE WHEN contains(artifact, 'optimized') THEN 0 WHEN contains(artifact, 'baseline') THEN 1 END AS s,
        CASE WHEN artifact LIKE 'xgb%' THEN 0 WHEN artifact LIKE 'random%' THEN 1 WHEN artifact LIKE 'light%' THEN 2 WHEN artifact LIKE 'svc%' THEN 3 WHEN artifact LIKE 'svr%' THEN 4 ELSE 5 END AS f FROM a)
    SELECT endpoint, first(artifact ORDER BY s, f, artifact) AS best_model FROM r WHERE s IS NOT NULL GROUP BY 1""")
def best_model(spark, d):
    pick = lambda items, key: F.element_at(F.array(*[F.lit(i) for i in items]), (key % len(items) + 1).cast("int"))
    artifact = F.concat(
        pick(("svc", "randomforest", "xgboost", "svr", "lightgbm", "mlp"), F.col("p_partkey")), pick(("_optimized", "_baseline", "_draft"), F.col("p_size"))
    )
    return V.best_model(Tables(spark, d).part.select(F.col("p_brand").alias("endpoint"), artifact.alias("artifact")), ["endpoint"])


@register("compatible_models", """
    SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'not a regression model' WHEN p_size <> 10 THEN 'feature mismatch: expects ' || p_size || ', got 10' END AS skip_reason FROM part""")
def compatible_models(spark, d):
    task = F.when(F.col("p_type").isin("SMALL", "LARGE"), "classification").otherwise("regression")
    models = Tables(spark, d).part.select("p_partkey", task.alias("task"), F.col("p_size").alias("n_features"))
    return V.compatible_models(models, "regression", 10).select("p_partkey", "skip_reason")
