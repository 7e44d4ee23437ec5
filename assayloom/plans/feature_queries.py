"""Queries over feature tables and the applicability domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import domain as D
from assayloom.operators import features as X
from assayloom.operators.splits import key_hash
from assayloom.plans.catalogue import Tables, register

# Line items as a feature table: five columns, two of them with gaps, one constant, two nearly equal.
NAMES = ("qty", "price", "discount", "net", "gap", "constant")
_COLUMNS_SQL = """l_quantity AS qty, l_extendedprice AS price, CASE WHEN l_quantity <= 45 THEN l_discount END AS discount,
    l_extendedprice * (1 - l_tax) AS net, CASE WHEN l_quantity > 20 THEN l_tax END AS gap, 1.0 AS constant"""
_LONG_SQL = f"""(SELECT CAST(idx AS INTEGER) AS idx, x FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS idx, unnest([qty, price, discount, net, gap, constant]) AS x
    FROM (SELECT {_COLUMNS_SQL} FROM lineitem)))"""
_EMB_SQL = """(SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def line_features(spark, d, *keep):
    rows = Tables(spark, d).lineitem
    return rows.select(
        *keep,
        F.array(
            F.col("l_quantity"), F.col("l_extendedprice"),
            F.when(F.col("l_quantity") <= 45, F.col("l_discount")),
            F.col("l_extendedprice") * (F.lit(1) - F.col("l_tax")),
            F.when(F.col("l_quantity") > 20, F.col("l_tax")), F.lit(1.0),
        ).alias("features"),
    )


def embedding_features(spark, d, *keep):
    return Tables(spark, d).embeddings.select("vec_id", *keep, F.col("embedding").cast("array<double>").alias("features"))


@register("missing_fraction", f"""
    SELECT idx, round(1 - count(x) / CAST(count(*) AS DOUBLE), 6) AS missing_fraction, count(*) AS n_rows FROM {_LONG_SQL} GROUP BY 1
    HAVING 1 - count(x) / CAST(count(*) AS DOUBLE) < 0.2""")
def missing_fraction(spark, d):
    kept = X.missing_fraction_filter(X.feature_stats(line_features(spark, d), "features"))
    return kept.select("idx", F.round("missing_fraction", 6).alias("missing_fraction"), "n_rows")


@register("feature_stats", f"""
    SELECT idx, count(x) AS n_present, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var_pop, round(var_samp(x), 6) AS var_samp,
      round(stddev_samp(x), 6) AS sd_samp FROM {_EMB_SQL} GROUP BY 1""")
def feature_stats(spark, d):
    s = X.feature_stats(embedding_features(spark, d), "features")
    return s.select("idx", "n_present", *[F.round(c, 6).alias(c) for c in ("mean", "var_pop", "var_samp", "sd_samp")])


@register("column_stats", """
    SELECT feature, count(x) AS n_present, round(avg(x), 4) AS mean FROM (
      SELECT unnest(['s_acctbal', 's_nationkey']) AS feature, unnest([s_acctbal, s_nationkey]) AS x FROM supplier) GROUP BY 1""")
def column_stats(spark, d):
    s = X.column_stats(Tables(spark, d).supplier, ["s_acctbal", "s_nationkey"])
    return s.select("feature", "n_present", F.round("mean", 4).alias("mean"))


@register("zero_std_filter", f"SELECT idx FROM {_LONG_SQL} GROUP BY 1 HAVING stddev_samp(x) > 0")
def zero_std_filter(spark, d):
    return X.zero_std_filter(X.feature_stats(line_features(spark, d), "features")).select("idx")


@register("variance_filter", f"SELECT idx, round(var_pop(x), 6) AS var_pop FROM {_EMB_SQL} GROUP BY 1 HAVING var_pop(x) > 0.0155")
def variance_filter(spark, d):
    kept = X.variance_filter(X.feature_stats(embedding_features(spark, d), "features"), 0.0155)
    return kept.select("idx", F.round("var_pop", 6).alias("var_pop"))


@register("variance_cap", f"""
    SELECT idx, round(v, 6) AS var_samp FROM (SELECT idx, var_samp(x) AS v FROM {_EMB_SQL} GROUP BY 1) ORDER BY v DESC, idx LIMIT 20""")
def variance_cap(spark, d):
    kept = X.cap_by_variance(X.feature_stats(embedding_features(spark, d), "features"), 20)
    return kept.select("idx", F.round("var_samp", 6).alias("var_samp"))


@register("feature_medians", f"SELECT idx, round(median(x), 6) AS median FROM {_LONG_SQL} WHERE x IS NOT NULL GROUP BY 1")
def feature_medians(spark, d):
    return X.feature_medians(line_features(spark, d), "features").select("idx", F.round("median", 6).alias("median"))


@register("feature_quartiles", f"""
    SELECT idx, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75 FROM {_EMB_SQL} GROUP BY 1""")
def feature_quartiles(spark, d):
    q = X.feature_quartiles(embedding_features(spark, d), "features")
    return q.select("idx", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


@register("impute_median", f"""
    WITH l AS (SELECT l_returnflag, {_COLUMNS_SQL} FROM lineitem),
         m AS (SELECT median(discount) AS md, median(gap) AS mg FROM l)
    SELECT l_returnflag, count(*) AS n, round(sum(coalesce(discount, md)), 4) AS discount, round(sum(coalesce(gap, mg)), 4) AS gap FROM l, m GROUP BY 1""")
def impute_median(spark, d):
    rows = line_features(spark, d, "l_returnflag")
    filled = X.impute_median(rows, "features", X.feature_medians(rows, "features"), len(NAMES))
    total = lambda i, name: F.round(F.sum(F.get("features", F.lit(i))), 4).alias(name)
    return filled.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), total(2, "discount"), total(4, "gap"))


@register("correlation_filter", f"""
    WITH w AS (SELECT qty, price, net, l_discount AS disc, qty + l_discount AS qd FROM (SELECT *, {_COLUMNS_SQL} FROM lineitem)),
      c AS (SELECT corr(qty, price) AS c01, corr(qty, net) AS c02, corr(price, net) AS c12, corr(qty, disc) AS c03, corr(price, disc) AS c13,
              corr(net, disc) AS c23, corr(qty, qd) AS c04, corr(price, qd) AS c14, corr(net, qd) AS c24, corr(disc, qd) AS c34 FROM w)
    SELECT feature FROM (SELECT unnest(['price', 'net', 'disc', 'qd']) AS feature,
      unnest([abs(c01), greatest(abs(c02), abs(c12)), greatest(abs(c03), abs(c13), abs(c23)), greatest(abs(c04), abs(c14), abs(c24), abs(c34))]) AS r FROM c) WHERE r > 0.95""")
def correlation_filter(spark, d):
    rows = Tables(spark, d).lineitem.select(
        F.array(
            F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_extendedprice") * (F.lit(1) - F.col("l_tax")),
            F.col("l_discount"), F.col("l_quantity") + F.col("l_discount"),
        ).alias("v")
    )
    names = ("qty", "price", "net", "disc", "qd")
    return spark.createDataFrame([(names[i],) for i in sorted(X.correlated_places(rows, "v"))], "feature string")


_STD_SQL = f"""
    WITH e AS (SELECT * FROM {_EMB_SQL}), s AS (SELECT idx, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1)
    SELECT vec_id, e.idx, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 4) + 0.0 AS x FROM e JOIN s ON e.idx = s.idx"""


@register("standardise", _STD_SQL)
def standardise(spark, d):
    rows = embedding_features(spark, d)
    out = X.scale(rows, "features", X.fit_standard(rows, "features"))
    return X.unfold(out, "features", "vec_id").withColumn("x", F.round("x", 4) + F.lit(0.0))


@register("standardise_inverse", f"SELECT vec_id, idx, round(x, 4) + 0.0 AS x FROM {_EMB_SQL}")
def standardise_inverse(spark, d):
    rows = embedding_features(spark, d)
    state = X.fit_standard(rows, "features")
    out = X.scale(X.scale(rows, "features", state), "features", state, inverse=True)
    return X.unfold(out, "features", "vec_id").withColumn("x", F.round("x", 4) + F.lit(0.0))


@register("robust_scale", f"""
    WITH e AS (SELECT * FROM {_EMB_SQL}),
      s AS (SELECT idx, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w FROM e GROUP BY 1)
    SELECT vec_id, e.idx, round((x - m) / CASE WHEN w > 0 THEN w ELSE 1 END, 4) + 0.0 AS x FROM e JOIN s ON e.idx = s.idx""")
def robust_scale(spark, d):
    rows = embedding_features(spark, d)
    out = X.scale(rows, "features", X.fit_robust(rows, "features"))
    return X.unfold(out, "features", "vec_id").withColumn("x", F.round("x", 4) + F.lit(0.0))


_TRAIN_SQL = "substr(md5('42|' || {key}), 1, 8) >= '4ccccccc'"


def is_train(key):
    return F.substring(key_hash(key, 42), 1, 8) >= "4ccccccc"


@register("clean_descriptors", f"""
    WITH l AS (SELECT l_orderkey, l_returnflag, {_COLUMNS_SQL} FROM lineitem),
      t AS (SELECT median(qty) AS m0, median(price) AS m1, median(discount) AS m2, median(net) AS m3 FROM l WHERE {_TRAIN_SQL.format(key='l_orderkey')})
    SELECT l_returnflag, 4 AS width, round(sum(qty), 2) AS s0, round(sum(price), 2) AS s1, round(sum(coalesce(discount, m2)), 2) AS s2, round(sum(net), 2) AS s3 FROM l, t GROUP BY 1""")
def clean_descriptors(spark, d):
    rows = line_features(spark, d, "l_orderkey", "l_returnflag")
    out = X.clean_descriptors(rows, "features", is_train("l_orderkey"))
    total = lambda i: F.round(F.sum(F.get("features", F.lit(i))), 2).alias(f"s{i}")
    return out.groupBy("l_returnflag").agg(F.max(F.size("features")).alias("width"), *[total(i) for i in range(4)])


@register("select_features", f"""
    WITH t AS (SELECT l_quantity AS qty, l_extendedprice AS price, l_extendedprice * (1 - l_tax) AS net, l_discount AS disc, l_quantity * 2 AS qty2
               FROM lineitem WHERE {_TRAIN_SQL.format(key='l_orderkey')}),
      v AS (SELECT var_samp(qty) AS v0, var_samp(price) AS v1 FROM t WHERE (SELECT corr(price, net) > 0.95 AND var_pop(disc) <= 0.01 AND corr(qty, qty2) > 0.95 AND abs(corr(qty, price)) <= 0.95 FROM t))
    SELECT unnest(['qty', 'price']) AS feature, unnest([0, 1]) AS source_idx FROM v""")
def select_features(spark, d):
    rows = Tables(spark, d).lineitem.select(
        "l_orderkey",
        F.array(
            F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_extendedprice") * (F.lit(1) - F.col("l_tax")),
            F.col("l_discount"), F.col("l_quantity") * 2,
        ).alias("features"),
    )
    _, state = X.select_features(rows, "features", ("qty", "price", "net", "disc", "qty2"), is_train("l_orderkey"))
    return state.select("feature", "source_idx")


@register("select_features_capped", f"""
    WITH s AS (SELECT idx, var_samp(x) AS v FROM {_EMB_SQL} WHERE {_TRAIN_SQL.format(key='vec_id')} GROUP BY 1 HAVING var_pop(x) > 0.01)
    SELECT 'Morgan_' || idx AS feature, CAST(row_number() OVER (ORDER BY v DESC, idx) - 1 AS INTEGER) AS idx FROM s ORDER BY v DESC, idx LIMIT 16""")
def select_features_capped(spark, d):
    names = [f"Morgan_{i}" for i in range(64)]
    _, state = X.select_features(embedding_features(spark, d), "features", names, is_train("vec_id"), most=16)
    return state.select("feature", "idx")


@register("clean_feature_matrix", f"""
    WITH l AS (SELECT l_orderkey, l_returnflag, l_quantity AS qty, CASE WHEN l_quantity <= 45 THEN l_extendedprice END AS price FROM lineitem),
      f AS (SELECT l_returnflag, qty, coalesce(price, (SELECT median(price) FROM l)) AS price FROM l),
      s AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM f)
    SELECT l_returnflag, 'qty,price' AS kept, round(avg((qty - mq) / sq), 4) AS qty, round(avg((price - mp) / sp), 4) AS price FROM f, s GROUP BY 1""")
def clean_feature_matrix(spark, d):
    rows = Tables(spark, d).lineitem.select(
        "l_returnflag",
        F.array(
            F.col("l_quantity"), F.when(F.col("l_quantity") <= 45, F.col("l_extendedprice")), F.lit(3.0),
            F.when(F.col("l_quantity") > 25, F.col("l_tax")), F.col("l_quantity") * 2 + 1,
        ).alias("features"),
    )
    table, kept = X.clean_feature_matrix(rows, "features", ("qty", "price", "constant", "gap", "qty2"))
    mean = lambda i, name: F.round(F.avg(F.get("features", F.lit(i))), 4).alias(name)
    return table.groupBy("l_returnflag").agg(F.lit(",".join(kept)).alias("kept"), mean(0, "qty"), mean(1, "price"))


_DIST_SQL = f"""
    e AS (SELECT * FROM {_EMB_SQL}), c AS (SELECT idx, avg(x) AS m FROM e WHERE {_TRAIN_SQL.format(key='vec_id')} GROUP BY 1),
    d AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS h FROM e JOIN c ON e.idx = c.idx GROUP BY 1),
    t AS (SELECT quantile_cont(h, 0.95) AS cut FROM d WHERE {_TRAIN_SQL.format(key='vec_id')})"""


def _distance(spark, d):
    rows = embedding_features(spark, d)
    domain = D.fit_domain(rows.where(is_train("vec_id")), "features", "distance")
    return D.assess(rows.where(~is_train("vec_id")), "features", domain), domain


@register("ad_distance", f"""
    WITH {_DIST_SQL} SELECT vec_id, round(h, 5) AS h, h <= cut AS within FROM d, t WHERE NOT ({_TRAIN_SQL.format(key='vec_id')})""")
def ad_distance(spark, d):
    return _distance(spark, d)[0].select("vec_id", F.round("h", 5).alias("h"), "within")


@register("ad_distance_summary", f"""
    WITH {_DIST_SQL} SELECT 'distance' AS method, round(max(cut), 5) AS threshold, round(avg(CAST(h <= cut AS DOUBLE)), 6) AS coverage, round(avg(h), 5) AS mean_value,
      round(max(h), 5) AS max_value, count(*) FILTER (WHERE h > cut) AS n_outliers, count(*) AS test_samples FROM d, t WHERE NOT ({_TRAIN_SQL.format(key='vec_id')})""")
def ad_distance_summary(spark, d):
    s = D.assess_summary(*_distance(spark, d))
    return s.select("method", *[F.round(c, 5).alias(c) for c in ("threshold", "mean_value", "max_value")],
                    F.round("coverage", 6).alias("coverage"), "n_outliers", "test_samples")


# Two features, so that the inverse of the 2 x 2 Gram matrix can be written out in SQL.
_LEV_SQL = f"""
    l AS (SELECT event_id, value / 100 AS a, user_id / 100.0 AS b FROM events),
    g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, count(*) AS n FROM l WHERE {_TRAIN_SQL.format(key='event_id')}),
    h AS (SELECT event_id, (a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab) AS h, 3.0 * 3 / n AS cut, n FROM l, g WHERE NOT ({_TRAIN_SQL.format(key='event_id')}))"""


def _leverage(spark, d):
    rows = Tables(spark, d).events.select("event_id", F.array(F.col("value") / 100, F.col("user_id") / 100.0).alias("v"))
    domain = D.fit_domain(rows.where(is_train("event_id")), "v")
    return D.assess(rows.where(~is_train("event_id")), "v", domain), domain


@register("ad_leverage", f"WITH {_LEV_SQL} SELECT event_id, round(h, 8) AS h, h <= cut AS within FROM h")
def ad_leverage(spark, d):
    return _leverage(spark, d)[0].select("event_id", F.round("h", 8).alias("h"), "within")


@register("ad_leverage_summary", f"""
    WITH {_LEV_SQL} SELECT round(max(cut), 8) AS threshold, round(avg(CAST(h <= cut AS DOUBLE)), 6) AS coverage, count(*) FILTER (WHERE h > cut) AS n_outliers,
      max(n) AS training_samples, 2 AS n_features FROM h""")
def ad_leverage_summary(spark, d):
    s = D.assess_summary(*_leverage(spark, d))
    return s.select(F.round("threshold", 8).alias("threshold"), F.round("coverage", 6).alias("coverage"), "n_outliers",
                    F.col("training_samples").cast("long").alias("training_samples"), "n_features")


@register("ad_outliers", f"WITH {_LEV_SQL} SELECT event_id, round(h, 8) AS h FROM h WHERE h > cut")
def ad_outliers(spark, d):
    return D.outliers(_leverage(spark, d)[0], "event_id").withColumn("h", F.round("h", 8))


@register("ad_reliability", f"WITH {_LEV_SQL} SELECT event_id, round(1 - least(greatest(h / (2 * cut), 0), 1), 6) AS reliability FROM h")
def ad_reliability(spark, d):
    rows, domain = _leverage(spark, d)
    return rows.select("event_id", F.round(D.reliability(F.col("h"), domain.threshold), 6).alias("reliability"))


@register("domain_flag", f"""
    WITH {_LEV_SQL} SELECT h <= cut AS in_domain, CASE WHEN h <= cut THEN 1.0 ELSE 0.5 END AS confidence, count(*) AS n FROM h GROUP BY ALL""")
def domain_flag(spark, d):
    rows, _ = _leverage(spark, d)
    flagged = rows.select(D.domain_flag(F.col("within")).alias("f"))
    return flagged.groupBy("f.in_domain", "f.confidence").agg(F.count(F.lit(1)).alias("n"))


@register("ad_leverage_total", """
    SELECT count(*) AS n, CAST(max(len(embedding)) AS DOUBLE) AS total FROM embeddings""")
def ad_leverage_total(spark, d):
    """Leverages over all dimensions add up to the rank of the features, here their number."""
    rows = embedding_features(spark, d)
    scaled = X.scale(rows, "features", X.fit_standard(rows, "features"))
    found = D.assess(scaled, "features", D.fit_domain(scaled, "features"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("h"), 4).alias("total"))


@register("ad_leverage_wide")
def ad_leverage_wide(spark, d):
    """Leverage over all 64 dimensions; the pseudo-inverse has no SQL counterpart."""
    rows = embedding_features(spark, d)
    scaled = X.scale(rows, "features", X.fit_standard(rows, "features"))
    domain = D.fit_domain(scaled, "features")
    return D.assess(scaled, "features", domain).select("vec_id", F.round("h", 6).alias("h"), "within")


@register("ad_leverage_groups", """
    SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity / sum(l_quantity * l_quantity) OVER (PARTITION BY l_orderkey % 64), 8) AS h FROM lineitem""")
def ad_leverage_groups(spark, d):
    """Leverage at 64 features, of which every row has one: its square over the sum of its feature's squares."""
    quantity = F.col("l_quantity").cast("double")
    rows = Tables(spark, d).lineitem.select(
        "l_orderkey", "l_linenumber", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.col("l_orderkey") % 64 == i, quantity).otherwise(0.0)).alias("v")
    )
    return D.add_domain_value(rows, "v", D.fit_leverage(rows, "v")).select("l_orderkey", "l_linenumber", F.round("h", 8).alias("h"))
