"""Attribution tables, alerts and design advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.functions.text import feature_category, pick

# Structural alerts (name, substructure query, concern, severity). The queries need a
# chemistry toolkit; alert_counts works on text patterns given by the caller.
STRUCTURAL_ALERTS = (
    ("nitro_aromatic", "[N+](=O)[O-]c", "Mutagenicity, hepatotoxicity", "high"),
    ("aromatic_amine", "c-[NH2]", "Mutagenicity, carcinogenicity", "high"),
    ("quinone", "O=C1C=CC(=O)C=C1", "Cytotoxicity, oxidative stress", "moderate"),
    ("epoxide", "C1OC1", "Reactive metabolite, hepatotoxicity", "moderate"),
    ("michael_acceptor", "C=CC=O", "Protein reactivity, hepatotoxicity", "moderate"),
    ("thiophene", "c1ccsc1", "Hepatotoxicity (metabolic activation)", "low"),
    ("furan", "c1ccoc1", "Hepatotoxicity (metabolic activation)", "moderate"),
    ("hydrazine", "NN", "Hepatotoxicity, mutagenicity", "high"),
    ("halogenated_aromatic", "c[F,Cl,Br,I]", "Potential metabolic issues", "low"),
    ("aldehyde", "[CH]=O", "Protein reactivity", "moderate"),
)
# Advice on features that raise the risk (feature, priority, type, advice, reason start).
FEATURE_ADVICE = (
    ("MolLogP", "medium", "property_optimization", "Consider reducing lipophilicity (LogP)", "High LogP contributes to"),
    ("LogP", "medium", "property_optimization", "Consider reducing lipophilicity (LogP)", "High LogP contributes to"),
    ("MolWt", "low", "property_optimization", "Consider reducing molecular weight", "High MW contributes to"),
    ("NumAromaticRings", "medium", "structural_modification", "Consider reducing aromatic ring count", "Aromatic rings contribute to"),
)
PRIORITIES = ("high", "medium", "low")


def top_of_array(vec: Column, k: int, names: Sequence[str] | None = None) -> Column:
    """Row-local top-k of a contribution array: struct(rank, idx, feature, value, contribution).

    Largest absolute value first, the earlier place first on ties. Nothing is shuffled.
    """
    entries = F.transform(
        vec, lambda x, i: F.struct((-F.abs(x)).alias("order"), i.alias("idx"), x.alias("value"))
    )
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    best = F.slice(F.array_sort(entries), 1, k)
    label = F.lit(list(names)) if names is not None else None

    def shape(e, i):
        feature = F.get(label, e["idx"]) if label is not None else e["idx"].cast("string")
        return F.struct(
            (i + 1).alias("rank"),
            e["idx"].alias("idx"),
            feature.alias("feature"),
            e["value"].alias("value"),
            contribution(e["value"]).alias("contribution"),
            F.abs(e["value"]).alias("importance"),
        )

    return F.transform(best, shape)


def contribution(value: Column) -> Column:
    return F.when(value > 0, "increases").otherwise("decreases")


def top_features(df: DataFrame, vec: str, k: int = 10, names: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Long table of the top-k contributions per row."""
    return df.select(*keep, F.inline(top_of_array(F.col(vec), k, names)))


def top_features_long(df: DataFrame, keys: Sequence[str], feature: str, value: str, k: int = 10) -> DataFrame:
    """The same from a long table; the rank bound is applied before the shuffle too."""
    order = W.partitionBy(*keys).orderBy(F.desc(F.abs(value)), F.col(feature))
    return (
        df.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("contribution", contribution(F.col(value)))
        .withColumn("importance", F.abs(value))
    )


def common_features(
    top: DataFrame, by: Sequence[str] = (), feature: str = "feature", value: str = "value",
    least: int = 2, k: int = 10, order: str = "endpoint",
) -> DataFrame:
    """Features on the lists of at least ``least`` endpoints: count and impacts, top k by count.

    A group has one entry per endpoint, so the collected lists are short.
    """
    impact = F.struct(F.col(order).alias("endpoint"), F.col(value).alias("value"), contribution(F.col(value)).alias("contribution"))
    counted = top.groupBy(*by, feature).agg(
        F.count(F.lit(1)).alias("endpoints_affected"), F.array_sort(F.collect_list(impact)).alias("impacts")
    )
    ranked = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return (
        counted.where(F.col("endpoints_affected") >= least)
        .withColumn("place", F.row_number().over(ranked.orderBy(F.desc("endpoints_affected"), feature)))
        .where(F.col("place") <= k)
    )


def opposite_effects(
    top: DataFrame, by: Sequence[str] = (), feature: str = "feature", value: str = "value",
    rank: str = "rank", within: int = 5, k: int = 5, order: str = "endpoint",
) -> DataFrame:
    """Features with both signs among the first ``within`` of each endpoint, as a sentence naming two endpoints."""
    sign = F.when(F.col(value) > 0, 1).otherwise(-1)
    grouped = (
        top.where(F.col(rank) <= within)
        .groupBy(*by, feature)
        .agg(F.array_sort(F.collect_set(F.col(order))).alias("_e"), F.min(sign).alias("_lo"), F.max(sign).alias("_hi"))
        .where((F.col("_lo") != F.col("_hi")) & (F.size("_e") >= 2))
    )
    text = F.format_string(
        "'%s' has opposite effects on %s vs %s", F.col(feature).cast("string"), F.col("_e")[0].cast("string"), F.col("_e")[1].cast("string")
    )
    ranked = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return (
        grouped.withColumn("place", F.row_number().over(ranked.orderBy(feature)))
        .where(F.col("place") <= k)
        .select(*by, feature, "place", text.alias("insight"))
    )


def categorise(top: DataFrame, feature: str = "feature") -> DataFrame:
    return top.withColumn("category", feature_category(F.col(feature)))


def alert_counts(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str, str]], keep: Sequence[str]) -> DataFrame:
    """(keep..., alert, concern, severity, occurrences) for every rule that occurs in the whole text.

    Rules are a short configured list of (alert, regular expression, concern, severity). Each pattern is
    a literal, compiled once, and a row expands into its own hits.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(alert).alias("alert"),
                F.lit(concern).alias("concern"),
                F.lit(severity).alias("severity"),
                F.regexp_count(F.col(text), F.lit(pattern)).alias("occurrences"),
            )
            for alert, pattern, concern, severity in rules
        ]
    )
    return df.select(*keep, F.inline(F.filter(found, lambda a: a["occurrences"] > 0)))


def annotate_alerts(matches: DataFrame, alert: str = "alert") -> DataFrame:
    """Adds concern and severity to alert hits found elsewhere (substructure matching is an input)."""
    concern = {name: why for name, _, why, _ in STRUCTURAL_ALERTS}
    severity = {name: how for name, _, _, how in STRUCTURAL_ALERTS}
    return matches.withColumn("concern", pick(F.col(alert), concern)).withColumn("severity", pick(F.col(alert), severity))


def distinct_recs(
    recs: DataFrame, by: Sequence[str], text: str = "recommendation", priority: str = "priority", pos: str = "pos", k: int = 10
) -> DataFrame:
    """Per group: one row per text (the first wins), ordered high < medium < low, at most ``k``."""
    rest = [c for c in recs.columns if c not in (*by, text)]
    unique = recs.groupBy(*by, text).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_r")).select(*by, text, "_r.*")
    rank = F.lit(len(PRIORITIES))
    for i, name in reversed(list(enumerate(PRIORITIES))):
        rank = F.when(F.col(priority) == name, F.lit(i)).otherwise(rank)
    order = W.partitionBy(*by).orderBy(rank, pos)
    return unique.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def alert_recommendations(alerts: DataFrame, keep: Sequence[str], pos: str = "pos") -> DataFrame:
    """High-severity alerts as high-priority advice."""
    return alerts.where(F.col("severity") == "high").select(
        *keep,
        F.lit("high").alias("priority"),
        F.lit("structural_modification").alias("type"),
        F.concat(F.lit("Consider removing or replacing "), F.col("alert"), F.lit(" moiety")).alias("recommendation"),
        F.col("concern").alias("reason"),
        F.struct(F.lit(0).alias("source"), F.col(pos).cast("string").alias("at")).alias("pos"),
    )


def feature_recommendations(top: DataFrame, keep: Sequence[str], endpoint: str = "endpoint") -> DataFrame:
    """Advice on named features that raise the risk and are among an endpoint's first three."""
    advice = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(priority).alias("priority"), F.lit(kind).alias("type"),
                F.lit(text).alias("recommendation"), F.lit(reason).alias("start"),
            )
            for name, priority, kind, text, reason in FEATURE_ADVICE
        ]
    )
    raised = top.where((F.col("rank") <= 3) & (F.col("value") > 0))
    hits = raised.select(
        *keep, endpoint, "rank", F.explode(F.filter(advice, lambda a: a["name"] == F.col("feature"))).alias("_a")
    )
    return hits.select(
        *keep,
        F.col("_a.priority").alias("priority"),
        F.col("_a.type").alias("type"),
        F.col("_a.recommendation").alias("recommendation"),
        F.concat_ws(" ", F.col("_a.start"), F.col(endpoint).cast("string"), F.lit("risk")).alias("reason"),
        F.struct(
            F.lit(1).alias("source"), F.concat(F.col(endpoint).cast("string"), F.lit("|"), F.col("rank").cast("string")).alias("at")
        ).alias("pos"),
    )


def design_recommendations(alerts: DataFrame, top: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """Advice from alerts and attributions, without repeats, by priority."""
    every = alert_recommendations(alerts, by, "alert").unionByName(feature_recommendations(top, by))
    return distinct_recs(every, by, k=k).drop("pos")


def linear_attribution(df: DataFrame, vec: str, coefficients: Sequence[float], means: Sequence[float], out: str = "contributions") -> DataFrame:
    """Exact contributions of a linear score: coefficient x (x - mean), as an array per row, with their sum."""
    centred = F.zip_with(F.col(vec), F.lit([float(m) for m in means]), lambda x, m: x - m)
    parts = F.zip_with(centred, F.lit([float(c) for c in coefficients]), lambda d, c: d * c)
    return df.withColumn(out, parts).withColumn("attribution_sum", F.aggregate(out, F.lit(0.0), lambda a, x: a + x))
