"""Queries over sources, labelling, curation, joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import labels as L
from assayloom.functions.scores import finite_or_null, sanitise_name
from assayloom.operators import curation as C
from assayloom.operators import lookup as J
from assayloom.operators import splits as S
from assayloom.plans.catalogue import Tables, register
from assayloom.session import stage_path
from assayloom.sources import assays as A
from assayloom.sources import structures as X
from assayloom.sources import tables as T
from assayloom.sources.state import load_state, save_state

# Comments as they occur in activity records; a row's comment follows from its ids.
COMMENTS = (
    "Inactive", "non-toxic at tested dose", "not active", "Weakly active", "Potent inhibitor",
    "Toxic", "no significant effect", "Positive", "unclear", "Non-mutagenic",
    " Cytotoxic ", "Sensitizer", "non-sensitizer", "Teratogenic", "not teratogenic", "liver injury",
)
COMMENT_SQL = (
    "(['" + "','".join(COMMENTS) + "'])[(user_id + event_id) % 16 + 1]"
)
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def _json_k():
    return F.get_json_object("props", "$.k")


def comment_column():
    listed = F.array(*[F.lit(c) for c in COMMENTS])
    return F.element_at(listed, ((F.col("user_id") + F.col("event_id")) % 16 + 1).cast("int"))


def _phrases_sql(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _rule_sql(comment: str, positive, negative, negative_first: bool = True) -> str:
    text = f"lower(trim({comment}))"
    neg, pos = f"WHEN {_phrases_sql(text, negative)} THEN 0", f"WHEN {_phrases_sql(text, positive)} THEN 1"
    return "CASE " + (f"{neg} {pos}" if negative_first else f"{pos} {neg}") + " END"


@register("scan_activity_filter", """
    SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F') AND l_extendedprice >= 40000""")
def scan_activity_filter(spark, d):
    rows = A.scan_activities(Tables(spark, d).lineitem, "l_returnflag", "R", "l_linestatus", ["O", "F"], "l_extendedprice", 40000.0)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


KEYWORDS = ("ring", "Red", "bolt", "anvil")
_HITS_SQL = """
    SELECT keyword, p_partkey, CAST(place AS INTEGER) AS place FROM (
      SELECT keyword, p_partkey, row_number() OVER (PARTITION BY keyword ORDER BY p_partkey) AS place
      FROM part JOIN (VALUES ('ring'), ('Red'), ('bolt'), ('anvil')) k(keyword)
        ON contains(lower(p_name), lower(keyword)))
    WHERE place <= 30"""


@register("keyword_topn", _HITS_SQL)
def keyword_topn(spark, d):
    return A.keyword_assays(Tables(spark, d).part, "p_partkey", "p_name", KEYWORDS, 30)


@register("keyword_activities", f"""
    SELECT keyword, place, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    JOIN ({_HITS_SQL}) h ON l_partkey = p_partkey WHERE length(l_returnflag) > 0""")
def keyword_activities(spark, d):
    t = Tables(spark, d)
    hits = keyword_topn(spark, d).withColumnRenamed("p_partkey", "l_partkey")
    rows = A.activities_for_assays(hits, t.lineitem, "l_partkey", "l_returnflag")
    return rows.select("keyword", "place", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("curated_union", """
    SELECT DISTINCT p_name AS drug_name, 1 AS activity_label, 'Toxic' AS activity_comment FROM part WHERE p_type = 'ECONOMY'
    UNION ALL
    SELECT DISTINCT p_name, 0, 'Non-toxic' FROM part WHERE p_type = 'PROMO'""")
def curated_union(spark, d):
    part = Tables(spark, d).part
    names = lambda kind: part.where(F.col("p_type") == kind).select("p_name").distinct()
    return A.curated_list(names("ECONOMY"), names("PROMO"), "p_name", "Toxic", "Non-toxic")


def _fallback_sql(floor: int) -> str:
    return f"""
    WITH p AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > {floor}),
         f AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT * FROM p WHERE (SELECT count(*) FROM p) >= 100
    UNION ALL SELECT * FROM f WHERE (SELECT count(*) FROM p) < 100"""


def _fallback(spark, d, floor):
    c = Tables(spark, d).customer
    primary = c.where(F.col("c_acctbal") > floor).select("c_custkey", "c_name")
    return A.source_or_fallback(primary, c.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name"))


@register("fallback_source", _fallback_sql(9990))
def fallback_source(spark, d):
    return _fallback(spark, d, 9990)


@register("primary_source", _fallback_sql(2000))
def primary_source(spark, d):
    return _fallback(spark, d, 2000)


@register("union_missing_columns", """
    SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, NULL AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def union_missing_columns(spark, d):
    t = Tables(spark, d)
    return A.union_all(
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
    )


_LOOKUP_SQL = """
    WITH names AS (SELECT DISTINCT upper(p_name) AS drug_name FROM part UNION SELECT DISTINCT p_type FROM part),
    syn AS (SELECT lower(p_name) AS n, first(CAST(p_partkey AS VARCHAR) ORDER BY p_partkey) AS id,
              first(CASE WHEN p_size < 20 THEN NULL WHEN p_size < 30 THEN '' ELSE p_brand END ORDER BY p_partkey) AS s FROM part GROUP BY 1),
    pref AS (SELECT lower(p_name) AS n, first(CAST(p_partkey AS VARCHAR) ORDER BY p_partkey) AS id,
              first(p_brand ORDER BY p_partkey) AS s FROM part WHERE p_size >= 40 GROUP BY 1),
    j AS (SELECT drug_name, nullif(syn.s, '') AS s1, nullif(pref.s, '') AS s2, syn.id AS i1, pref.id AS i2
          FROM names LEFT JOIN syn ON lower(drug_name) = syn.n LEFT JOIN pref ON lower(drug_name) = pref.n)"""


def _lookup(spark, d):
    part = Tables(spark, d).part
    names = part.select(F.upper("p_name").alias("drug_name")).union(part.select("p_type")).distinct()
    entry = part.select(
        F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("molecule_id"),
        F.when(F.col("p_size") < 20, None).when(F.col("p_size") < 30, "").otherwise(F.col("p_brand")).alias("canonical_smiles"),
        F.col("p_partkey").alias("pos"), "p_size",
    )
    preferred = entry.where(F.col("p_size") >= 40)
    return names, J.lookup_with_fallback(names, "drug_name", entry, preferred)


@register("name_lookup_fallback", _LOOKUP_SQL + """
    SELECT drug_name, coalesce(s1, s2) AS canonical_smiles,
           CASE WHEN s1 IS NULL AND i2 IS NOT NULL THEN i2 ELSE i1 END AS molecule_id
    FROM j WHERE coalesce(s1, s2) IS NOT NULL""")
def name_lookup_fallback(spark, d):
    return _lookup(spark, d)[1]


@register("name_lookup_hit_rate", _LOOKUP_SQL + """
    SELECT count(*) FILTER (WHERE coalesce(s1, s2) IS NOT NULL) AS n_found, count(*) AS n_names,
           round(100.0 * count(*) FILTER (WHERE coalesce(s1, s2) IS NOT NULL) / count(*), 4) AS percent FROM j""")
def name_lookup_hit_rate(spark, d):
    names, found = _lookup(spark, d)
    return J.hit_rate(names, found).withColumn("percent", F.round("percent", 4))


@register("label_rules_neg_first", f"""
    SELECT event_id, {COMMENT_SQL} AS comment, {_rule_sql(COMMENT_SQL, L.GENERAL_POSITIVE, L.GENERAL_NEGATIVE)} AS activity_label
    FROM events""")
def label_rules_neg_first(spark, d):
    rows = Tables(spark, d).events.select("event_id", comment_column().alias("comment"))
    return rows.withColumn("activity_label", L.label_by_rules(F.col("comment")))


@register("label_rules_pos_first", f"""
    SELECT event_id, {COMMENT_SQL} AS comment, {_rule_sql(COMMENT_SQL, L.GENERAL_POSITIVE, L.GENERAL_NEGATIVE, False)} AS activity_label
    FROM events""")
def label_rules_pos_first(spark, d):
    rows = Tables(spark, d).events.select("event_id", comment_column().alias("comment"))
    return rows.withColumn("activity_label", L.label_by_rules(F.col("comment"), order="positive_first"))


@register("label_endpoint_rules", "\n UNION ALL ".join(
    f"""SELECT '{e}' AS endpoint, {COMMENT_SQL} AS comment,
        {_rule_sql(COMMENT_SQL, r['positive'], r['negative'])} AS neg_first,
        {_rule_sql(COMMENT_SQL, r['positive'], r['negative'], False)} AS pos_first, count(*) AS n FROM events GROUP BY ALL"""
    for e, r in L.ENDPOINT_PHRASES.items()))
def label_endpoint_rules(spark, d):
    comments = Tables(spark, d).events.groupBy(comment_column().alias("comment")).agg(F.count(F.lit(1)).alias("n"))
    out = [
        comments.select(
            F.lit(e).alias("endpoint"), "comment",
            L.endpoint_label(F.col("comment"), e).alias("neg_first"),
            L.endpoint_label(F.col("comment"), e, "positive_first").alias("pos_first"), "n",
        )
        for e in L.ENDPOINT_PHRASES
    ]
    return A.union_all(*out)


@register("label_value_units", """
    SELECT l_returnflag, CASE WHEN l_returnflag IN ('A', 'R') THEN CAST(l_quantity < 10 AS INTEGER) END AS label, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def label_value_units(spark, d):
    units = F.when(F.col("l_returnflag") == "A", "uM").when(F.col("l_returnflag") == "R", "Micromolar").otherwise("nM")
    label = L.label_by_value(F.col("l_quantity").cast("string"), units)
    return Tables(spark, d).lineitem.groupBy("l_returnflag", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("label_contains", f"""
    WITH c AS (SELECT lower({COMMENT_SQL}) AS t FROM events)
    SELECT t AS comment, CAST((contains(t, 'positive') OR contains(t, 'toxic') OR t = '1') AS INTEGER) AS historical,
      CAST((contains(t, 'positive') OR contains(t, 'toxic') OR t = '1') AND NOT contains(t, 'non-toxic') AS INTEGER) AS label,
      count(*) AS n FROM c GROUP BY ALL""")
def label_contains(spark, d):
    c = Tables(spark, d).events.select(F.lower(comment_column()).alias("comment"))
    return c.groupBy("comment").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"historical": L.label_contains(F.col("comment"), "positive_first"), "label": L.label_contains(F.col("comment"))}
    )


@register("label_text", """
    SELECT event_type AS endpoint, CAST(value > 50 AS INTEGER) AS label,
      CASE event_type WHEN 'click' THEN 'x' ELSE event_type END AS alias,
      CASE WHEN event_type = 'view' THEN CASE WHEN value > 50 THEN 'Mutagenic' ELSE 'Non-mutagenic' END
           WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'Cytotoxic' ELSE 'Non-cytotoxic' END
           ELSE CASE WHEN value > 50 THEN 'Positive' ELSE 'Negative' END END AS label_text, count(*) AS n
    FROM events GROUP BY ALL""")
def label_text(spark, d):
    kind = F.col("event_type")
    endpoint = F.when(kind == "view", "ames").when(kind == "error", "cytotox").otherwise(kind)
    return (
        Tables(spark, d).events.groupBy(kind.alias("endpoint"), (F.col("value") > 50).cast("int").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.any_value(endpoint).alias("_e"))
        .select("endpoint", "label", F.when(F.col("endpoint") == "click", "x").otherwise(F.col("endpoint")).alias("alias"),
                L.label_text(F.col("label"), F.col("_e")).alias("label_text"), "n")
    )


@register("coerce_numeric", """
    SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'abc' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events""")
def coerce_numeric(spark, d):
    raw = F.when(F.col("event_type") == "error", "abc").otherwise(_json_k())
    return C.coerce_numeric(Tables(spark, d).events.select("event_id", raw.alias("k")), "k")


@register("drop_missing_rows", """
    SELECT event_id, k FROM (SELECT event_id, CASE WHEN value > 40 THEN json_extract_string(props, '$.k') END AS k FROM events) WHERE k IS NOT NULL""")
def drop_missing_rows(spark, d):
    return C.drop_missing(Tables(spark, d).events.select("event_id", F.when(F.col("value") > 40, _json_k()).alias("k")), ["k"])


@register("nan_inf_to_null", """
    SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN l_quantity END) AS n_finite,
      round(sum(CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN l_quantity END), 4) AS total FROM lineitem GROUP BY 1""")
def nan_inf_to_null(spark, d):
    raw = F.when(F.col("l_tax") == 0, float("inf")).when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_quantity"))
    rows = C.nan_inf_to_null(Tables(spark, d).lineitem.select("l_returnflag", raw.alias("v")), ["v"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_finite"), F.round(F.sum("v"), 4).alias("total"))


@register("sanitise_name", """
    SELECT p_partkey, lower(trim(regexp_replace('__' || p_brand || ' (' || p_name || ')--' || p_type, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS feature FROM part""")
def sanitise_names(spark, d):
    raw = F.concat(F.lit("__"), "p_brand", F.lit(" ("), "p_name", F.lit(")--"), "p_type")
    return Tables(spark, d).part.select("p_partkey", sanitise_name(raw).alias("feature"))


@register("encode_binary", f"""
    WITH z AS (SELECT l_linestatus AS s FROM lineitem ORDER BY {LINE_ORDER_SQL} LIMIT 1)
    SELECT l_linestatus, CASE WHEN l_linestatus = (SELECT s FROM z) THEN 0 ELSE 1 END AS code, count(*) AS n FROM lineitem GROUP BY ALL""")
def encode_binary(spark, d):
    rows = C.encode_binary(Tables(spark, d).lineitem, "l_linestatus", LINE_ORDER, "code")
    return rows.groupBy("l_linestatus", "code").agg(F.count(F.lit(1)).alias("n"))


@register("encode_binary_numeric", """
    SELECT doc_id, toxic, CASE WHEN toxic = 0 THEN 0 ELSE 1 END AS code FROM (SELECT doc_id, toxic * 3 AS toxic FROM labels)""")
def encode_binary_numeric(spark, d):
    rows = Tables(spark, d).labels.select("doc_id", (F.col("toxic") * 3).alias("toxic"))
    return C.encode_binary(rows, "toxic", name="code")


@register("route_task", """
    SELECT 'hepatotox' AS endpoint, CASE WHEN count(*) >= 100 THEN 'regression' ELSE 'classification' END AS route FROM labels WHERE toxic = 1
    UNION ALL SELECT 'cytotox', CASE WHEN count(*) >= 100 THEN 'regression' ELSE 'classification' END FROM labels
    UNION ALL SELECT 'herg', CASE WHEN count(*) > 0 THEN 'regression' END FROM labels""")
def route_task(spark, d):
    base = Tables(spark, d).labels.select(F.col("doc_id").cast("string").alias("canonical_smiles"), "quality", "toxic")
    some = base.withColumn("pchembl_value", F.when(F.col("toxic") == 1, F.lit(5.0)))
    every = base.withColumn("pchembl_value", F.lit(5.0))
    rows = [(e, C.route_task(df, e)) for e, df in (("hepatotox", some), ("cytotox", every), ("herg", some))]
    return spark.createDataFrame(rows, "endpoint string, route string")


@register("dedup_median_first", f"""
    SELECT l_partkey, round(median(l_extendedprice), 4) AS l_extendedprice, first(l_returnflag ORDER BY {LINE_ORDER_SQL}) AS l_returnflag,
      first(l_quantity ORDER BY {LINE_ORDER_SQL}) FILTER (WHERE l_quantity > 10) AS qty
    FROM lineitem GROUP BY 1""")
def dedup_median_first(spark, d):
    rows = Tables(spark, d).lineitem.withColumn("qty", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))
    out = C.dedup_median(rows, "l_partkey", "l_extendedprice", ["l_returnflag", "qty"], LINE_ORDER)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@register("dedup_median_hot_keys", """
    SELECT l_returnflag, round(median(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1""")
def dedup_median_hot_keys(spark, d):
    rows = C.dedup_median(Tables(spark, d).lineitem, "l_returnflag", "l_extendedprice", [], LINE_ORDER)
    return rows.select("l_returnflag", F.round("l_extendedprice", 4).alias("price"))


_LABELLED_DOCS_SQL = "SELECT md5(text) AS k, d.doc_id, n_chars, toxic, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def labelled_docs(spark, d):
    t = Tables(spark, d)
    keyed = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("inchikey"), "n_chars")
    return keyed.join(t.labels, "doc_id")


@register("curate_majority", f"""
    WITH c AS (SELECT k, CASE WHEN 2 * sum(toxic) > count(*) THEN 1 ELSE 0 END AS toxic, min(doc_id) AS doc_id
               FROM ({_LABELLED_DOCS_SQL}) WHERE n_chars BETWEEN 100 AND 9000 GROUP BY k)
    SELECT toxic, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY toxic""")
def curate_majority(spark, d):
    rows = C.range_filter(labelled_docs(spark, d), "n_chars", 100, 9000)
    voted = C.dedup_majority(rows, "inchikey", "toxic", ["doc_id"], ["doc_id"])
    return voted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@register("dedup_majority_vote", """
    SELECT l_partkey, CASE WHEN 2 * count(*) FILTER (WHERE l_linestatus = 'O') > count(*) THEN 1 ELSE 0 END AS label,
      min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1""")
def dedup_majority_vote(spark, d):
    rows = Tables(spark, d).lineitem.withColumn("label", (F.col("l_linestatus") == "O").cast("int"))
    return C.dedup_majority(rows, "l_partkey", "label", ["l_orderkey"], ["l_orderkey"])


@register("drop_duplicates_first", """
    SELECT k AS inchikey, doc_id, n_chars FROM (SELECT md5(text) AS k, doc_id, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def drop_duplicates_first(spark, d):
    rows = Tables(spark, d).documents.select(F.md5(F.col("text").cast("binary")).alias("inchikey"), "doc_id", "n_chars")
    return C.drop_duplicates(rows, ["inchikey"], ["doc_id"])


@register("class_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def class_counts(spark, d):
    rows = Tables(spark, d).labels.withColumn("c", F.struct("quality", "toxic"))
    return C.class_counts(rows, "c").select("c.quality", "c.toxic", "n")


@register("class_imbalance", """
    SELECT count(*) AS n_classes, min(n) AS minority, max(n) AS majority, round(max(n) / CAST(min(n) AS DOUBLE), 6) AS ratio
    FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)""")
def class_imbalance(spark, d):
    return C.imbalance(Tables(spark, d).labels, "toxic").withColumn("ratio", F.round("ratio", 6))


@register("range_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 900")
def range_filter(spark, d):
    return C.range_filter(Tables(spark, d).documents.select("doc_id", "n_chars"), "n_chars")


_RAW_SQL = f"""SELECT event_id, md5(CAST(user_id AS VARCHAR)) AS inchikey, 'S' || user_id AS canonical_smiles, 'M' || event_id AS molecule_id,
      {COMMENT_SQL} AS activity_comment, value * 10 AS mol_wt,
      CASE WHEN event_type = 'error' THEN 'abc' WHEN event_type = 'view' THEN NULL ELSE CAST(value AS VARCHAR) END AS pchembl_value FROM events"""


def raw_activities(spark, d):
    value = F.when(F.col("event_type") == "error", "abc").when(
        F.col("event_type") != "view", F.col("value").cast("string")
    )
    return Tables(spark, d).events.select(
        "event_id",
        F.md5(F.col("user_id").cast("string").cast("binary")).alias("inchikey"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("canonical_smiles"),
        F.concat(F.lit("M"), F.col("event_id").cast("string")).alias("molecule_id"),
        comment_column().alias("activity_comment"),
        (F.col("value") * 10).alias("mol_wt"),
        value.alias("pchembl_value"),
    )


@register("curate_regression", f"""
    SELECT inchikey, first(canonical_smiles ORDER BY event_id) AS canonical_smiles, first(molecule_id ORDER BY event_id) AS molecule_id,
      round(first(mol_wt ORDER BY event_id), 4) AS mol_wt, round(median(TRY_CAST(pchembl_value AS DOUBLE)), 4) AS pchembl_value, 'regression' AS task_type
    FROM ({_RAW_SQL}) WHERE mol_wt BETWEEN 100 AND 900 AND pchembl_value IS NOT NULL GROUP BY 1""")
def curate_regression(spark, d):
    out = C.curate(raw_activities(spark, d).drop("activity_comment"), "herg", ["event_id"])
    return out.withColumns({"mol_wt": F.round("mol_wt", 4), "pchembl_value": F.round("pchembl_value", 4)})


@register("curate_classification", f"""
    WITH r AS (SELECT *, {_rule_sql('activity_comment', L.GENERAL_POSITIVE, L.GENERAL_NEGATIVE)} AS y FROM ({_RAW_SQL}) WHERE mol_wt BETWEEN 100 AND 900)
    SELECT inchikey, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS activity_label, first(molecule_id ORDER BY event_id) AS molecule_id,
      first(canonical_smiles ORDER BY event_id) AS canonical_smiles, first(activity_comment ORDER BY event_id) AS activity_comment,
      round(first(mol_wt ORDER BY event_id), 4) AS mol_wt, 'classification' AS task_type
    FROM r WHERE y IS NOT NULL GROUP BY 1""")
def curate_classification(spark, d):
    out = C.curate(raw_activities(spark, d).drop("pchembl_value"), "hepatotox", ["event_id"])
    return out.withColumn("mol_wt", F.round("mol_wt", 4))


@register("curate_preprocessed", f"""
    SELECT k AS inchikey, CASE WHEN 2 * sum(toxic) > count(*) THEN 1 ELSE 0 END AS activity_label, min(CAST(doc_id AS VARCHAR)) AS std_smiles,
      min(n_chars) AS mol_wt, 'classification' AS task_type FROM ({_LABELLED_DOCS_SQL}) WHERE n_chars BETWEEN 100 AND 900 GROUP BY 1""")
def curate_preprocessed(spark, d):
    rows = labelled_docs(spark, d).select(
        "inchikey", F.col("doc_id").cast("string").alias("std_smiles"), F.col("toxic").alias("activity_label"), F.col("n_chars").alias("mol_wt")
    )
    return C.curate(rows, "nephrotox", ["std_smiles"])


_CYTOTOX = L.ENDPOINT_PHRASES["cytotox"]


@register("build_labelled_cytotox", f"""
    WITH r AS (SELECT *, coalesce({_rule_sql('activity_comment', _CYTOTOX['positive'], _CYTOTOX['negative'])},
                 CASE WHEN event_id % 2 = 0 THEN CAST(mol_wt < 10 AS INTEGER) END) AS y FROM ({_RAW_SQL}))
    SELECT canonical_smiles, molecule_id, y AS activity_label, CASE y WHEN 1 THEN 'Cytotoxic' ELSE 'Non-cytotoxic' END AS activity_comment, 'classification' AS task_type
    FROM (SELECT *, row_number() OVER (PARTITION BY canonical_smiles ORDER BY event_id) AS rn FROM r WHERE y IS NOT NULL) WHERE rn = 1""")
def build_labelled_cytotox(spark, d):
    rows = raw_activities(spark, d).withColumns(
        {"standard_value": F.col("mol_wt").cast("string"), "standard_units": F.when(F.col("event_id") % 2 == 0, "uM").otherwise("nM")}
    )
    return C.build_labelled(rows, "cytotox", value="standard_value", units="standard_units", order=["event_id"])


@register("prepare_regression_table", f"""
    SELECT trim(canonical_smiles) AS smiles, TRY_CAST(pchembl_value AS DOUBLE) AS pchembl_value FROM ({_RAW_SQL})
    WHERE TRY_CAST(pchembl_value AS DOUBLE) IS NOT NULL AND mol_wt >= 50""")
def prepare_regression_table(spark, d):
    return C.prepare_regression_table(raw_activities(spark, d), valid=F.col("mol_wt") >= 50)


@register("profile_molecules", "SELECT count(DISTINCT l_partkey) AS n_molecules, count(*) AS n_rows FROM lineitem")
def profile_molecules(spark, d):
    return C.profile_activities(Tables(spark, d).lineitem, "l_partkey", "l_returnflag", "l_extendedprice")["molecules"]


@register("profile_types", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def profile_types(spark, d):
    return C.profile_activities(Tables(spark, d).lineitem, "l_partkey", "l_returnflag", "l_extendedprice")["types"]


@register("profile_histogram", """
    WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def profile_histogram(spark, d):
    return C.profile_activities(Tables(spark, d).lineitem, "l_partkey", "l_returnflag", "l_extendedprice")["histogram"]


@register("load_compounds", """
    SELECT coalesce(CASE WHEN p_size > 10 THEN p_name END, 'compound_' || (p_partkey + 1)) AS name, trim(p_brand) AS smiles, p_partkey AS pos
    FROM part WHERE p_size <> 7""")
def load_compounds(spark, d):
    rows = Tables(spark, d).part.select(
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("Name"),
        F.when(F.col("p_size") == 7, F.lit(" nan")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("SMILES"), "p_partkey",
    )
    return T.load_compounds(rows, "p_partkey")


@register("load_compounds_unique", "SELECT p_name AS name, arg_max(p_brand, p_partkey) AS smiles, max(p_partkey) AS pos FROM part GROUP BY 1")
def load_compounds_unique(spark, d):
    rows = Tables(spark, d).part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("smiles"), "p_partkey")
    return T.load_compounds(rows, "p_partkey", unique_names=True)


@register("parse_list", """
    SELECT p_partkey, trim(x) AS item, CAST(i - 1 AS INTEGER) AS pos, 'compound_' || i AS name
    FROM (SELECT p_partkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT p_partkey, string_split(p_name || ', ,' || p_type || ' , ' || p_brand, ',') AS l FROM part))
    WHERE length(trim(x)) > 0""")
def parse_list(spark, d):
    text = F.concat("p_name", F.lit(", ,"), "p_type", F.lit(" , "), "p_brand")
    return T.parse_list(Tables(spark, d).part.select("p_partkey", text.alias("t")), "t")


@register("read_lines", """
    SELECT count(*) AS n, count(DISTINCT pos) AS n_pos, CAST(max(pos) AS BIGINT) AS last, count(DISTINCT item) AS n_items FROM
    (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS item FROM part)""")
def read_lines(spark, d):
    path = stage_path(spark, "lines")
    Tables(spark, d).part.select(F.concat(F.lit("  "), "p_name", F.lit(" "))).write.text(path)
    rows = T.read_lines(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("n_pos"), F.max("pos").alias("last"), F.count_distinct("item").alias("n_items"))


@register("sdf_records", """
    SELECT CASE WHEN p_size > 5 THEN p_name ELSE 'auto' END AS name, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS part FROM part""")
def sdf_records(spark, d):
    path = stage_path(spark, "sdf")
    title = F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(F.lit(""))
    text = F.concat(title, F.lit("\n  block\n\n  0  0\nM  END\n>  <brand>\n"), "p_brand", F.lit("\n\n>  <part>\n"), F.col("p_partkey").cast("string"), F.lit("\n\n$$$$"))
    Tables(spark, d).part.select(text).write.text(path)
    records = X.sdf_records(spark, path)
    get = lambda tag: F.get(F.filter("properties", lambda p: p["tag"] == tag), F.lit(0))["text"]
    return records.select(
        F.when(F.col("name").startswith("compound_"), "auto").otherwise(F.col("name")).alias("name"), get("brand").alias("brand"), get("part").alias("part")
    )


_RESIDUES = ("ALA", "PHE", "HOH", "HIS", "HEM")
_ATOMS = ("N", "CA", "CD1", "NE2", "O", "SG", "HG")


@register("receptor_atoms", f"""
    WITH a AS (SELECT l_linenumber AS ln, (['{"','".join(_RESIDUES)}'])[CAST(l_suppkey % 5 AS INTEGER) + 1] AS residue,
        (['{"','".join(_ATOMS)}'])[CAST(l_partkey % 7 AS INTEGER) + 1] AS atom_name, l_returnflag AS chain, l_quantity AS x FROM lineitem)
    SELECT residue, atom_name, CASE
        WHEN atom_name = 'HG' THEN 'HD' WHEN atom_name = 'CD1' AND residue IN ('PHE', 'HIS') THEN 'A'
        WHEN atom_name IN ('CA', 'CD1') THEN 'C' WHEN atom_name = 'NE2' AND residue = 'HIS' THEN 'NA'
        WHEN atom_name IN ('N', 'NE2') THEN 'N' WHEN atom_name = 'O' THEN 'OA' ELSE 'SA' END AS atom_type,
      count(*) AS n, round(sum(x), 3) AS sum_x
    FROM a WHERE chain = 'A' AND residue NOT IN ('HOH', 'HEM') GROUP BY ALL""")
def receptor_atoms(spark, d):
    pick = lambda items, key, n: F.element_at(F.array(*[F.lit(i) for i in items]), (F.col(key) % n + 1).cast("int"))
    atom = pick(_ATOMS, "l_partkey", 7)
    line = F.format_string(
        "ATOM  %5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("l_linenumber").cast("int"), atom,
        pick(_RESIDUES, "l_suppkey", 5), F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity"), F.lit(0.0), F.lit(-1.5), F.substring(atom, 1, 1),
    )
    atoms = X.receptor_atoms(Tables(spark, d).lineitem.select(line.alias("value")))
    return atoms.groupBy("residue", "atom_name", "atom_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sum_x"))


@register("ligand_atoms", """
    SELECT CASE CAST(l_partkey % 4 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'Cl' WHEN 2 THEN 'O' ELSE 'N' END AS element,
      CASE CAST(l_partkey % 4 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'Cl' WHEN 2 THEN 'OA' ELSE 'N' END AS atom_type, count(*) AS n
    FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL""")
def ligand_atoms(spark, d):
    atom = F.element_at(F.array(F.lit("C1"), F.lit("Cl2"), F.lit("OA"), F.lit("N")), (F.col("l_partkey") % 4 + 1).cast("int"))
    x = F.when(F.col("l_linenumber") == 3, F.lit("     bad")).otherwise(F.format_string("%8.3f", F.col("l_quantity")))
    line = F.concat(F.format_string("HETATM%5d %4s LIG     1    ", F.col("l_linenumber").cast("int"), atom), x, F.lit("   1.000   2.000"))
    atoms = X.ligand_atoms(Tables(spark, d).lineitem.select(line.alias("value")))
    return atoms.groupBy("element", "atom_type").agg(F.count(F.lit(1)).alias("n"))


@register("dock_log_poses", """
    SELECT p_partkey, CAST(g AS INTEGER) AS pose_id, round(-(p_size / 10.0) + g * 0.5, 1) AS affinity, CAST(g AS DOUBLE) AS rmsd_lb, g + 0.5 AS rmsd_ub
    FROM part, (SELECT unnest([1, 2, 3]) AS g) WHERE p_size <> 13""")
def dock_log_poses(spark, d):
    return X.poses_from_logs(dock_logs(spark, d), "log")


def dock_logs(spark, d):
    header = F.when(F.col("p_size") == 13, "no result\n").otherwise("intro 1 2 3\nmode |   affinity | dist\n-----+-----\n")
    pose = lambda g: F.format_string("%4d %8.1f %8.3f %8.3f\n", F.lit(g), -(F.col("p_size") / 10.0) + g * 0.5, F.lit(float(g)), F.lit(g + 0.5))
    text = F.concat(header, pose(1), pose(2), pose(3), F.lit("Writing output ... done.\n"))
    return Tables(spark, d).part.select("p_partkey", text.alias("log"))


@register("dock_pose_summary", """
    SELECT p_partkey, CASE WHEN p_size <> 13 THEN round(-(p_size / 10.0) + 0.5, 1) END AS affinity, CASE WHEN p_size <> 13 THEN 1.0 END AS best_pose_rmsd,
      CASE WHEN p_size <> 13 THEN 3 ELSE 0 END AS num_poses, CASE WHEN p_size <> 13 THEN '1,2' END AS top FROM part""")
def dock_pose_summary(spark, d):
    s = X.pose_summary(dock_logs(spark, d), "log")
    top = F.array_join(F.transform(X.top_poses(F.col("poses"), 2), lambda p: p["pose_id"].cast("string")), ",")
    return s.select("p_partkey", "affinity", "best_pose_rmsd", "num_poses", top.alias("top"))


@register("state_round_trip", """
    SELECT p_type, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1""")
def state_round_trip(spark, d):
    fitted = Tables(spark, d).part.groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return load_state(spark, save_state(fitted, stage_path(spark, "state")))


@register("aligned_matrices", """
    SELECT vec_id, CAST(label >= 5 AS INTEGER) * 1.0 AS y, 64 AS width_2d, 2 AS width_3d FROM embeddings""")
def aligned_matrices(spark, d):
    e = Tables(spark, d).embeddings
    target = e.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"))
    three = T.vectors_to_table(e.withColumn("half", F.col("vec_id") / 2), "vec_id", ["label", "half"], "label")
    rows = T.load_aligned(e.select("vec_id", F.col("embedding").cast("array<double>").alias("features")), three, target, "vec_id")
    return rows.select("vec_id", "y", F.size("x2d").alias("width_2d"), F.size("x3d").alias("width_3d"))


@register("json_results", """
    SELECT p_partkey, p_name, p_size FROM part""")
def json_results(spark, d):
    path = stage_path(spark, "json")
    T.write_json(Tables(spark, d).part.select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


@register("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    path = T.write_table(Tables(spark, d).customer.select("c_custkey", "c_name", "c_acctbal"), stage_path(spark, "t") + ".csv")
    return T.read_table(spark, path, "c_custkey long, c_name string, c_acctbal double")


_EXACT_SQL = """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders),
         c AS (SELECT *, ceil(n * 0.2 - 1e-9) AS nt FROM r)
    SELECT o_orderkey, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil((n - nt) * 0.125 - 1e-9) THEN 'val' ELSE 'train' END AS split FROM c"""


@register("split_exact", _EXACT_SQL)
def split_exact(spark, d):
    return S.split(Tables(spark, d).orders.select("o_orderkey"), "o_orderkey")


@register("split_hash", """
    SELECT o_orderkey, CASE WHEN h < '33333333' THEN 'test' WHEN h < '4ccccccc' THEN 'val' ELSE 'train' END AS split
    FROM (SELECT o_orderkey, substr(md5('42|' || o_orderkey), 1, 8) AS h FROM orders)""")
def split_hash(spark, d):
    return S.split(Tables(spark, d).orders.select("o_orderkey"), "o_orderkey", exact=False)


@register("split_stratified", """
    WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id)) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels),
         c AS (SELECT *, ceil(n * 0.2 - 1e-9) AS nt FROM r)
    SELECT doc_id, toxic, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil((n - nt) * 0.125 - 1e-9) THEN 'val' ELSE 'train' END AS split FROM c""")
def split_stratified(spark, d):
    return S.stratified_split(Tables(spark, d).labels.select("doc_id", "toxic"), "doc_id", "toxic")


def fold_sql(table: str, key: str, group: str = "") -> str:
    part = f"PARTITION BY repeat{', ' + group if group else ''}"
    extra = f", {group}" if group else ""
    return f"""
    WITH r AS (SELECT {key}{extra}, repeat, row_number() OVER ({part} ORDER BY md5('42|' || repeat || '|' || {key})) - 1 AS i, count(*) OVER ({part}) AS n
               FROM {table}, (SELECT unnest([0, 1, 2]) AS repeat))
    SELECT {key}{extra}, repeat, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                        ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r"""


@register("kfold_repeated", fold_sql("orders", "o_orderkey"))
def kfold_repeated(spark, d):
    return S.repeated_kfold(Tables(spark, d).orders.select("o_orderkey"), "o_orderkey")


@register("kfold_stratified", fold_sql("labels", "doc_id", "toxic"))
def kfold_stratified(spark, d):
    return S.repeated_stratified_kfold(Tables(spark, d).labels.select("doc_id", "toxic"), "doc_id", "toxic")


@register("kfold_sides", f"""
    WITH f AS ({fold_sql("labels", "doc_id")})
    SELECT repeat, CAST(h AS INTEGER) AS held_out, CASE WHEN fold = h THEN 'val' ELSE 'train' END AS side, count(*) AS n
    FROM f, (SELECT unnest([0, 1, 2, 3, 4]) AS h) GROUP BY ALL""")
def kfold_sides(spark, d):
    folds = S.repeated_kfold(Tables(spark, d).labels.select("doc_id"), "doc_id")
    return S.fold_sides(folds).groupBy("repeat", "held_out", "side").agg(F.count(F.lit(1)).alias("n"))


@register("balanced_weights", """
    SELECT doc_id, toxic, round(t.n / (t.k * c.n), 6) AS weight FROM labels JOIN (SELECT toxic, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY 1) c USING (toxic),
      (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT toxic) AS k FROM labels) t""")
def balanced_weights(spark, d):
    out = S.balanced_weights(Tables(spark, d).labels.select("doc_id", "toxic"), "toxic")
    return out.select("doc_id", "toxic", F.round("weight", 6).alias("weight"))


@register("align_features", "SELECT l.doc_id, l.toxic, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def align_features(spark, d):
    t = Tables(spark, d)
    return J.align_features(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "toxic"), "doc_id")


@register("assemble_vectors", """
    SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])) + label, 4) AS total, len(embedding) + 1 AS width FROM embeddings""")
def assemble_vectors(spark, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = Tables(spark, d).embeddings
    vectors = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = J.assemble(e.select("vec_id", "label"), vectors, "vec_id").withColumn("a", vector_to_array("features"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", F.round(total, 4).alias("total"), F.size("a").cast("long").alias("width"))


@register("hybrid_features", """
    WITH j AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price
      FROM embeddings JOIN part ON p_partkey = vec_id)
    SELECT '2D' AS representation, vec_id, CAST(64 AS INTEGER) AS width, round(first, 5) + 0.0 AS first, round(last, 5) + 0.0 AS last FROM j
    UNION ALL SELECT '3D', vec_id, 2, round(size, 5), round(price, 5) FROM j UNION ALL SELECT 'Hybrid', vec_id, 66, round(first, 5) + 0.0, round(price, 5) FROM j""")
def hybrid_features(spark, d):
    """Vectors beside a second set of features from another table, and both stacked."""
    t = Tables(spark, d)
    second = t.part.select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x3d"))
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x2d"), F.col("label").alias("y")).join(second, "vec_id")
    value = lambda at: F.round(F.element_at("features", at), 5) + F.lit(0.0)
    return J.hybrid(rows, "vec_id").select("representation", "vec_id", F.size("features").alias("width"), value(1).alias("first"), value(-1).alias("last"))


@register("endpoint_cross", """
    SELECT c_custkey, endpoint, CASE WHEN endpoint = 'unknown' THEN 'Model not available for endpoint: unknown' END AS error
    FROM customer, (VALUES ('herg'), ('ames'), ('unknown')) e(endpoint)""")
def endpoint_cross(spark, d):
    rows = J.compounds_x_endpoints(Tables(spark, d).customer.select("c_custkey"), ["herg", "ames", "unknown"])
    return rows.select("c_custkey", "endpoint", "error")


_MAP_SQL = """(VALUES ('herg', 0, 'herg'), ('hepatotox', 0, 'hepatotox'), ('hepatotox', 1, 'cyp2d6'), ('hepatotox', 2, 'cyp2c9'),
      ('nephrotox', 0, 'herg'), ('cytotox', 0, 'herg'), ('reproductive_tox', 0, 'ar'), ('reproductive_tox', 1, 'er_alpha')) m(endpoint, target_pos, target)"""
_ENDPOINT_OF_PART = "(['" + "','".join(J.ENDPOINTS) + "'])[CAST(p_partkey % 7 AS INTEGER) + 1]"


def _part_endpoints(spark, d):
    listed = F.array(*[F.lit(e) for e in J.ENDPOINTS])
    return Tables(spark, d).part.select("p_partkey", F.element_at(listed, (F.col("p_partkey") % 7 + 1).cast("int")).alias("endpoint"))


@register("endpoint_targets", f"""
    SELECT p_partkey, p.endpoint, CAST(target_pos AS INTEGER) AS target_pos, target FROM (SELECT p_partkey, {_ENDPOINT_OF_PART} AS endpoint FROM part) p JOIN {_MAP_SQL} ON p.endpoint = m.endpoint""")
def endpoint_targets(spark, d):
    return J.endpoint_targets(_part_endpoints(spark, d))


@register("compounds_x_targets", """
    SELECT s_suppkey, CAST(p AS INTEGER) AS target_pos, target FROM supplier, (VALUES (0, 'herg'), (1, 'ar'), (2, 'er_alpha')) t(p, target)""")
def compounds_x_targets(spark, d):
    return J.compounds_x_targets(Tables(spark, d).supplier.select("s_suppkey"), ["herg", "ar", "er_alpha"])


@register("valid_rows", """
    SELECT d.doc_id, toxic, toxic IS NOT NULL AS success, CASE WHEN toxic IS NULL THEN 'Invalid input' END AS error FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def valid_rows(spark, d):
    t = Tables(spark, d)
    return J.valid_rows(t.documents.select("doc_id"), t.labels.select("doc_id", "toxic"), "doc_id")


@register("score_missing_antijoin", """
    WITH cache AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS score FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2),
      req AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
    SELECT req.o_custkey, req.o_orderpriority, CASE WHEN cache.score > 300000 THEN cache.score ELSE length(req.o_orderpriority) * 1.0 END AS score,
      CASE WHEN cache.score > 300000 THEN 'cached' ELSE 'scored' END AS origin FROM req LEFT JOIN cache USING (o_custkey, o_orderpriority)""")
def score_missing_antijoin(spark, d):
    o = Tables(spark, d).orders
    cache = (
        o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
        .groupBy("o_custkey", "o_orderpriority")
        .agg(F.max("o_totalprice").alias("score"))
        .withColumns({"success": F.col("score") > 300000, "origin": F.lit("cached")})
    )
    scorer = lambda todo: todo.withColumns(
        {"score": F.length("o_orderpriority") * F.lit(1.0), "success": F.lit(True), "origin": F.lit("scored")}
    )
    results, _ = J.score_missing(o.select("o_custkey", "o_orderpriority").distinct(), cache, ["o_custkey", "o_orderpriority"], scorer)
    return results.drop("success")


@register("score_missing_python", """
    SELECT DISTINCT o_custkey, o_orderpriority, CAST(length(o_orderpriority) AS DOUBLE) AS score FROM orders""")
def score_missing_python(spark, d):
    """The scorer is a Python callable, run on batches inside the tasks."""
    requests = Tables(spark, d).orders.select("o_custkey", "o_orderpriority").distinct()
    empty = spark.createDataFrame([], "o_custkey long, o_orderpriority string, success boolean, score double")
    scorer = J.python_scorer(lambda rows: [(len(t) > 0, float(len(t))) for t in rows["o_orderpriority"]], "success boolean, score double")
    results, _ = J.score_missing(requests, empty, ["o_custkey", "o_orderpriority"], scorer)
    return results.drop("success")


@register("compare_pairs", """
    SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key, b.s_suppkey IS NOT NULL AS success, a.s_acctbal AS left_bal, b.s_acctbal AS right_bal
    FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey * 2""")
def compare_pairs(spark, d):
    s = Tables(spark, d).supplier
    pairs = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 2).alias("b"))
    out = J.compare_pairs(pairs, s.select("s_suppkey", "s_acctbal"), "s_suppkey", "a", "b", ["s_acctbal"])
    return out.select(
        F.col("a").alias("a_key"), F.when(F.col("success"), F.col("b")).alias("b_key"), "success",
        F.col("s_acctbal.left").alias("left_bal"), F.col("s_acctbal.right").alias("right_bal"),
    )


@register("featurize_once", """
    SELECT k AS inchikey, CAST(length(t) AS DOUBLE) AS f0, CAST(len(t) - len(replace(t, 'e', '')) AS DOUBLE) AS f1, false AS failed
    FROM (SELECT md5(text) AS k, min(text) AS t FROM documents GROUP BY 1)""")
def featurize_once(spark, d):
    from assayloom.operators.features import featurize_once as run

    rows = T.spread(Tables(spark, d).documents).select(F.md5(F.col("text").cast("binary")).alias("inchikey"), "text")
    out = run(rows, "inchikey", "text", lambda t: (len(t), t.count("e")))
    return out.select("inchikey", F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(1)).alias("f1"), "failed")
