import pytest
from pyspark.sql import functions as F

from assayloom.functions import labels as L
from assayloom.functions.scores import finite_or_null, sanitise_name
from assayloom.operators import curation as C
from assayloom.operators import lookup as J
from assayloom.sources import assays as A
from assayloom.sources import tables as T


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, t string")


def test_general_rules(spark):
    values = ["inactive", "Non-Toxic", "not active", "weakly active", None, "", " Potent ", "liver injury", "unclear"]
    got = [r.y for r in texts(spark, values).orderBy("pos").select(L.label_by_rules(F.col("t")).alias("y")).collect()]
    assert got == [0, 0, 0, 0, None, None, 1, 1, None]


def test_positive_first_reproduces_history(spark):
    df = texts(spark, ["inactive", "non-mutagenic", "negative"])
    old = [r.y for r in df.orderBy("pos").select(L.endpoint_label(F.col("t"), "ames", "positive_first").alias("y")).collect()]
    new = [r.y for r in df.orderBy("pos").select(L.endpoint_label(F.col("t"), "ames").alias("y")).collect()]
    assert old == [1, 1, 0] and new == [0, 0, 0]
    with pytest.raises(ValueError):
        L.label_by_rules(F.lit("x"), order="other")


def test_value_rule(spark):
    rows = spark.createDataFrame([("5", "uM"), ("10", "µM"), ("abc", "um"), ("1", "nM"), (None, "um")], "v string, u string")
    assert [r.y for r in rows.select(L.label_by_value(F.col("v"), F.col("u")).alias("y")).collect()] == [1, 0, None, None, None]


def test_label_contains(spark):
    df = texts(spark, ["Positive", "non-toxic", "1", "0", "toxic"])
    assert [r.y for r in df.select(L.label_contains(F.col("t")).alias("y")).collect()] == [1, 0, 1, 0, 1]
    assert [r.y for r in df.select(L.label_contains(F.col("t"), "positive_first").alias("y")).collect()] == [1, 1, 1, 0, 1]


def test_label_text_defaults(spark):
    df = spark.createDataFrame([("ames", 1), ("ames", 0), ("new", 1), ("new", None)], "e string, y int")
    got = [r.x for r in df.select(L.label_text(F.col("y"), F.col("e")).alias("x")).collect()]
    assert got == ["Mutagenic", "Non-mutagenic", "Positive", None]
    assert df.select(L.label_text(F.col("y"), "skin_sens").alias("x")).first().x == "Sensitizer"


def test_median_dedup_even_count_nulls_and_order(spark):
    rows = [("k1", 1.0, None, 2), ("k1", 4.0, "b", 1), ("k1", 2.0, "a", 0), ("k1", None, "z", 3), (None, 9.0, "q", 4), ("k2", 7.0, None, 5)]
    df = spark.createDataFrame(rows, "k string, v double, c string, pos int")
    got = {r.k: (r.v, r.c) for r in C.dedup_median(df, "k", "v", ["c"], ["pos"]).collect()}
    assert got == {"k1": (2.0, "a"), "k2": (7.0, None)}


def test_majority_tie_gives_smallest(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 0), (None, 1)], "k string, y int")
    assert {r.k: r.y for r in C.dedup_majority(df, "k", "y").collect()} == {"a": 0, "b": 1}


def test_range_filter_text_counts_as_zero(spark):
    df = spark.createDataFrame([("100",), ("900.0",), ("99.9",), ("abc",), (None,)], "w string")
    assert sorted(r.w for r in C.range_filter(df, "w").collect()) == ["100", "900.0"]
    assert C.range_filter(df, "w", 0, 10).count() == 2


def test_range_filter_reaches_the_scan(spark, data):
    plan = C.range_filter(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "n_chars"), "n_chars")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,100)" in text and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text


def test_encode_binary(spark):
    df = spark.createDataFrame([("yes", 1), ("no", 0), ("yes", 2)], "t string, pos int")
    assert {r.t: r.y for r in C.encode_binary(df, "t", ["pos"], "y").collect()} == {"no": 0, "yes": 1}
    numbers = spark.createDataFrame([(5,), (2,), (5,)], "t int")
    assert sorted((r.t, r.y) for r in C.encode_binary(numbers, "t", name="y").collect()) == [(2, 0), (5, 1), (5, 1)]
    for bad in ([("a", 1), ("b", 2), ("c", 3)], [("a", 1)], [("a", 1), (None, 2)]):
        with pytest.raises(ValueError):
            C.encode_binary(spark.createDataFrame(bad, "t string, pos int"), "t", ["pos"])


def test_routes(spark):
    few = spark.createDataFrame([("C", "5.0")] * 99, "canonical_smiles string, pchembl_value string")
    enough = few.union(few.limit(1))
    assert C.route_task(few, "ames") == "classification" and C.route_task(enough, "ames") == "regression"
    assert C.route_task(few, "herg") == "regression"
    assert C.route_task(few.withColumns({"std_smiles": F.lit("C"), "activity_label": F.lit(1)}), "herg") == "preprocessed"


def test_curate_regression_drops_light_and_unreadable(spark):
    rows = [
        ("k", "S", "C", "M1", "5.0", 150.0, 0), ("k", "S", "C", "M2", "abc", 150.0, 1), ("k", "S", "C", "M3", "7.0", 150.0, 2),
        ("l", "S", "C", "M4", "6.0", 90.0, 3), ("m", "S", None, "M5", "6.0", 200.0, 4),
    ]
    df = spark.createDataFrame(rows, "inchikey string, std_smiles string, canonical_smiles string, molecule_id string, pchembl_value string, mol_wt double, pos int")
    got = C.curate(df, "herg", ["pos"]).collect()
    assert [(r.inchikey, r.pchembl_value, r.molecule_id, r.task_type) for r in got] == [("k", 6.0, "M1", "regression")]


def test_duplicates_across_keywords_are_kept(spark):
    assays = spark.createDataFrame([("A1", "Ames mutagenicity assay"), ("A2", "AMES"), ("A3", None)], "assay_id string, d string")
    hits = A.keyword_assays(assays, "assay_id", "d", ["ames", "mutagenicity"], 30)
    acts = spark.createDataFrame([("A1", "C"), ("A1", ""), ("A2", "N"), ("A3", "O")], "assay_id string, s string")
    got = sorted((r.keyword, r.s) for r in A.activities_for_assays(hits, acts, "assay_id", "s").collect())
    assert got == [("ames", "C"), ("ames", "N"), ("mutagenicity", "C")]


def test_fallback_and_cache(spark, tmp_path):
    big, small, other = spark.range(100), spark.range(99), spark.range(5)
    assert A.source_or_fallback(big, other).count() == 100 and A.source_or_fallback(small, other).count() == 5
    path = str(tmp_path / "cache")
    assert A.source_or_fallback(big, other, cache_path=path).count() == 100
    assert A.source_or_fallback(small, other, cache_path=path).count() == 100


def test_lookup_falls_back_to_preferred_name(spark):
    schema = "name string, molecule_id string, canonical_smiles string, pos int"
    syn = spark.createDataFrame([("aspirin", "M1", None, 0), ("Aspirin", "M9", "X", 1), ("caffeine", "M2", "CN", 0), ("lost", "M3", "", 0)], schema)
    pref = spark.createDataFrame([("ASPIRIN", "M4", "CC", 0), ("only", "M5", "O", 0), ("lost", "M6", None, 0)], schema)
    names = spark.createDataFrame([("Aspirin",), ("Caffeine",), ("lost",), ("only",), ("none",)], "drug_name string")
    got = {r.drug_name: (r.canonical_smiles, r.molecule_id) for r in J.lookup_with_fallback(names, "drug_name", syn, pref).collect()}
    assert got == {"Aspirin": ("CC", "M4"), "Caffeine": ("CN", "M2"), "only": ("O", "M5")}


def test_unknown_endpoint_keeps_others(spark):
    rows = J.compounds_x_endpoints(spark.range(1), ["herg", "nope"], ["herg"]).collect()
    assert [(r.endpoint, r.error is None) for r in rows] == [("herg", True), ("nope", False)]
    assert J.compounds_x_endpoints(spark.range(2)).count() == 14


def test_cache_scores_only_missing(spark):
    requests = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "t")], "k string, t string")
    cache = spark.createDataFrame([("a", "t", True, 1.0), ("b", "t", False, None)], "k string, t string, success boolean, s double")
    scorer = lambda todo: todo.withColumns({"success": F.lit(True), "s": F.lit(2.0)})
    results, fresh = J.score_missing(requests, cache, ["k", "t"], scorer)
    assert sorted((r.k, r.s) for r in results.collect()) == [("a", 1.0), ("b", 2.0), ("b", 2.0)]
    assert sorted(r.k for r in fresh.collect()) == ["a", "b"]


def test_paired_folds_mismatch(spark):
    rows = spark.createDataFrame([("2D", "m", 0, 1.0), ("2D", "m", 1, 1.0), ("3D", "m", 0, 0.5)], "representation string, model string, fold int, value double")
    with pytest.raises(Exception, match="fold counts differ"):
        J.paired_folds(rows, "2D", "3D").collect()


def test_aliases_and_roles():
    assert T.resolve_alias(["SMILES", "y"], "smiles") == "SMILES"
    assert T.resolve_alias(["Canonical_Smiles"], "std") == "Canonical_Smiles"
    with pytest.raises(ValueError):
        T.resolve_alias(["a"], "smiles")
    assert T.infer_roles(["drug_name", "compound", "diri_class", "label"]) == ("compound", "label")
    assert T.infer_roles(["a", "b"]) == ("a", "b")


def test_header_and_names(spark):
    assert T.normalise_header(spark.range(1).toDF(" Drug Name ")).columns == ["drug_name"]
    df = spark.createDataFrame([("__A b--C(1)__",)], "n string")
    assert df.select(sanitise_name(F.col("n")).alias("x")).first().x == "a_b_c_1"


def test_load_compounds_gaps(spark):
    df = spark.createDataFrame([(0, " C ", None), (1, "", "x"), (2, "nan", "y"), (3, "N", "z"), (4, "O", "z")], "pos long, SMILES string, Name string")
    assert [(r.name, r.smiles) for r in T.load_compounds(df, "pos").orderBy("pos").collect()] == [("compound_1", "C"), ("z", "N"), ("z", "O")]
    assert sorted((r.name, r.smiles) for r in T.load_compounds(df, "pos", True).collect()) == [("compound_1", "C"), ("z", "O")]
    with pytest.raises(ValueError):
        T.load_compounds(df.drop("SMILES"), "pos")


def test_limit_batch(spark):
    assert T.limit_batch(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError):
        T.limit_batch(spark.range(11), 10)


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r.x for r in df.select(finite_or_null(F.col("v")).alias("x")).collect()] == [1.0, None, None, None, None]


def test_aligned_matrices(spark):
    y = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    x = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, features array<double>")
    assert T.load_aligned(x, x, y, "k").count() == 2
    for bad in (x.limit(1), x.withColumn("features", F.array(F.lit(float("nan"))))):
        with pytest.raises(ValueError):
            T.load_aligned(x, bad, y, "k")
