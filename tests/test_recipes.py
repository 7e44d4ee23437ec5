"""From search words to labelled compounds of an endpoint."""

from assayloom.plans.jobs import endpoint_compounds


def test_endpoint_compounds_and_their_fallback(spark, tmp_path):
    assays = spark.createDataFrame([(1, "Ames test"), (2, "Salmonella and AMES"), (3, "solubility"), (4, None)], "assay_id long, description string")
    activities = spark.createDataFrame(
        [(1, "C", "mutagenic", 1), (2, "C", "negative", 2), (2, "CC", "Non-mutagenic", 3), (3, "CCC", "mutagenic", 4), (1, None, "mutagenic", 5), (1, "N", "unclear", 6), (1, "", "mutagenic", 7)],
        "assay_id long, canonical_smiles string, activity_comment string, pos long",
    )
    curated = spark.createDataFrame([("O", 1)], "canonical_smiles string, activity_label int")
    got = endpoint_compounds(assays, activities, curated, "ames", min_rows=2)
    assert sorted((r.canonical_smiles, r.activity_label) for r in got.collect()) == [("C", 1), ("CC", 0)]
    path = str(tmp_path / "ames")
    few = endpoint_compounds(assays, activities, curated, "ames", cache_path=path)
    assert [r.canonical_smiles for r in few.collect()] == ["O"]
    again = endpoint_compounds(assays, activities, curated, "ames", min_rows=1, cache_path=path)
    assert [r.canonical_smiles for r in again.collect()] == ["O"]
