"""Composite jobs: screening runs and prediction files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.curation import build_labelled
from assayloom.operators.lookup import compounds_x_endpoints, compounds_x_targets, endpoint_targets, score_missing
from assayloom.operators.risk import binding_compatibility, enhanced_score
from assayloom.operators.scoring import EndpointModel, score_all
from assayloom.operators.screening import best_target, endpoint_summary, pivot_results, risk_distribution, screen_summary
from assayloom.session import stage_table
from assayloom.sources.assays import (
    ASSAYS_PER_KEYWORD,
    DEFAULT_ASSAYS_PER_KEYWORD,
    ENDPOINT_KEYWORDS,
    MIN_PRIMARY_ROWS,
    activities_for_assays,
    keyword_assays,
    source_or_fallback,
)
from assayloom.sources.tables import load_compounds, read_lines, write_json


def endpoint_compounds(
    assays: DataFrame, activities: DataFrame, curated: DataFrame, endpoint: str, assay_id: str = "assay_id",
    description: str = "description", structure: str = "canonical_smiles", order: Sequence[str] = ("pos",),
    min_rows: int = MIN_PRIMARY_ROWS, cache_path: str | None = None, **labels,
) -> DataFrame:
    """Labelled compounds of an endpoint: its search words find assays, their activities are labelled by its phrases,
    one row per structure; ``curated`` stands in when fewer than ``min_rows`` compounds are found.

    Activities without a structure or a clear label are left out. A table at ``cache_path`` wins over both sources and
    is written there otherwise. ``labels`` go to the labelling (columns of comment, value and units, rule order).
    """
    most = ASSAYS_PER_KEYWORD.get(endpoint, DEFAULT_ASSAYS_PER_KEYWORD)
    hits = keyword_assays(assays, assay_id, description, ENDPOINT_KEYWORDS[endpoint], most)
    found = activities_for_assays(hits, activities, assay_id, structure)
    return source_or_fallback(build_labelled(found, endpoint, structure, order=order, **labels), curated, min_rows, cache_path)


def screen(
    compounds: DataFrame, pos: str, targets: Sequence[str], scorer: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Screen a library against a target list.

    ``scorer`` turns (smiles, target) rows into results (success, affinity, ...): a join with a table of
    external scores, or a Python function run with mapInPandas. Results are written once, since four
    outputs are derived from them.
    """
    library = load_compounds(compounds, pos)
    requests = compounds_x_targets(library, targets)
    if cache is None:
        scored = scorer(requests.dropDuplicates(["smiles", "target"]))
    else:
        scored, _ = score_missing(requests, cache, ["smiles", "target"], scorer)
        scored = scored.dropDuplicates(["smiles", "target"])
    rest = [c for c in scored.columns if c not in ("smiles", "target")]
    results = requests.join(scored.select("smiles", "target", *rest), ["smiles", "target"], "left")
    results = stage_table(results.withColumn("success", F.coalesce("success", F.lit(False))), "screen")
    keys = ["pos", "name", "smiles"]
    best = best_target(results, keys)
    return {
        "results": results,
        "wide": pivot_results(results, keys, targets),
        "summary": screen_summary(results, "pos"),
        "distribution": risk_distribution(best),
    }


def enhanced_by_endpoint(compounds: DataFrame, docking: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(per target, per endpoint) enhanced scores for rows of (key, endpoint, 3D descriptors).

    Descriptors are joined before targets are unfolded, so they are computed once per compound.
    """
    per_target = endpoint_targets(compounds).join(docking, [key, "target"], "left")
    scored = enhanced_score(binding_compatibility(per_target))
    return scored, endpoint_summary(scored, [key, "endpoint"])


def enhanced_by_target(compounds: DataFrame, docking: DataFrame, key: str, target: str) -> DataFrame:
    """Enhanced scores of all compounds against one target."""
    rows = compounds.withColumn("target", F.lit(target)).join(docking, [key, "target"], "left")
    return enhanced_score(binding_compatibility(rows))


def predict_file(
    spark: SparkSession, path: str, featurise: Callable[[DataFrame], DataFrame], models: Sequence[EndpointModel],
    out: str | None = None, endpoints: Sequence[str] | None = None,
) -> DataFrame:
    """Lines of a file through every chosen endpoint model; unknown endpoints give error rows."""
    lines = read_lines(spark, path, "smiles")
    have = [m.endpoint for m in models]
    requests = compounds_x_endpoints(lines, endpoints or have, have)
    chosen = [m for m in models if endpoints is None or m.endpoint in endpoints]
    scored = score_all(featurise(lines), "pos", "features", chosen).withColumnRenamed("error", "_error")
    result = requests.join(scored, ["pos", "endpoint"], "left").withColumns(
        {"error": F.coalesce("error", "_error"), "success": F.coalesce("success", F.lit(False))}
    ).drop("_error")
    if out is not None:
        write_json(result, out)
    return result
