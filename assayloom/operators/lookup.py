"""Joins: name lookup, feature alignment, endpoint and target expansion, caches, pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assayloom.operators.ordered import first_by, null_safe_join
from assayloom.session import stage_table

# Endpoints, and the targets screened for each of them in order.
ENDPOINTS = ("herg", "hepatotox", "nephrotox", "ames", "skin_sens", "cytotox", "reproductive_tox")
ENDPOINT_TARGETS = {
    "herg": ("herg",),
    "hepatotox": ("hepatotox", "cyp2d6", "cyp2c9"),
    "nephrotox": ("herg",),
    "cytotox": ("herg",),
    "ames": (),
    "skin_sens": (),
    "reproductive_tox": ("ar", "er_alpha"),
}


def lookup_with_fallback(
    names: DataFrame,
    name: str,
    synonyms: DataFrame,
    preferred: DataFrame,
    term: str = "name",
    ident: str = "molecule_id",
    structure: str = "canonical_smiles",
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Structure and id per name: first synonym hit; if it has no structure, first preferred-name hit.

    The id follows the last table that hit. Names without a structure are dropped. Both dictionaries
    shrink to one row per name first, so a name that fills a third of a dictionary costs one row per task.
    """
    wanted = names.withColumn("_name", F.lower(F.col(name)))

    def heads(df, prefix):
        return df.groupBy(F.lower(F.col(term)).alias("_name")).agg(
            F.min_by(F.struct(F.col(ident).alias("id"), F.col(structure).alias("s")), F.struct(*order)).alias(prefix)
        )

    def text(col):
        return F.when(F.length(col) > 0, col)

    by_synonym, by_preferred = text(F.col("_syn.s")), text(F.col("_pref.s"))
    use_preferred = by_synonym.isNull() & F.col("_pref").isNotNull()
    return (
        wanted.join(heads(synonyms, "_syn"), "_name", "left")
        .join(heads(preferred, "_pref"), "_name", "left")
        .select(
            *names.columns,
            F.coalesce(by_synonym, by_preferred).alias(structure),
            F.when(use_preferred, F.col("_pref.id")).otherwise(F.col("_syn.id")).alias(ident),
        )
        .where(F.col(structure).isNotNull())
    )


def hit_rate(names: DataFrame, found: DataFrame) -> DataFrame:
    """Names found, names asked, and the share."""
    asked = names.agg(F.count(F.lit(1)).alias("n_names")).select("n_names").scalar()
    return found.agg(F.count(F.lit(1)).alias("n_found")).select(
        "n_found", asked.alias("n_names"), F.try_divide(F.col("n_found") * 100.0, asked).alias("percent")
    )


def align_features(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Feature rows of the labelled keys (the key decides, never the row order)."""
    return labels.join(features, key)


def assemble(descriptors: DataFrame, fingerprints: DataFrame, key: str, out: str = "features") -> DataFrame:
    """Descriptor and fingerprint columns or vectors side by side in one vector per key."""
    left = [c for c in descriptors.columns if c != key]
    right = [c for c in fingerprints.columns if c != key]
    joined = descriptors.join(fingerprints, key)
    return VectorAssembler(inputCols=left + right, outputCol=out).transform(joined).select(key, out)


def hybrid(aligned: DataFrame, key: str, first: str = "x2d", second: str = "x3d", label: str = "y") -> DataFrame:
    """Long table (representation, key, features, y): both array columns alone and stacked.

    The three variants are written from one pass over the joined row.
    """
    variants = F.array(
        F.struct(F.lit("2D").alias("representation"), F.col(first).alias("features")),
        F.struct(F.lit("3D").alias("representation"), F.col(second).alias("features")),
        F.struct(F.lit("Hybrid").alias("representation"), F.concat(F.col(first), F.col(second)).alias("features")),
    )
    return aligned.select(key, label, F.inline(variants))


def target_array(endpoint: Column, mapping: dict[str, Sequence[str]] = ENDPOINT_TARGETS) -> Column:
    """Targets of an endpoint; empty for unknown endpoints."""
    out = F.array().cast("array<string>")
    for name, targets in mapping.items():
        listed = F.array(*[F.lit(t) for t in targets]) if targets else F.array().cast("array<string>")
        out = F.when(endpoint == name, listed).otherwise(out)
    return out


def endpoint_targets(compounds: DataFrame, endpoint: str = "endpoint", mapping=ENDPOINT_TARGETS) -> DataFrame:
    """One row per (compound, target of its endpoint) with the target's place; no targets, no rows."""
    return compounds.select("*", F.posexplode(target_array(F.col(endpoint), mapping)).alias("target_pos", "target"))


def compounds_x_targets(compounds: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every compound with every target of a short configured list: a row-local expansion, not a join."""
    return compounds.select("*", F.posexplode(F.array(*[F.lit(t) for t in targets])).alias("target_pos", "target"))


def available_endpoints(known: Sequence[str], loaded: Sequence[str]) -> list[tuple[str, bool]]:
    return [(e, e in set(loaded)) for e in known]


def compounds_x_endpoints(
    df: DataFrame, endpoints: Sequence[str] | None = None, loaded: Sequence[str] = ENDPOINTS
) -> DataFrame:
    """Every row with every chosen endpoint; an unknown endpoint gives an error text, the others go on."""
    chosen = list(endpoints or ENDPOINTS)
    pairs = F.array(
        *[
            F.struct(
                F.lit(e).alias("endpoint"),
                F.lit(i).alias("endpoint_pos"),
                F.lit(None if e in set(loaded) else f"Model not available for endpoint: {e}").cast("string").alias("error"),
            )
            for i, e in enumerate(chosen)
        ]
    )
    return df.select("*", F.inline(pairs))


def valid_rows(df: DataFrame, scored: DataFrame, key: str, message: str = "Invalid input") -> DataFrame:
    """All input rows; those without a scored row keep success=false and an error text."""
    marked = scored.withColumn("_found", F.lit(True))
    return (
        df.join(marked, key, "left")
        .withColumn("success", F.coalesce("_found", F.lit(False)))
        .withColumn("error", F.when(F.col("_found").isNull(), F.lit(message)))
        .drop("_found")
    )


def score_missing(
    requests: DataFrame,
    cache: DataFrame,
    keys: Sequence[str],
    scorer: Callable[[DataFrame], DataFrame],
    success: str = "success",
) -> tuple[DataFrame, DataFrame]:
    """(results, new cache): only keys without a cached success are scored, each once.

    One result per request row. Null keys are keys like others. Of cached successes, or requests, that share
    a key the row that comes first by its other columns counts. Fresh rows are staged, so the scorer runs once.
    """
    keys = list(keys)
    good = _one_per_key(cache.where(F.col(success)), keys)
    todo = null_safe_join(_one_per_key(requests, keys), good.select(*keys), keys, "left_anti")
    fresh = stage_table(scorer(todo), "scored").select(*good.columns)
    new_cache = good.unionByName(fresh.where(F.col(success)))
    return null_safe_join(requests.select(*keys), good.unionByName(fresh), keys), new_cache


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return first_by(df, keys, rest) if rest else df.distinct()


def python_scorer(
    fn: Callable[[pd.DataFrame], Sequence[Sequence]], schema: str
) -> Callable[[DataFrame], DataFrame]:
    """A scorer for :func:`score_missing` from a Python function over batches of request rows.

    ``fn`` returns one tuple of result columns per row, in the order of ``schema``. The request columns pass
    through unchanged; where an integer column has nulls, ``fn`` sees its values as Python integers.
    """
    made = T.StructType.fromDDL(schema)

    def score(todo: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [f.type for f in to_arrow_schema(made)]
            for batch in batches:
                rows = list(fn(batch.to_pandas(integer_object_nulls=True)))
                columns = [pa.array([r[i] for r in rows], kind, from_pandas=True) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made.names])

        return todo.mapInArrow(run, T.StructType([*todo.schema.fields, *made.fields]))

    return score


def compare_pairs(
    pairs: DataFrame, rows: DataFrame, key: str, left: str, right: str, columns: Sequence[str]
) -> DataFrame:
    """Stated pairs side by side: one struct(left, right) per column; a failed side gives an error row."""
    sides = rows.select(key, F.struct(*columns).alias("_v"))
    a = sides.select(F.col(key).alias(left), F.col("_v").alias("_a"))
    b = sides.select(F.col(key).alias(right), F.col("_v").alias("_b"))
    joined = pairs.join(a, left, "left").join(b, right, "left")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.select(
        *pairs.columns,
        ok.alias("success"),
        *[F.struct(F.col(f"_a.{c}").alias("left"), F.col(f"_b.{c}").alias("right")).alias(c) for c in columns],
    )


def paired_folds(
    metrics: DataFrame, left: str, right: str, keys: Sequence[str] = ("model", "fold"), value: str = "value"
) -> DataFrame:
    """Same model and fold under two representations, for pair-wise tests.

    A fold present on one side only raises when the result is read.
    """
    keys = list(keys)
    side = lambda name, alias: metrics.where(F.col("representation") == name).select(*keys, F.col(value).alias(alias))
    joined = side(left, "left_value").join(side(right, "right_value"), keys, "full")
    lone = F.col("left_value").isNull() | F.col("right_value").isNull()
    return joined.where(
        F.when(lone, F.raise_error(F.lit(f"fold counts differ between {left} and {right}")).cast("boolean")).otherwise(True)
    )


def ml_with_docking(predictions: DataFrame, docking: DataFrame, key: str, mapping=ENDPOINT_TARGETS) -> DataFrame:
    """Each prediction with the result of the first target mapped to its endpoint (null when unmapped)."""
    primary = F.get(target_array(F.col("endpoint"), mapping), F.lit(0))
    dock = docking.select(
        key, "target", F.col("success").alias("dock_success"), F.col("affinity").alias("dock_affinity")
    )
    return predictions.withColumn("target", primary).join(dock, [key, "target"], "left")
