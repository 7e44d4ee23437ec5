"""Table and line readers, compound lists, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema of raw activity and assay tables (numbers arrive as text).
ACTIVITY_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "assay_id", "molecule_id", "canonical_smiles", "standard_type",
            "standard_value", "standard_units", "pchembl_value", "activity_comment",
        )
    ]
)
ASSAY_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("assay_id", "description")])
# Column aliases tried when a compound table is read, in order.
STRUCTURE_ALIASES = ("smiles", "SMILES", "Smiles", "canonical_smiles", "std_smiles")
NAME_ALIASES = ("name", "Name", "id", "ID", "compound_id", "mol_id")
REGRESSION_ALIASES = ("smiles", "std_smiles", "canonical_smiles")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV by file name; CSV takes a schema so that no inference pass is needed."""
    name = path.lower().rstrip("/*")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if name.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).csv(path)
    if name.endswith((".json", ".jsonl")):
        return reader.json(path)
    if name.endswith(".orc"):
        return reader.orc(path)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """CSV when the path says so, parquet otherwise."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if path.lower().endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def json_column(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All (or some) columns of a row as one JSON string."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def normalise_header(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed column names with underscores for blanks."""
    return df.toDF(*[c.lower().strip().replace(" ", "_") for c in df.columns])


def infer_roles(columns: Sequence[str]) -> tuple[str, str | None]:
    """(name column, label column): the last column whose name says so, else the first and second."""

    def last_with(words):
        return next((c for c in reversed(columns) if any(w in c for w in words)), None)

    label = last_with(("diri", "label", "class", "toxicity"))
    return (
        last_with(("drug", "name", "compound")) or columns[0],
        label or (columns[1] if len(columns) > 1 else None),
    )


def resolve_alias(columns: Sequence[str], preferred: str, aliases: Sequence[str] = REGRESSION_ALIASES) -> str:
    """Exact match on the preferred name, then case-insensitive match on it and the aliases."""
    if preferred in columns:
        return preferred
    by_lower = {c.lower(): c for c in columns}
    for name in (preferred.lower(), *aliases):
        if name in by_lower:
            return by_lower[name]
    raise ValueError(f"no column like {preferred!r} among {list(columns)}")


def spread(df: DataFrame) -> DataFrame:
    """A file scan dealt out over all cores when it has fewer splits than that.

    For work that is heavy per row (text scans, user functions) on a small table; a large table has more
    splits than cores and stays where it is. ``df`` must be a plain file read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def with_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """0-based row position of a file scan, in file order, without moving the rows.

    Row counts per input block (one small row each) give the offset of the block; the place inside a
    block comes from the scan itself. ``df`` must be a file read without a shuffle in between.
    """
    located = df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = located.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return located.join(offsets, ["_file", "_block"]).select(
        *df.columns, (F.col("_offset") + F.col("_mid") - F.col("_first")).alias(name)
    )


def read_lines(spark: SparkSession, path: str, column: str = "item") -> DataFrame:
    """One trimmed, non-empty item per line, with its line position."""
    return (
        with_positions(spark.read.text(path))
        .select(F.trim("value").alias(column), "pos")
        .where(F.length(column) > 0)
    )


def parse_list(df: DataFrame, text: str, separator: str = ",", item: str = "item") -> DataFrame:
    """Separated text to rows (other columns repeated); blanks dropped, auto-name by 1-based place."""
    rest = [c for c in df.columns if c != text]
    return (
        df.select(*rest, F.posexplode(F.split(F.col(text), separator)).alias("pos", item))
        .withColumn(item, F.trim(item))
        .where(F.length(item) > 0)
        .withColumn("name", F.concat(F.lit("compound_"), (F.col("pos") + 1).cast("string")))
    )


def load_compounds(df: DataFrame, pos: str, unique_names: bool = False) -> DataFrame:
    """(name, smiles, pos) from any table with a recognised structure column.

    Structures are trimmed; empty ones and the text 'nan' are dropped. Missing names become
    ``compound_<original row + 1>``, so gaps stay visible. ``unique_names`` lets later rows replace
    earlier rows of the same name.
    """
    structure = next((c for c in STRUCTURE_ALIASES if c in df.columns), None)
    if structure is None:
        raise ValueError(f"no structure column among {df.columns}; expected one of {STRUCTURE_ALIASES}")
    label = next((c for c in NAME_ALIASES if c in df.columns), None)
    auto = F.concat(F.lit("compound_"), (F.col(pos) + 1).cast("string"))
    named = F.coalesce(F.col(label).cast("string"), auto) if label else auto
    out = df.select(named.alias("name"), F.trim(F.col(structure).cast("string")).alias("smiles"), F.col(pos).alias("pos"))
    out = out.where((F.col("smiles") != "") & (F.col("smiles") != "nan"))
    if unique_names:
        out = out.groupBy("name").agg(F.max_by("smiles", "pos").alias("smiles"), F.max("pos").alias("pos"))
    return out


def limit_batch(df: DataFrame, most: int) -> DataFrame:
    """Guard of the request-sized jobs: more than ``most`` rows is an error, never a silent cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"batch holds more than {most} rows")
    return df


def vectors_to_table(df: DataFrame, key: str, columns: Sequence[str], label: str) -> DataFrame:
    """(key, features ARRAY<DOUBLE>, y) from separate numeric columns."""
    return df.select(
        key, F.array(*[F.col(c).cast("double") for c in columns]).alias("features"), F.col(label).cast("double").alias("y")
    )


def load_aligned(x2d: DataFrame, x3d: DataFrame, y: DataFrame, key: str, vec: str = "features", label: str = "y") -> DataFrame:
    """Join two feature tables and labels by key, with the shape checks done on counts.

    Row counts must agree, every key must match, labels need two classes, and vectors one width without
    NaN or null entries.
    """
    joined = (
        y.select(key, F.col(label).cast("double").alias("y"))
        .join(x2d.select(key, F.col(vec).alias("x2d")), key)
        .join(x3d.select(key, F.col(vec).alias("x3d")), key)
    )

    def bad(v):
        return F.exists(v, lambda x: x.isNull() | F.isnan(x))

    facts = joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("y").alias("classes"),
        F.min(F.size("x2d")).alias("w2a"), F.max(F.size("x2d")).alias("w2b"),
        F.min(F.size("x3d")).alias("w3a"), F.max(F.size("x3d")).alias("w3b"),
        F.count_if(bad(F.col("x2d")) | bad(F.col("x3d"))).alias("bad"),
    ).first()
    sizes = {"labels": y.count(), "x2d": x2d.count(), "x3d": x3d.count()}
    problems = [f"{name} has {n} rows, {facts.n} matched" for name, n in sizes.items() if n != facts.n]
    if facts.n and (facts.w2a != facts.w2b or facts.w3a != facts.w3b):
        problems.append("vectors differ in width")
    if facts.classes != 2:
        problems.append(f"{facts.classes} classes instead of 2")
    if facts.bad:
        problems.append(f"{facts.bad} rows with NaN or null entries")
    if problems:
        raise ValueError("; ".join(problems))
    return joined
