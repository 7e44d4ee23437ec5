"""Text formats of structures and docking logs, read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.sources.tables import with_positions

# Residues and elements left out of a receptor table.
SKIPPED_RESIDUES = ("HOH", "WAT", "NA", "CL", "MG", "CA", "ZN", "FE", "HEM", "HEC")
METALS = ("FE", "ZN", "MG", "MN", "CU", "CO", "NI", "CA")
# Names and residues that decide the atom type.
POLAR_HYDROGENS = (
    "HN", "H", "HE", "HE1", "HE2", "HD1", "HD2", "HH", "HH11", "HH12", "HH21", "HH22", "HG", "HG1",
)
BACKBONE_CARBONS = ("C", "CA", "CB")
AROMATIC_RESIDUES = ("PHE", "TYR", "TRP", "HIS")
ACCEPTOR_NITROGEN_RESIDUES = ("HIS", "TRP")
ACCEPTOR_NITROGENS = ("NE2", "ND1", "NE1")
# Ligand element to atom type.
LIGAND_TYPES = {
    "C": "C", "N": "N", "O": "OA", "S": "SA", "H": "HD",
    "F": "F", "Cl": "Cl", "Br": "Br", "I": "I", "P": "P",
}
POSE_HEADER = "mode |   affinity"


def _field(line: Column, first: int, last: int) -> Column:
    """Trimmed fixed-width field, 1-based inclusive columns."""
    return F.trim(F.substring(line, first, last - first + 1))


def receptor_atom_type(element: Column, name: Column, residue: Column) -> Column:
    """Atom type of a receptor atom from element, atom name and residue."""
    ring_carbon = residue.isin(*AROMATIC_RESIDUES) & name.startswith("C") & ~name.isin(*BACKBONE_CARBONS)
    return (
        F.when(element == "H", F.when(name.isin(*POLAR_HYDROGENS), "HD").otherwise("H"))
        .when(element == "C", F.when(ring_carbon, "A").otherwise("C"))
        .when(
            element == "N",
            F.when(residue.isin(*ACCEPTOR_NITROGEN_RESIDUES) & name.isin(*ACCEPTOR_NITROGENS), "NA").otherwise("N"),
        )
        .when(element == "O", "OA")
        .when(element == "S", "SA")
        .when(F.length(element) <= 2, element)
        .otherwise("C")
    )


def ligand_atom_type(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LIGAND_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, element), F.lit("C"))


def atom_columns(lines: DataFrame, value: str = "value") -> DataFrame:
    """ATOM / HETATM lines as columns; other lines and lines too short for coordinates are dropped."""
    v = F.col(value)
    rest = [c for c in lines.columns if c != value]
    return lines.where((v.startswith("ATOM") | v.startswith("HETATM")) & (F.length(v) >= 54)).select(
        *rest,
        _field(v, 1, 6).alias("record"),
        _field(v, 13, 16).alias("atom_name"),
        _field(v, 18, 20).alias("residue"),
        F.substring(v, 22, 1).alias("chain"),
        _field(v, 31, 38).try_cast("double").alias("x"),
        _field(v, 39, 46).try_cast("double").alias("y"),
        _field(v, 47, 54).try_cast("double").alias("z"),
        F.when(F.length(v) > 76, _field(v, 77, 78)).alias("element_field"),
    )


def receptor_atoms(lines: DataFrame, chain: str = "A", value: str = "value") -> DataFrame:
    """Atoms of one chain without water, ions, heme and metals, with their atom types."""
    atoms = atom_columns(lines, value).where((F.col("chain") == chain) & ~F.col("residue").isin(*SKIPPED_RESIDUES))
    metal_probe = F.upper(F.coalesce(F.col("element_field"), F.substring("atom_name", 1, 2)))
    element = F.upper(F.coalesce(F.col("element_field"), F.substring("atom_name", 1, 1)))
    return (
        atoms.where(~metal_probe.isin(*METALS))
        .withColumn("element", element)
        .withColumn("atom_type", receptor_atom_type(F.col("element"), F.col("atom_name"), F.col("residue")))
        .drop("element_field")
    )


def ligand_atoms(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ligand atoms: every record with readable coordinates; a missing element is read off the name."""
    atoms = atom_columns(lines, value).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    )
    letters = F.regexp_replace("atom_name", "[^A-Za-z]", "")
    from_name = F.when(F.substring(letters, 2, 1).rlike("[A-Z]"), F.substring(letters, 1, 1)).otherwise(
        F.substring(letters, 1, 2)
    )
    found = F.coalesce(F.col("element_field"), from_name)
    element = F.when(found == "", "C").otherwise(found)
    return atoms.withColumn("element", element).withColumn("atom_type", ligand_atom_type(F.col("element"))).drop("element_field")


def fixed_width_atoms(spark: SparkSession, path: str, chain: str = "A") -> DataFrame:
    """Receptor atom table of one or many structure files, with file and line position."""
    lines = with_positions(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))
    return receptor_atoms(lines, chain)


def pose_array(text: Column) -> Column:
    """Poses of one docking log as an array of struct(pose_id, affinity, rmsd_lb, rmsd_ub), in file order.

    A pose line follows the header, has at least four tokens, and starts with digits only. Everything
    happens inside the row.
    """
    body = F.when(F.contains(text, F.lit(POSE_HEADER)), F.substring_index(text, POSE_HEADER, -1))
    tokens = F.transform(F.split(body, "\\r?\\n"), lambda line: F.split(F.trim(line), "\\s+"))
    lines = F.filter(tokens, lambda t: (F.size(t) >= 4) & t[0].rlike("^[0-9]+$"))
    return F.transform(
        lines,
        lambda t: F.struct(
            t[0].try_cast("int").alias("pose_id"),
            t[1].try_cast("double").alias("affinity"),
            t[2].try_cast("double").alias("rmsd_lb"),
            t[3].try_cast("double").alias("rmsd_ub"),
        ),
    )


def poses_from_logs(logs: DataFrame, text: str) -> DataFrame:
    """Pose rows of docking logs held one per row; other columns are repeated."""
    return logs.select(*[c for c in logs.columns if c != text], F.inline(pose_array(F.col(text))))


def parse_dock_logs(spark: SparkSession, path: str) -> DataFrame:
    """Pose table of docking log files (one log per file)."""
    logs = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return poses_from_logs(logs, "value")


def pose_summary(logs: DataFrame, text: str) -> DataFrame:
    """Per log: the first pose as the best one, pose count, and the poses in order; null when there is none."""
    rest = [c for c in logs.columns if c != text]
    rows = logs.select(*rest, pose_array(F.col(text)).alias("poses"))
    best = F.get("poses", F.lit(0))
    return rows.select(
        *rest,
        best["affinity"].alias("affinity"),
        best["rmsd_lb"].alias("best_pose_rmsd"),
        F.coalesce(F.size("poses"), F.lit(0)).alias("num_poses"),
        "poses",
    )


def top_poses(poses: Column, k: int = 3) -> Column:
    """First ``k`` poses of the ordered array."""
    return F.slice(poses, 1, k)


def sdf_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: title (or ``compound_<place>``) and the property block as (tag, text) pairs."""
    records = with_positions(spark.read.option("lineSep", "$$$$\n").text(path)).where(F.length(F.trim("value")) > 0)
    title = F.trim(F.substring_index("value", "\n", 1))
    tags = F.regexp_extract_all("value", F.lit("(?m)^>[^<\\n]*<([^>\\n]+)>"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit("(?m)^>[^<\\n]*<[^>\\n]+>[^\\n]*\\n([^\\n]*)"), F.lit(1))
    return records.select(
        "pos",
        F.when(title != "", title)
        .otherwise(F.concat(F.lit("compound_"), (F.col("pos") + 1).cast("string")))
        .alias("name"),
        F.arrays_zip(tags.alias("tag"), values.alias("text")).alias("properties"),
    )
