"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    """The top-level column ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def bounded_ids(labels: DataFrame, id_col: str, most: int, seed: str) -> DataFrame:
    """About ``most`` distinct non-null ids (all of them, if there are fewer), chosen by the hash of the id.

    The share is fixed by a count, so the result is the same on any cluster and its size is bounded in
    expectation; it is small enough to broadcast.
    """
    ids = labels.where(quoted(id_col).isNotNull()).select(quoted(id_col).alias("id")).distinct()
    share = min(1.0, most / max(1, ids.count()))
    if share >= 1:
        return ids
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10)
    return ids.where(draw.cast("long") < F.lit(int(share * 16**8)))
