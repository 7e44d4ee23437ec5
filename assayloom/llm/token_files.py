"""Token ids in ORC files: one row per document, in ascending id order over all files.

ORC stores the ids as run-length encoded integers in stripes, with row indexes (minimum and maximum of the
document id for every thousand rows) and Bloom filters on the document id. Readers take stripes in
parallel, and a search for some documents skips stripes and row groups by that metadata alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.rows import quoted, whole_text
from assayloom.llm.tokens import encode_with

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
STRIPE_BYTES, ROW_GROUP, FALSE_POSITIVES = 32 << 20, 1000, 0.01


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", encode: Callable[[Iterable[str]], list[bytes]] | None = None, end_id: int = END_ID) -> str:
    """Writes (id, part, part_start, n_tokens, ids) as ORC under ``path`` and returns it.

    Rows are dealt out by ranges of the id, so file after file holds ascending ids; ``part`` numbers the
    files and ``part_start`` counts the ids before the document in its file. Null texts count as empty and
    get the end id alone. Null ids come first. Rows that share an id stand next to each other, in the order
    of their text's hash; a third key spreads copies of one row over files. An empty table writes no rows.
    """
    encode = encode or encode_with(VOCABULARY, True)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(997))
    keyed = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text"), spread.alias("spread")).withColumn("text_hash", F.xxhash64("text"))
    order = ["id", "text_hash", "spread"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    id_type = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                coded = [ids + end for ids in encode(piece.column(1).to_pylist())]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * len(coded), pa.int32()), pa.array(before + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)],
                    names=[id_col, "part", "part_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    (
        ordered.mapInArrow(run, schema)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", FALSE_POSITIVES)
        .orc(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The stored rows; ``where`` on the document id prunes files, stripes and row groups by metadata."""
    return (spark.read if schema is None else spark.read.schema(schema)).orc(path)


def file_starts(stored: DataFrame) -> DataFrame:
    """(part, file_start): ids in all files before. One row per file is numbered in one window; the id lists
    themselves are not read."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def token_digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, part) of every stored document, from the files alone."""
    schema = T.StructType([T.StructField("id", stored.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            checks = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(checks, pa.int64())], names=schema.names)

    rows = stored.select(quoted(id_col), "part", "part_start", "ids").mapInArrow(run, schema)
    return rows.join(file_starts(stored), "part").select(
        F.col("id").alias(id_col), (F.col("file_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", "part"
    )
