"""Hierarchical residual packing of token pieces into sequences of fixed capacity.

Every task packs its own pieces best-fit, longest first, and emits the nearly full bins. What is left over,
the underfull bins, becomes the items of the next round: they are dealt to fewer tasks and packed best-fit
again, until one task holds them all or a round no longer saves bins. The number of tasks of a round follows
from the number of bins, so no task ever holds more than a stated number of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.rows import quoted, whole_text
from assayloom.llm.tokens import encode_with
from assayloom.session import stage_table

VOCABULARY = "word_bpe_49k.json"
END_ID, CAPACITY = 1, 4096
#: Bins with at most this many free places are emitted at once.
SLACK = 8
#: Underfull bins that one task packs in a later round, and how many tasks merge into one.
BINS_PER_TASK, FAN_IN = 20_000, 8


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item, longest items first, each into the fullest bin that still takes it.

    Free space is a bit set: bit r says that some bin has r places left, so the best bin is the lowest set
    bit at or above the length. Ties go to the bin opened last; equal lengths keep their order.
    """
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        fits = free >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            chosen = open_bins[left].pop()
            if not open_bins[left]:
                free &= ~(1 << left)
        else:
            left, chosen, n = capacity, n, n + 1
        bins[i] = chosen
        left -= length
        open_bins[left].append(chosen)
        free |= 1 << left
    return bins


def _packed(pieces: pd.DataFrame, capacity: int, head: int) -> pd.DataFrame:
    """Packs the bins of ``pieces`` (columns bin, offset, length, ...) into new ones and moves the pieces."""
    if pieces.empty:
        return pieces
    _, old = np.unique(pieces["bin"].to_numpy(), return_inverse=True)
    sizes = np.bincount(old, weights=pieces["length"].to_numpy()).astype(np.int64)
    new = best_fit(sizes, capacity)
    order = np.lexsort((-sizes, new))
    shift = np.empty(len(sizes), np.int64)
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.r_[True, np.diff(new[order]) > 0]
    shift[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    fill = np.bincount(new, weights=sizes).astype(np.int64)
    return pieces.assign(bin=new[old] + head, offset=pieces["offset"].to_numpy() + shift[old], fill=fill[new[old]])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encode: Callable[[Iterable[str]], list[bytes]] | None = None, end_id: int = END_ID, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and the end id; only documents over the capacity are cut, into full pieces and a
    rest. Null and empty texts are the end id alone. Null ids and repeated rows are packed like any other
    row, each on its own; ids pass through unchanged. An empty table gives no rows. Sequence numbers are unique, not dense.
    """
    encode = encode or encode_with(VOCABULARY, False)
    end = np.array([end_id], "<u4").tobytes()
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "bin", "offset", "fill")]
    )

    names = [f.name for f in schema.fields[1:]]

    def rows(ids: pa.Array, facts: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(facts[c].to_numpy(np.int64)) for c in names)], names=schema.names)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, facts = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, owners = batch.slice(at, 1024), []
                for doc, coded in enumerate(encode(part.column(1).to_pylist())):
                    coded += end
                    for piece, start in enumerate(range(0, len(coded), 4 * capacity)):
                        cut = coded[start:start + 4 * capacity]
                        owners.append(doc)
                        facts.append((piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
                ids.append(part.column(0).take(pa.array(owners, pa.int32())))
        if facts:
            table = pd.DataFrame(np.array(facts, np.int64), columns=["piece", "start", "length", "ids_crc32"])
            table["bin"], table["offset"] = np.arange(len(table)), 0
            yield rows(pa.concat_arrays(ids), _packed(table, capacity, TaskContext.get().partitionId() << 32))

    texts = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text"))
    packed = stage_table(texts.mapInArrow(first_round, schema), "pack")
    full = F.col("fill") >= capacity - slack
    done, rest = [packed.where(full)], packed.where(~full)
    tasks, bins = max(1, packed.rdd.getNumPartitions()), rest.select("bin").distinct().count()
    turn = 0
    while bins > 1:
        turn += 1
        least = -(-bins // BINS_PER_TASK)
        tasks = max(least, -(-tasks // FAN_IN))
        head = turn << 56

        def again(batches: Iterator[pa.RecordBatch], head: int = head) -> Iterator[pa.RecordBatch]:
            mine = [b for b in batches if b.num_rows]
            if mine:
                whole = pa.Table.from_batches(mine).combine_chunks()
                yield rows(whole.column(0).combine_chunks(), _packed(whole.select(names).to_pandas(), capacity, head + (TaskContext.get().partitionId() << 32)))

        dealt = rest.withColumn("deal", F.xxhash64("bin", F.lit(turn))).repartition(tasks, "deal").sortWithinPartitions("bin", "offset").drop("deal")
        packed = stage_table(dealt.mapInArrow(again, schema), "pack")
        done.append(packed.where(full))
        rest = packed.where(~full)
        before, bins = bins, rest.select("bin").distinct().count()
        emitted = done[-1].select("bin").distinct().count()
        if tasks == 1 or tasks == least and bins + emitted > 0.999 * before:
            break
    done.append(rest)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
