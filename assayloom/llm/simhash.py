"""SimHash near-duplicates, linked through tables of distances to reference fingerprints.

Fingerprints are 64 bits over 3-word shingles. Two of them link at ``MAX_BITS`` or fewer differing bits.

Search: the 64 positions are cut into six blocks. At most three blocks can differ, so two linked
fingerprints have distance 0 between each other in three blocks, and equal distances to every reference
fingerprint there; the three blocks' bits are the key on which they meet. Among those that meet, a pivot
table of Hamming distances to 16 reference fingerprints discards every pair whose distances to any
reference differ by more than ``MAX_BITS`` (triangle inequality), and only survivors are compared bit by
bit. Copies are one fingerprint. Each group yields a spanning forest of its links, never all pairs; groups
over ``GROUP_ROWS`` fingerprints are cut into parts and every pair of parts is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.components import components
from assayloom.llm.rows import free_name, quoted, whole_text
from assayloom.session import stage_table

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
GROUP_ROWS = 4096
REFERENCES = np.array([xxhash.xxh64_intdigest(b"reference %d" % i, 0) for i in range(16)], np.uint64)


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of a text; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; null texts count as empty."""
    return docs.select(quoted(id_col).alias("id"), _fingerprints(whole_text(text_col)).alias("fp"))


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _link_batch(table: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links inside the groups (equal key and part) of one sorted batch."""
    fp = table["fp"].to_numpy(np.int64).view(np.uint64)
    keys = table[["combo", "key", "part"]].to_numpy(np.int64)
    new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
    group = np.cumsum(new)
    names, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(names))
    pivots = np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    side = table["side"].to_numpy(np.int8)
    edges: list[tuple[int, int]] = []
    at, step = np.arange(len(fp)), 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        other = at + step
        open_ = (root[node[at]] != root[node[other]]) & ((side[at] != side[other]) | (side[at] == 0))
        a, b = at[open_], other[open_]
        near = np.abs(pivots[a, :4] - pivots[b, :4]).max(axis=1, initial=0) <= MAX_BITS
        a, b = a[near], b[near]
        near = np.abs(pivots[a] - pivots[b]).max(axis=1, initial=0) <= MAX_BITS
        a, b = a[near], b[near]
        linked = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
        for x, y in zip(node[a[linked]].tolist(), node[b[linked]].tolist()):
            p, q = root[x], root[y]
            while p != root[p]:
                p = root[p]
            while q != root[q]:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((x, y))
        while (root != root[root]).any():
            root = root[root]
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    signed = names.view(np.int64)
    return pd.DataFrame({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]})


def _link_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs over sorted batches; the last group of a batch waits for the next one."""
    wait = None
    for batch in batches:
        table = batch if wait is None else pd.concat([wait, batch], ignore_index=True)
        keys = table[["combo", "key", "part"]].to_numpy(np.int64)
        last = (keys == keys[-1]).all(axis=1) if len(table) else np.zeros(0, bool)
        wait = table[last]
        yield _link_batch(table[~last])
    if wait is not None:
        yield _link_batch(wait)


def links(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b) linked distinct fingerprints, a spanning forest of every component. ``prints``: distinct ``fp``."""
    keys = []
    for n, kept in enumerate(combinations(BLOCKS, 3)):
        mask = sum(((1 << width) - 1) << low for low, width in kept)
        keys.append(F.struct(F.lit(n).alias("combo"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    rows = prints.select("fp", F.inline(F.array(*keys)))
    sizes = rows.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(sizes, ["combo", "key"])
    parts = F.ceil(F.col("n") / F.lit(group_rows)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    # A group in one part meets in (0, 0); otherwise part i meets part j in cell (min, max), as side 1 or 2,
    # and itself in cell (i, i), as side 0: all its members are compared.
    cells = F.transform(
        others,
        lambda o: F.struct(
            (F.least(o, F.col("mine")) * F.col("parts") + F.greatest(o, F.col("mine"))).alias("part"),
            F.when(o == F.col("mine"), 0).when(F.col("mine") < o, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = joined.withColumn("parts", parts).withColumn("mine", mine).select("combo", "key", "fp", F.inline(cells))
    dealt = dealt.repartition("combo", "key", "part").sortWithinPartitions("combo", "key", "part", "fp")
    return dealt.mapInPandas(_link_groups, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): the smallest id reachable over links, itself included.

    Null and empty texts have fingerprint zero and link like any other. Null ids never become a component's
    id unless there is no other; repeated rows fall into one component; an empty table gives no rows.
    """
    marked = stage_table(fingerprints(docs, id_col, text_col), "prints")
    return marked.join(_roots(marked), "fp").select(F.col("id").alias(id_col), hex_of("fp").alias("fingerprint"), F.col("least").alias("component_id"))


def _roots(marked: DataFrame) -> DataFrame:
    """(fp, root, least): component of every distinct fingerprint and its smallest id."""
    prints = stage_table(marked.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    found = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    placed = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return placed.join(least, "root").select("fp", "root", "least")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id (nulls last), then the smallest fingerprint.

    All columns of ``docs`` are returned. Fingerprints are made once, with the rows staged beside them.
    """
    fp, near = free_name(docs, "fp"), [quoted(c) for c in docs.columns]
    staged = stage_table(docs.select(*near, _fingerprints(whole_text(text_col)).alias(fp)), "prints")
    marked = staged.select(quoted(id_col).alias("id"), F.col(fp).alias("fp"))
    rows = marked.distinct().join(_roots(marked), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first")
    kept = rows.groupBy("root").agg(first).select(F.col("first.id").alias("kept_id"), F.col("first.fp").alias("kept_fp"))
    same = quoted(id_col).eqNullSafe(F.col("kept_id")) & (F.col(fp) == F.col("kept_fp"))
    return staged.join(kept, same, "left_semi").dropDuplicates([id_col, fp]).select(*near)
