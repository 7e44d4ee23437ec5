"""Hashed fingerprints and Tanimoto similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.session import stage_table

# Fixed value: width of a fingerprint.
N_BITS = 2048
#: Queries that are sent to every task at most (8 KB each or less), and rows of a block of a comparison.
MOST_ASKED, BLOCK = 4096, 512
#: Of the prefix index: library rows of a part, meetings that a task unfolds at once, and pairs compared at once.
PART_ROWS, MOST_MET, CHECKED = 4096, 1_000_000, 32_768


def tokens(text: Column, ngram: int = 1) -> Column:
    """Distinct lower-case word n-grams of a text."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    if ngram == 1:
        return F.array_distinct(words)

    def grams(w):
        starts = F.when(F.size(w) >= ngram, F.sequence(F.lit(1), F.size(w) - (ngram - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, ngram), " "))

    # the outer array binds the words, so that the text is split once and not once per n-gram
    return F.array_distinct(F.get(F.transform(F.array(words), grams), F.lit(0)))


def bit_of(token: Column, n_bits: int = N_BITS, method: str = "xxhash64") -> Column:
    """Bit of a token: xxhash64 by default, md5 where other engines must agree."""
    if method == "md5":
        return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % n_bits).cast("int")
    return F.pmod(F.xxhash64(token), F.lit(n_bits)).cast("int")


def hashed_fingerprint(text: Column, n_bits: int = N_BITS, ngram: int = 1, method: str = "xxhash64") -> Column:
    """Sorted array of the set bits of a text."""
    return F.array_sort(F.array_distinct(F.transform(tokens(text, ngram), lambda t: bit_of(t, n_bits, method))))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits of two bit arrays; 0 when a side is null or both are empty."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(union, F.lit(0))), F.lit(0.0))


def packed(bits: Column, n_bits: int = N_BITS) -> Column:
    """Bit array as n_bits / 64 longs."""
    words = F.sequence(F.lit(0), F.lit((n_bits - 1) // 64))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(one(b))))


def shared_bits(a: Column, b: Column) -> Column:
    """Common bits of two packed arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)


def tanimoto_search(
    library: DataFrame, queries: DataFrame, key: str, query_key: str, bits: str, min_sim: float, n_bits: int = N_BITS,
    route: str | None = None,
) -> DataFrame:
    """(query, key, similarity) for library rows at or above ``min_sim``, exact; ``min_sim`` must be positive.

    Up to MOST_ASKED queries are sent to every task, and the library streams past them without a shuffle
    (``route="blocks"``); more queries meet the library in a prefix index (``route="index"``). Both are exact.
    Null and empty sets match nothing.
    """
    if min_sim <= 0:
        raise ValueError("min_sim must be positive")
    asked, rows = queries.select(query_key, bits), library.select(key, bits)
    route = route or ("blocks" if queries.select(query_key).limit(MOST_ASKED + 1).count() <= MOST_ASKED else "index")
    search = _by_blocks if route == "blocks" else _by_index
    return search(rows, asked, key, query_key, bits, min_sim, n_bits)


def _bit_matrix(column: pa.ListArray, n_bits: int) -> np.ndarray:
    out = np.zeros((len(column), n_bits), np.float32)
    sizes = np.diff(column.offsets.to_numpy())
    first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
    out[np.repeat(np.arange(len(column)), sizes), column.values.to_numpy()[first:last]] = 1
    return out


def _by_blocks(library: DataFrame, asked: DataFrame, key: str, query_key: str, bits: str, min_sim: float, n_bits: int) -> DataFrame:
    """Every library row against all queries, which are few, by products of 0/1 matrices in blocks."""
    rows = asked.toArrow().combine_chunks()  # at most MOST_ASKED rows
    sent = asked.sparkSession.sparkContext.broadcast((rows.column(0).combine_chunks(), rows.column(1).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = sent.value
        blocks = [(at, _bit_matrix(lists.slice(at, BLOCK), n_bits)) for at in range(0, len(lists), BLOCK)]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                mine = _bit_matrix(piece.column(1), n_bits)
                for at, other in blocks:
                    common = (mine @ other.T).astype(np.float64)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        similar = common / (mine.sum(axis=1, dtype=np.float64)[:, None] + other.sum(axis=1, dtype=np.float64) - common)
                    i, j = np.nonzero((similar >= min_sim - 1e-12) & (common > 0))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j + at)), piece.column(0).take(pa.array(i)), pa.array(similar[i, j])], names=["q", "k", "s"])

    schema = T.StructType([T.StructField(query_key, asked.schema[query_key].dataType), T.StructField(key, library.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    return library.mapInArrow(run, schema)


def _prefixes(lists: pa.ListArray, rank: np.ndarray, min_sim: float) -> tuple[np.ndarray, ...]:
    """Sizes of the sets; then row, rank and place of the prefix bits, rarest bits of a set first."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ranks = rank[lists.values.to_numpy()[offsets[0] : offsets[-1]]]
    ranks = ranks[np.lexsort((ranks, row))]
    place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    inside = place < np.repeat(sizes - np.ceil(sizes * min_sim - 1e-9) + 1, sizes)
    return sizes, row[inside], ranks[inside], place[inside]


def _words(lists: pa.ListArray, n_bits: int) -> np.ndarray:
    """The sets as rows of 64-bit words."""
    width = -(-n_bits // 64) * 64
    parts = [np.packbits(_bit_matrix(lists.slice(at, BLOCK), width).astype(np.uint8), axis=1) for at in range(0, len(lists), BLOCK)]
    return np.ascontiguousarray(np.concatenate(parts)).view(np.uint64)


def _met(mine: pa.ListArray, other: pa.ListArray, rank: np.ndarray, min_sim: float, n_bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(places in ``mine``, places in ``other``, similarity) of the pairs that reach ``min_sim``, in bounded pieces."""
    n, row, ranks, place = _prefixes(mine, rank, min_sim)
    m, asked, by_rank, spot = _prefixes(other, rank, min_sim)
    order = np.argsort(by_rank, kind="stable")
    starts = np.searchsorted(by_rank[order], np.arange(len(rank) + 1))
    many = starts[ranks + 1] - starts[ranks]
    words, asked_words = _words(mine, n_bits), _words(other, n_bits)
    edges = np.searchsorted(row, np.arange(len(n) + 1))
    reached = np.append(0, np.cumsum(many))[edges]
    top = 0
    while top < len(n):
        low, most_rows = top, max(1, MOST_MET // len(m))
        top = min(len(n), low + most_rows, max(low + 1, int(np.searchsorted(reached, reached[low] + MOST_MET, "right")) - 1))
        entry = np.repeat(np.arange(edges[low], edges[top]), many[edges[low] : edges[top]])
        step = np.arange(len(entry)) - (np.append(0, np.cumsum(many))[entry] - reached[low])
        post = order[starts[ranks[entry]] + step]
        # Entries go from rare to frequent bits, so of a pair's meetings the first is written last.
        first = np.full((top - low) * len(m), -1)
        first[((row[entry] - low) * len(m) + asked[post])[::-1]] = np.arange(len(entry))[::-1]
        hit = first[first >= 0]
        i, j, at, to = row[entry[hit]], asked[post[hit]], place[entry[hit]], spot[post[hit]]
        may = np.flatnonzero(np.minimum(n[i] - at, m[j] - to) >= min_sim / (1 + min_sim) * (n[i] + m[j]) - 1e-9)
        for some in np.array_split(may, -(-len(may) // CHECKED)) if len(may) else []:
            a, b = i[some], j[some]
            common = np.bitwise_count(words[a] & asked_words[b]).sum(axis=1, dtype=np.int64)
            similar = common / (n[a] + m[b] - common)
            found = similar >= min_sim - 1e-12
            yield a[found], b[found], similar[found]


def candidates(library: DataFrame, asked: DataFrame, bits: str, min_sim: float, n_bits: int) -> DataFrame:
    """(left columns..., right columns..., similarity) of every pair that reaches ``min_sim``, each pair once.

    With the rarest bits first, two sets that reach it share one of the first n - ceil(min_sim * n) + 1 bits. Parts of
    the library meet the prefix index of at most MOST_ASKED queries or so at a time. A pair is looked at once, at its
    first common prefix bit, and only if the bits behind that place in both sets can still reach the threshold; the
    whole sets are compared last. Only what reaches it leaves the task.
    """
    # one count per bit: at most n_bits numbers on the driver
    uses = np.zeros(n_bits, np.int64)
    for r in library.select(F.explode(bits).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        uses[r.b] = r.n
    rank = np.empty(n_bits, np.int64)
    rank[np.argsort(uses, kind="stable")] = np.arange(n_bits)
    parts, chunks = max(1, -(-library.count() // PART_ROWS)), max(1, -(-asked.count() // MOST_ASKED))
    left, right = [c for c in library.columns if c != bits], [c for c in asked.columns if c != bits]
    fields = [library.schema[c] for c in left] + [asked.schema[c] for c in right]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("similarity", T.DoubleType())])
    spread = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int"))
    every = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    mine = every(spread(library, parts, "_part"), chunks, "_chunk").groupBy("_part", "_chunk")
    # under another name, as both sides may be read from one table
    renamed = asked.withColumn("_bits", F.transform(bits, lambda b: b)).drop(bits)
    theirs = every(spread(renamed, chunks, "_chunk"), parts, "_part").groupBy("_part", "_chunk")

    def meet(own: pa.Table, other: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        pieces = [none]
        if own.num_rows and other.num_rows:
            pieces += _met(own[bits].combine_chunks(), other["_bits"].combine_chunks(), rank, min_sim, n_bits)
        i, j, similar = (pa.array(np.concatenate(p)) for p in zip(*pieces))
        columns = [own[c].take(i) for c in left] + [other[c].take(j) for c in right]
        return pa.table([*columns, similar], names=[*left, *right, "similarity"])

    return mine.cogroup(theirs).applyInArrow(meet, schema)


def _by_index(library: DataFrame, asked: DataFrame, key: str, query_key: str, bits: str, min_sim: float, n_bits: int) -> DataFrame:
    # written once, as each table is read several times; a fingerprint is not made again
    asked = stage_table(asked.where(F.size(bits) > 0).withColumnRenamed(query_key, "_q"), "asked")
    # copies share one fingerprint row, so a large group of copies is looked at once and unfolded last
    name = F.sha2(F.array_join(F.transform(F.col(bits), lambda b: b.cast("string")), ","), 256)
    named = stage_table(library.where(F.size(bits) > 0).select(F.col(key).alias("_key"), name.alias("_k"), bits), "library")
    prints = stage_table(named.groupBy("_k").agg(F.any_value(bits).alias(bits)), "prints")
    pairs = candidates(prints, asked, bits, min_sim, n_bits)
    return pairs.join(named.select("_key", "_k"), "_k").select(F.col("_q").alias(query_key), F.col("_key").alias(key), "similarity")


def tanimoto_pairs(pairs: DataFrame, rows: DataFrame, key: str, bits: str, left: str, right: str) -> DataFrame:
    """Similarity of stated pairs; a key without a fingerprint gives 0."""
    a = rows.select(F.col(key).alias(left), F.col(bits).alias("_a"))
    b = rows.select(F.col(key).alias(right), F.col(bits).alias("_b"))
    joined = pairs.join(a, left, "left").join(b, right, "left")
    return joined.withColumn("similarity", tanimoto(F.col("_a"), F.col("_b"))).drop("_a", "_b")
