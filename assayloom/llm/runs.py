"""Periodic runs of words inside a document, by seeds on diagonals.

A run is a maximal stretch of words in which words ``q`` apart are identical, ``q`` being its smallest period,
of at least ``max(24, 3 * q)`` words. Two words of a document that are ``q`` apart lie on diagonal ``q``; a run
is an unbroken piece of its diagonal.

Lags are split into tiers: 1 to 16, 17 to 32, 33 to 64, and so on. In every tier the k-grams of the overlap
that each of its runs is sure to have with itself (16, 32, 64, ... words) are indexed. A k-gram is as long as the
longest period of its tier, so inside a run it returns first after exactly one period: the occurrence pairs to
look at are the neighbours in the sorted index, and there are fewer of them than words. A pair is a seed that is
extended both ways along its diagonal; the furthest place covered so far on that diagonal suppresses all further
seeds of the same run. The work is thus within words times the logarithm of the text's length, also for texts
that are one word over and over, and nothing leaves the row's task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.rows import quoted, whole_text

LEAST_WORDS, LEAST_EXPONENT = 24, 3
#: Words that a run of period 1 to 16 shares with itself, moved by its period: 24 - 8 at least.
SEED = 16


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs: the names of grams from the names of their two halves."""
    return np.unique(left.astype(np.int64) * (int(right.max()) + 1) + right, return_inverse=True)[1]


def may_repeat(codes: np.ndarray) -> bool:
    """Whether some gram of ``SEED`` words may occur twice; a false answer is certain."""
    h = codes.astype(np.uint64)
    width = 1
    while width < SEED:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[width:] + (h[width:] >> np.uint64(29)))
        width *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _reach(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far ``codes[i] == codes[i + lag]`` holds from ``at``, going up (step 1) or down (step -1)."""
    here, width, n = at, 64, len(codes)
    while True:
        if step > 0:
            stop = min(n - lag, here + width)
            differ = np.flatnonzero(codes[here:stop] != codes[here + lag:stop + lag])
            if len(differ):
                return here + int(differ[0])
            if stop == n - lag:
                return stop
        else:
            stop = max(0, here - width)
            differ = np.flatnonzero(codes[stop:here] != codes[stop + lag:here + lag])
            if len(differ):
                return stop + int(differ[-1]) + 1
            if stop == 0:
                return 0
        here, width = stop, 2 * width


def periodic_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start and period."""
    n, found = len(codes), []
    if n < LEAST_WORDS or not may_repeat(codes):
        return found
    names, width = codes.astype(np.int64), 1
    while width < SEED:
        names = _names(names[:-width], names[width:])
        width *= 2
    while True:
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        first, lags = order[:-1][same], np.diff(order)[same]
        if not len(lags):
            return sorted(found)
        low = 1 if width == SEED else width // 2 + 1
        fits = (lags >= low) & (lags <= width)
        first, lags = first[fits], lags[fits]
        by_lag = np.lexsort((first, lags))
        first, lags = first[by_lag], lags[by_lag]
        # Seeds next to each other on a diagonal are of one run: only the first of them is looked at.
        heads = np.ones(len(first), bool)
        heads[1:] = (lags[1:] != lags[:-1]) | (first[1:] != first[:-1] + 1)
        covered: dict[int, int] = {}
        for at, lag in zip(first[heads].tolist(), lags[heads].tolist()):
            if at < covered.get(lag, 0):
                continue
            end, start = _reach(codes, at, lag, 1), _reach(codes, at, lag, -1)
            covered[lag] = end
            if end + lag - start >= max(LEAST_WORDS, LEAST_EXPONENT * lag):
                found.append((start, end + lag - start, lag))
        if LEAST_EXPONENT * (width + 1) > n:
            return sorted(found)
        names = _names(names[:-width], names[width:])
        width *= 2


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for every word that some run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def text_runs(text: bytes) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    words = text.split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return words, periodic_runs(codes)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by spaces."""
    if not runs:
        return b" ".join(words)
    gone = dropped_words(len(words), runs)
    return b" ".join([w for w, out in zip(words, gone.tolist()) if not out])


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of ``docs``; words are ``[^\\x20\\x09-\\x0D]+``.

    ``runs`` lists (start, length, period) by start, then period; ``collapsed`` is the text without the words that
    a run repeats, its words joined by one space, or ``digest`` of that text's UTF-8. Null and empty texts have no
    words and no runs. Null ids and repeated rows are kept, each on its own; an empty table gives no rows; texts
    are read whole, whatever their length, one at a time; extra columns are not read.
    """
    kind = T.StringType() if digest is None else T.BinaryType()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", kind)])
    fields = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, lists, texts = [], [], []
                for text in part.column(1).cast(pa.binary()):
                    words, found = text_runs(text.as_py())
                    counts.append(len(words))
                    lists.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append((digest or bytes)(collapse(words, found)))
                out = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(fields)), out.cast(pa.string()) if digest is None else out],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
    return rows.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def strongest_run(runs: str = "runs"):
    """The run with the greatest exact length / period; ties: smallest start, then smallest period."""
    better = "(best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best)"
    return F.expr(f"aggregate({runs}, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), {better})")
