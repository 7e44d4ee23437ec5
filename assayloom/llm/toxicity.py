"""Toxicity scores from a factorization machine over hashed terms.

Terms are a document's distinct words and their first characters, hashed to 30 bits. Terms that go with the
label are selected by a likelihood-ratio test over the labelled documents, counted in Spark; the machine
then learns a weight and a short vector for each. Its score adds the weights of the terms present and the
products of the vectors of all pairs of them, so a term can matter only beside another one.

The machine is fitted on at most about ``TRAIN_ROWS`` labelled documents; scoring covers all documents.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.rows import bounded_ids, quoted, whole_text

HASH_BITS, PREFIXES = 30, (4, 5)
TRAIN_ROWS = 30_000
#: Likelihood-ratio statistic and number of documents from which a term is selected.
LEAST_G2, LEAST_DOCUMENTS = 20.0, 3
RANK, STEPS, RATE, DECAY, SEED = 8, 300, 0.1, 1e-5, 11


def word_terms(word: str) -> list[int]:
    """Hashed terms of a lower-case word: itself without outer punctuation, and its first characters."""
    core = word.strip(string.punctuation)
    if not core:
        return []
    names = ["w " + core] + [f"p{n} {core[:n]}" for n in PREFIXES if len(core) > n]
    return [zlib.crc32(n.encode()) & ((1 << HASH_BITS) - 1) for n in names]


def words(text: str) -> set[str]:
    return set(text.lower().split())


def document_terms(text: str) -> np.ndarray:
    return np.unique(np.array([t for w in words(text) for t in word_terms(w)], np.int64))


@dataclass
class Machine:
    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        lengths = np.array([len(r) for r in rows], np.int64)
        row, term = np.repeat(np.arange(len(rows)), lengths), np.array([t for r in rows for t in r], np.int64)
        return self.bias + _interactions(row, term, len(rows), self.weights, self.vectors)[0]


def _interactions(row, term, n, weights, vectors):
    linear = np.bincount(row, weights=weights[term], minlength=n)
    picked = vectors[term]
    total = np.column_stack([np.bincount(row, weights=picked[:, f], minlength=n) for f in range(vectors.shape[1])])
    squares = np.bincount(row, weights=(picked * picked).sum(axis=1), minlength=n)
    return linear + 0.5 * ((total * total).sum(axis=1) - squares), total


def train(rows: list[list[int]], labels: np.ndarray, n_terms: int, rank: int = RANK, steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by Adam on the logistic loss over all rows, with weight decay."""
    draw = np.random.default_rng(SEED)
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6) if len(labels) else 0.5
    values = [np.array([np.log(share / (1 - share))]), np.zeros(n_terms), draw.normal(0, 0.01, (n_terms, rank)).T.copy()]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    for step in range(1, steps + 1 if len(rows) and n_terms else 1):
        bias, weights, vectors = values
        total = np.stack([np.bincount(row, weights=v[term], minlength=len(rows)) for v in vectors])
        own = np.bincount(row, weights=(weights - 0.5 * (vectors * vectors).sum(axis=0))[term], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(own + 0.5 * (total * total).sum(axis=0) + bias[0], -30, 30))) - labels
        linear = np.bincount(term, weights=error[row], minlength=n_terms)
        slope = np.stack([np.bincount(term, weights=(error * t)[row], minlength=n_terms) for t in total]) - vectors * linear
        for i, (value, change) in enumerate(zip(values, [np.array([error.sum()]), linear, slope])):
            change = change / len(rows) + (DECAY * value if i else 0)
            first[i] = 0.9 * first[i] + 0.1 * change
            second[i] = 0.999 * second[i] + 0.001 * change * change
            values[i] = value - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    return float(values[0][0]), values[1], np.ascontiguousarray(values[2].T)


def _g2(n: Column, toxic: Column, rows: int, positives: int) -> Column:
    """Likelihood-ratio statistic of a term's presence against the label."""
    cells = [
        (toxic, n * positives / rows), (n - toxic, n * (rows - positives) / rows),
        (positives - toxic, (rows - n) * positives / rows), (rows - n - positives + toxic, (rows - n) * (rows - positives) / rows),
    ]
    parts = [F.when((seen > 0) & (wanted > 0), seen * F.log(seen / wanted)).otherwise(0.0) for seen, wanted in cells]
    return 2 * sum(parts[1:], parts[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Machine:
    """Fits on rows of ``docs`` with a label of 0 or 1 in ``labels``, at most about ``most`` of them.

    The label table is cut to its bound first, so it may be broadcast and no text is shuffled. An id with
    several labels takes the largest. Without rows of both labels the score is one constant.
    """
    known = labels.where(quoted(label_col).isin(0, 1))
    chosen = bounded_ids(known, id_col, most, "toxicity")
    marks = known.groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col)).alias("label")).join(chosen, "id")
    rows = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(marks), "id").select("label", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                found = [document_terms(t) for t in part["text"]]
                terms, place = np.unique(np.concatenate(found), return_inverse=True)
                toxic = np.repeat(part["label"].to_numpy(np.float64), [len(f) for f in found])
                yield pd.DataFrame({"term": terms, "n": np.bincount(place, minlength=len(terms)), "toxic": np.bincount(place, weights=toxic, minlength=len(terms)).astype(np.int64)})

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    n, positives = int(totals.n), int(totals.toxic)
    if not positives or positives == n:
        return Machine({}, 0.0 if not n else (8.0 if positives else -8.0), np.zeros(0), np.zeros((0, RANK)))
    counts = rows.select("text", "label").mapInPandas(count, "term long, n long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_DOCUMENTS)
    chosen_terms = counts.where(_g2(F.col("n"), F.col("toxic"), n, positives) >= LEAST_G2).select("term").collect()
    terms = {t: i for i, t in enumerate(sorted(r.term for r in chosen_terms))}

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"].astype("int32"), "terms": [_active(t, terms) for t in batch["text"]]})

    sample = rows.mapInPandas(active, "label int, terms array<int>").collect()  # bounded by ``most``
    sample.sort(key=lambda r: (r.label, r.terms))  # the order of tasks does not matter
    return Machine(terms, *train([r.terms for r in sample], np.array([r.label for r in sample], float), len(terms)))


_MEMO: dict[str, tuple[int, ...]] = {}
_MEMO_OF: list[dict[int, int]] = []


def _active(text: str, terms: dict[int, int]) -> list[int]:
    """Sorted numbers of the selected terms of a text. Words are looked up once per worker and model."""
    if not _MEMO_OF or _MEMO_OF[0] is not terms or len(_MEMO) > 400_000:
        _MEMO.clear()
        _MEMO_OF[:] = [terms]
    found: set[int] = set()
    for word in words(text):
        hit = _MEMO.get(word)
        if hit is None:
            hit = _MEMO[word] = tuple(terms[t] for t in word_terms(word) if t in terms)
        if hit:
            found.update(hit)
    return sorted(found)


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    Null and empty texts have no terms and get the score of the bias alone. Null ids and repeated rows are
    scored like others, extra columns not read, an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        logits = machine.logits([_active(t, machine.terms) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    scored = docs.select(quoted(id_col).alias(id_col), score.asNondeterministic()(whole_text(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
