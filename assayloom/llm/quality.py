"""Quality rules: base counts, and the likelihood ratio of hashed n-grams of trusted and raw text.

Two multinomials over hashed word n-grams (n = 1, 2) are counted: one over all documents, one over trusted
documents. A document's score is the mean of log(p_trusted / p_raw) over its n-grams, so long and short
texts compare; documents under a fixed threshold are rejected. All counts cover every document, and the
trusted multinomial every trusted one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.rows import quoted, whole_text

BUCKETS = 8192
BIGRAM_FACTOR = 31
#: Mean log-likelihood ratio per n-gram, in nats, under which a document is rejected.
THRESHOLD = -0.25
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_grams long, score double, kept boolean"


class _WordCodes(dict):
    """word -> (bucket of its core + 1) + (bucket of its trailing punctuation + 1) * 2^20; 0 for an empty part."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        core = word.rstrip(PUNCTUATION)
        code = _bucket(core) + (_bucket(word[len(core):]) << 20)
        self[word] = code
        return code


def _bucket(token: bytes) -> int:
    return int(hashlib.md5(token).hexdigest()[:8], 16) % BUCKETS + 1 if token else 0


_CODES = _WordCodes()


def gram_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of all unigrams and bigrams; a word is its core followed by its trailing punctuation, if any."""
    codes = np.fromiter(map(_CODES.__getitem__, words), np.int64, len(words))
    tokens = np.column_stack((codes & 0xFFFFF, codes >> 20)).ravel()
    tokens = tokens[tokens > 0] - 1
    return np.concatenate((tokens, (tokens[:-1] * BIGRAM_FACTOR + tokens[1:]) % BUCKETS))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered[i:i + WINDOW] = True
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    lines = [line for line in text.encode().split(b"\n") if line.strip(SPACES.encode())]
    n, repeats = len(words), repeated_words(words)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n,
    )


def gram_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, trusted) counts over all documents; ``trusted`` has the ids (column ``id``) of trusted ones.

    Two passes: all texts, where they lie; and the texts with a trusted id, which meet the ids in a merge join at
    every size, as both sides grow with the input. Each task sends one row per bucket at most.
    """
    texts = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                totals += np.bincount(gram_buckets(text.encode().split()), minlength=BUCKETS)
        used = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": used, "n": totals[used]})

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))

    raw, good = counted(texts, "raw"), counted(texts.join(trusted.where("id IS NOT NULL").hint("merge"), "id", "left_semi"), "trusted")
    return raw.join(good, "bucket", "left").select("bucket", "raw", F.coalesce("trusted", F.lit(0).cast("long")).alias("trusted"))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio per bucket, add-one smoothed; all zero without any trusted text."""
    counts = np.zeros((2, BUCKETS))
    for row in gram_counts(docs, trusted, id_col, text_col).collect():  # at most BUCKETS rows
        counts[:, row.bucket] = row.raw, row.trusted
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    raw, target = (np.log(c + 1) - np.log(c.sum() + BUCKETS) for c in counts)
    return target - raw


def verdict(weights: np.ndarray, text: Column, threshold: float = THRESHOLD) -> Column:
    """Struct of base counts, score and ``kept`` for a text column (null: no words)."""

    @F.pandas_udf(VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = text.encode().split()
            base = base_counts(text, words)
            grams = gram_buckets(words)
            score = float(weights[grams].sum()) / len(grams) if len(grams) else 0.0
            rows.append((*base, len(grams), score, not base[-1] and score >= threshold))
        names = [part.split()[0] for part in VERDICT.split(", ")]
        return pd.DataFrame(rows, columns=names)

    return judge.asNondeterministic()(F.coalesce(text.cast("string"), F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base counts, n_grams, score, kept) of every row of ``docs``.

    Null and empty texts have no words: all counts 0, base failed, not kept. Repeated rows are each scored
    and counted. Null ids are kept and never trusted. An empty ``labels`` gives score 0 to all. Further
    columns of ``docs``, whatever their names, are not read.
    """
    weights = _weights(docs, labels, id_col, text_col, label_col)
    judged = docs.select(quoted(id_col).alias("id"), verdict(weights, quoted(text_col), threshold).alias("v"))
    return judged.select(F.col("id").alias(id_col), "v.*")


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    weights = _weights(docs, labels, id_col, text_col, label_col)
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), verdict(weights, quoted(text_col), threshold).alias("v"))
    return whole.where("v.kept").select("row.*")


def _weights(docs, labels, id_col, text_col, label_col) -> np.ndarray:
    trusted = labels.where(quoted(label_col) == 1).select(quoted(id_col).alias("id"))
    return fit(docs, trusted, id_col, text_col)
