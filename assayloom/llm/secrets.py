"""Secret scans over versioned texts with an incremental ledger of blobs.

Every version of a text is addressed by the sha256 of its bytes. A ledger under a shared folder holds the
findings of each (blob, rule version) pair that was ever scanned. A run scans only pairs that are not in the
ledger, appends them, and joins findings back to all paths (here: document ids) that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.rows import free_name, quoted, whole_text

# Kinds in the order in which equal starts are listed; the first three are the base rules.
KINDS = ("assign", "access", "hex", "key_block", "web_token", "git_token", "chat_token")
BASE = KINDS[:3]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Published shapes of further secrets.
FURTHER = {
    "key_block": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "git_token": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat_token": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
}
RULE_VERSION = "1"
MASK = "[secret]"
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings by start, then kind; code points, end exclusive."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]  # maximal runs, so the length may stand in the pattern
    for kind, rule in FURTHER.items():
        found += [(*m.span(), kind) for m in rule.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _scan_blobs(version: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for blob, text in zip(batch["blob"], batch["text"]):
                found = scan(text)
                base = [f for f in found if f[2] in BASE]
                rows.append((blob, version, *(sum(f[2] == k for f in found) for k in BASE), _joined(base), _joined(found)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return run


def read_ledger(spark, ledger: str) -> DataFrame:
    """Findings so far; a pair that two runs wrote counts once. Empty if nothing was written yet."""
    try:
        found = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    return found.dropDuplicates(["blob", "rule_version"])


def address(text: Column) -> Column:
    """Content address of a text: sha256 of its UTF-8 bytes in lower-case hex."""
    return F.sha2(text.cast("binary"), 256)


def unseen_blobs(versions: DataFrame, known: DataFrame, text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """(blob, text), one row for every blob not yet scanned under ``version``.

    Copies of a blob collapse inside each task and then over tasks before the ledger is asked, so a blob that
    many rows hold is sent once per task, and the ledger's join sees every blob once.
    """
    blobs = versions.select(whole_text(text_col).alias("text")).select(address(F.col("text")).alias("blob"), "text")
    single = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return single.join(known.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")


def update_ledger(versions: DataFrame, ledger: str, text_col: str = "text", version: str = RULE_VERSION) -> int:
    """Scans the unseen (blob, rule version) pairs and appends them to the ledger; number of pairs scanned."""
    spark = versions.sparkSession
    known = read_ledger(spark, ledger)
    before = known.where(F.col("rule_version") == version).count()
    unseen_blobs(versions, known, text_col, version).mapInPandas(_scan_blobs(version), LEDGER).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).where(F.col("rule_version") == version).count() - before


def findings(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """(id, blob, n_assign, n_access, n_hex, base_spans, spans) of every row of ``versions``, from the ledger.

    The ledger side has one row per blob, so copies of one blob may be split over tasks. Null and empty
    texts are the empty blob, without findings. Null ids and repeated rows are kept, extra columns not read.
    """
    known = read_ledger(versions.sparkSession, ledger).where(F.col("rule_version") == version).drop("rule_version")
    paths = versions.select(quoted(id_col).alias("id"), address(whole_text(text_col)).alias("blob"))
    return paths.join(known, "blob").select(F.col("id").alias(id_col), "blob", "n_assign", "n_access", "n_hex", "base_spans", "spans")


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, joined in zip(texts, spans):
        if joined:
            done, parts = 0, []
            for start, end in (map(int, s.split(":")[1:]) for s in joined.split(",")):
                if start >= done:
                    parts += [text[done:start], MASK]
                done = max(done, end)
            text = "".join(parts) + text[done:]
        out.append(text)
    return pd.Series(out, dtype=object)


def mask_secrets(docs: DataFrame, ledger: str, text_col: str = "text", version: str = RULE_VERSION, length_col: str | None = None) -> DataFrame:
    """``docs`` with every finding replaced by a mask; overlapping findings become one.

    All rows stay; ``length_col``, if given, is set to the length of the new text where that changed.
    """
    known = read_ledger(docs.sparkSession, ledger).where((F.col("rule_version") == version) & (F.col("spans") != ""))
    blob, spans = free_name(docs, "blob"), free_name(docs, "spans")
    known = known.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(blob, address(whole_text(text_col))).join(known, blob, "left")
    clean = F.when(F.col(spans).isNull(), quoted(text_col)).otherwise(_masked(whole_text(text_col), F.col(spans)))
    joined = joined.withColumn(text_col, clean)
    if length_col:
        joined = joined.withColumn(length_col, F.when(F.col(spans).isNull(), quoted(length_col)).otherwise(F.length(quoted(text_col))))
    return joined.select(*map(quoted, docs.columns))
