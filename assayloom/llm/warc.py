"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer makes text rows, one record each, and lets Spark write them, so it works on every store that
Spark reaches. The reader walks a file record by record. When a record fails its checks (version line,
headers, length, digest) or a gzip member does not inflate, it searches for the next version line or member
that reads well, goes on from there, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.rows import quoted, whole_text
from assayloom.session import stage_table

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Every record bears this date, so that archives made again are equal byte by byte.
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 0
DIGESTS = ("sha1", "sha256", "sha512", "md5")
FILE_RECORDS = 2_000
RECORDS = (
    "file string, at long, end long, kind string, page_id string, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a binary column in base 32, 32 characters without padding."""
    digest = F.sha1(data)
    # 40 hex digits are eight groups of 20 bits, each of which is four base-32 digits.
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    letters = [
        F.substring(F.lit(_BASE32), F.shiftright(group, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        for group in groups for k in range(4)
    ]
    return F.concat(*letters)


def decide(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` as (id, digest, refers_to): refers_to is null for responses.

    Among equal payloads of at least ``least_bytes`` bytes the rows with the largest id are responses. Only
    ids and digests are shuffled.
    """
    body = whole_text(html_col).cast("binary")
    facts = pages.select(quoted(id_col).alias("id"), base32_sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    last = facts.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("id").alias("last"))
    other = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return facts.join(last, "digest", "left").select("id", "digest", F.when(other, F.col("last")).alias("refers_to"))


def _line(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One text per row of ``pages``: a whole WARC record but for its last line end.

    Null html is the empty payload, a null url an empty one; rows with a null id get no id header. Rows that
    repeat an id and a payload are written each; those with the largest id are all responses. The revisits are
    staged, so Spark knows their size when it plans the join: a small table is broadcast and no html moves, a
    large one is joined by a shuffle.
    """
    others = decide(pages, id_col, html_col, least_bytes).where(F.col("refers_to").isNotNull()).select("id", "digest", "refers_to").distinct()
    others = stage_table(others, "revisits")
    body = whole_text(html_col)
    rows = pages.select(
        quoted(id_col).alias("id"), _line(whole_text(url_col)).alias("url"), body.alias("body"), base32_sha1(body.cast("binary")).alias("digest")
    )
    rows = rows.withColumnRenamed("id", "page").withColumnRenamed("digest", "hash")
    same = F.col("page").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("digest"))
    joined = rows.join(others, same, "left")
    revisit, end = F.col("refers_to").isNotNull(), F.lit("\r\n")
    block = F.when(revisit, "").otherwise(F.col("body"))
    head = F.concat(
        F.lit(VERSION), end,
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), end,
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page").cast("string"), F.lit(">"), end), F.lit("")),
        F.lit("WARC-Date: " + DATE), end,
        F.lit("WARC-Target-URI: "), F.col("url"), end,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("hash"), end,
        F.lit("WARC-Payload-Length: "), F.octet_length("body").cast("string"), end,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"), end, F.lit("WARC-Profile: " + PROFILE), end)).otherwise(""),
        F.lit("Content-Type: text/html"), end,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), end, end,
    )
    return joined.select(F.concat(head, block, end).alias("value"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> str:
    """Writes the archives under ``path``, at most ``FILE_RECORDS`` records a file, so a reader can hold one."""
    records(pages, id_col, url_col, html_col, least_bytes).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", "\r\n").option("compression", "none").text(path)
    return path


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Inflated content of the gzip member at ``at`` and its end; None if it is damaged.

    Pieces grow from 4 KB, so what is read behind a member's end is no longer than the member, however many
    members the file has.
    """
    inflate, view, here, size, content = zlib.decompressobj(31), memoryview(data), at, 4096, []
    try:
        while not inflate.eof and here < len(data):
            piece = view[here:here + size]
            content.append(inflate.decompress(piece))
            here, size = here + len(piece), 2 * size
    except zlib.error:
        return None
    return (b"".join(content), here - len(inflate.unused_data)) if inflate.eof else None


def _agrees(digest: str, content: bytes) -> bool:
    """Whether a digest, "algorithm:value" in base 32 or hex, is that of the content; true if it is of no known kind."""
    kind, _, value = digest.rpartition(":")
    kind = kind.lower().replace("-", "") or "sha1"
    if kind not in DIGESTS:
        return True
    own = hashlib.new(kind, content).digest()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    wanted = base64.b32encode(own).decode().rstrip("=")
    return len(value.rstrip("=")) != len(wanted) or value.rstrip("=").upper() == wanted


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the record at ``at``; None if any check fails."""
    stop = data.find(b"\r\n\r\n", at)
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at) or stop < 0:
        return None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit():
        return None
    start, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = payload = data[start:end]
    if fields.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if not _agrees(fields.get("warc-block-digest", ""), block):
        return None
    # The payload of a revisit or of a part of a record is not in the block.
    if fields.get("warc-type") != "revisit" and "warc-segment-number" not in fields and not _agrees(fields.get("warc-payload-digest", ""), payload):
        return None
    return fields, block, end + 4


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record" or "gap", start, end, headers, block) over a whole file; starts and ends are file bytes."""
    at, bad = 0, None
    signs = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
    while at < len(data):
        if data[at:at + 3] == b"\x1f\x8b\x08":
            member = _member(data, at)
            inside = member and parse_record(member[0])
            found = (*inside[:2], member[1]) if inside and inside[2] == len(member[0]) else None
        else:
            found = parse_record(data, at)
        if found:
            if bad is not None:
                yield "gap", bad, at, {}, b""
                bad = None
            yield "record", at, found[2], found[0], found[1]
            at = found[2]
        else:
            bad = at if bad is None else bad
            sign = signs.search(data, at + 1)
            at = sign.start() if sign else len(data)
    if bad is not None:
        yield "gap", bad, len(data), {}, b""


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files under ``path`` (columns as in ``RECORDS``; kind is record or gap).

    Files are read whole, one at a time in a task; the writer bounds their records. A revisit has no
    payload of its own. Gaps bear their byte range alone. ``payloads=False`` leaves that column null.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = []
                for kind, start, end, fields, block in salvage(data):
                    if kind == "gap":
                        rows.append((file, start, end, kind, *[None] * 7))
                        continue
                    name = lambda key: fields.get(key, "").removeprefix("<urn:page:").removesuffix(">") or None
                    size = fields.get("warc-payload-length", "")
                    rows.append((
                        file, start, end, kind, name("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-type"),
                        int(size) if size.isdigit() else len(block), fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                        name("warc-refers-to"), block if payloads and fields.get("warc-type") != "revisit" else None,
                    ))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, RECORDS)
