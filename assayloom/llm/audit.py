"""How five filters interact: failures of every document, and what each order of the filters removes.

Four conditions are read from the document's own text. The fifth, a text that a smaller id has as well, needs the
whole table. It is found with radix tries: every task names its distinct texts, with the smallest id of each, and
proposes prefixes at which sorted texts part (as long as they must be, so texts with a common head are parted
behind it). A bounded number of those prefixes cuts the texts into ranges. Each range is one compressed trie of
full texts that holds the smallest id at its terminals; walking it again tells every task which of its texts have
a smaller id elsewhere. Copies of one text travel once per task, whatever their number.

Failures are a mask of five bits. Masks are counted per part, and all orders are read from those counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.rows import quoted, whole_text
from assayloom.session import stage_table

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
MARKS = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
#: Text bytes that a task names together, that one trie holds, and between two proposed cuts.
GROUP_BYTES, TRIE_BYTES, CUT_BYTES = 32 << 20, 32 << 20, 2 << 20
#: Most ranges, and most proposals of cuts that the driver looks at.
MOST_RANGES, MOST_CUTS = 1 << 18, 1 << 20
_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """Mask of the conditions A to D of a text in UTF-8."""
    words = text.split()
    mask = len(words) < MIN_WORDS
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITAL_PERCENT * len(text.translate(None, _CONTINUED))) << 2
    return mask | (len(text.translate(None, MARKS)) < len(text)) << 3


def common_length(a: bytes, a_at: int, b: bytes, b_at: int) -> int:
    """Length of the common prefix of ``a[a_at:]`` and ``b[b_at:]``."""
    low, high = 0, min(len(a) - a_at, len(b) - b_at)
    while low < high:
        half = (low + high + 1) // 2
        if a[a_at + low:a_at + half] == b[b_at + low:b_at + half]:
            low = half
        else:
            high = half - 1
    return low


class Trie:
    """Compressed trie of byte strings; ``low`` is the smallest number given for the string that ends here."""

    __slots__ = ("label", "next", "low")

    def __init__(self, label: bytes = b""):
        self.label, self.next, self.low = label, {}, None

    def insert(self, text: bytes, low: int) -> Trie:
        """Terminal of ``text``, which has ``low`` or a smaller number now."""
        node, at = self, 0
        while at < len(text):
            child = node.next.get(text[at])
            if child is None:
                child = node.next[text[at]] = Trie(text[at:])
            elif not text.startswith(child.label, at):
                same = common_length(child.label, 0, text, at)
                upper = node.next[text[at]] = Trie(child.label[:same])
                child.label = child.label[same:]
                upper.next[child.label[0]] = child
                child = upper
            node, at = child, at + len(child.label)
        if node.low is None or low < node.low:
            node.low = low
        return node


def proposed_cuts(texts: list[bytes]) -> list[bytes]:
    """Shortest prefixes that part neighbours of the sorted texts, about one in CUT_BYTES."""
    cuts, size, before = [], 0, None
    for text in sorted(texts):
        if before is not None and size >= CUT_BYTES:
            cuts.append(text[:common_length(before, 0, text, 0) + 1])
            size = 0
        size, before = size + len(text), text
    return cuts


_NAMED = [("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("grp", pa.int64()), ("k", pa.int32()), ("low", pa.int64()), ("text", pa.binary()), ("cut", pa.binary())]
NAMED = "id long, part string, mask int, grp long, k int, low long, text binary, cut binary"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its mask and the number of its text in the group; per distinct text the text; and cuts."""
    part_id, turn = TaskContext.get().partitionId(), 0
    names: dict[bytes, int] = {}
    masks: list[int] = []
    lows: list[int | None] = []
    rows: list[tuple[int | None, str, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        grp = (part_id << 32) + turn
        cuts = proposed_cuts(list(names))
        some = [(t, k) for t, k in names.items() if lows[k] is not None]
        n, m, c = len(rows), len(some), len(cuts)
        columns = [
            [r[0] for r in rows] + [None] * (m + c),
            [r[1] for r in rows] + [None] * (m + c),
            [masks[r[2]] for r in rows] + [None] * (m + c),
            [grp] * (n + m) + [None] * c,
            [r[2] for r in rows] + [k for _, k in some] + [None] * c,
            [lows[r[2]] for r in rows] + [lows[k] for _, k in some] + [None] * c,
            [None] * n + [t for t, _ in some] + [None] * c,
            [None] * (n + m) + cuts,
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(columns, _NAMED)], names=[name for name, _ in _NAMED])

    for batch in batches:
        for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            text = text.as_py()
            k = names.get(text)
            if k is None:
                k = names[text] = len(masks)
                masks.append(own_failures(text))
                lows.append(None)
                size += len(text)
            if doc is not None and (lows[k] is None or doc < lows[k]):
                lows[k] = doc
            rows.append((doc, part, k))
            if size >= GROUP_BYTES or len(rows) >= 1 << 17:
                yield flush()
                turn, size = turn + 1, 0
                names, masks, lows, rows = {}, [], [], []
    if rows:
        yield flush()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one range go into a trie; the texts that have a smaller id elsewhere come out with it."""
    root, seen = Trie(), []
    for batch in batches:
        groups, ks, lows = (batch.column(i).to_pylist() for i in range(3))
        for grp, k, low, text in zip(groups, ks, lows, batch.column(3)):
            seen.append((grp, k, low, root.insert(text.as_py(), low)))
    late = [(grp, k, end.low) for grp, k, low, end in seen if end.low < low]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in late], pa.int64()), pa.array([r[1] for r in late], pa.int32()), pa.array([r[2] for r in late], pa.int64())], names=["grp", "k", "least"])


def _cuts(proposed: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges - 1`` cuts, evenly spaced among the proposals (a hashed share of them beyond MOST_CUTS)."""
    total = proposed.count()
    if total > MOST_CUTS:
        proposed = proposed.where(F.pmod(F.xxhash64("cut"), F.lit(-(-total // MOST_CUTS))) == 0)
    found = sorted(bytes(r.cut) for r in proposed.select("cut").collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row: bit 0 to 4 say that the row fails A to E.

    A null text is empty; a null part is the empty part. A row fails E if a row with a smaller id has the same
    text; rows that share an id are not smaller than each other, and null ids neither fail E nor make others fail
    it. Ids are integers. An empty table gives no rows; extra columns are not read.
    """
    texts = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), whole_text(text_col).alias("text"))
    named = stage_table(texts.mapInArrow(_named, NAMED), "audit")
    full = named.where("text IS NOT NULL")
    ranges = min(MOST_RANGES, 1 + (full.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TRIE_BYTES)
    # The cuts have at most MOST_RANGES entries, each as short as two neighbouring texts allow.
    cuts = docs.sparkSession.sparkContext.broadcast(_cuts(named.where("cut IS NOT NULL"), ranges))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [bisect_right(cuts.value, text.as_py()) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.int32())], names=["grp", "k", "low", "text", "slot"])

    routed = full.select("grp", "k", "low", "text").mapInArrow(dealt, "grp long, k int, low long, text binary, slot int")
    tries = routed.repartitionById(int(ranges), F.col("slot")).select("grp", "k", "low", "text")
    late = tries.mapInArrow(_marked, "grp long, k int, least long")
    rows = named.where("part IS NOT NULL").select("id", "part", "mask", "grp", "k", "low").join(late, ["grp", "k"], "left")
    copied = F.coalesce(F.col("id") > F.coalesce("least", "low"), F.lit(False))
    return rows.select("id", "part", (F.col("mask") + F.when(copied, DUPLICATE).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with label 1; repeated labels of an id count once."""
    marks = labels.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col).cast("long").alias("id")).agg(
        F.max(F.when(quoted(good_col) == 1, 1).otherwise(0)).alias("g"), F.max(F.when(quoted(toxic_col) == 1, 1).otherwise(0)).alias("t")
    )
    rows = masks.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("g", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic")]
    return rows.join(marks, "id", "left").groupBy("part", "mask").agg(*sums)


def order_table(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of masks (32 at most per part).

    ``shapley`` sums what the filter removes over all orders: of the orders of the filters that a document fails,
    each filter comes first in the same number.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    ordered = by_part.select("part", "m", F.explode(F.lit(orders)).alias("filter_order"))
    stepped = ordered.select("*", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))).alias("step"))
    bits = f"aggregate(split({{}}, ''), 0, (b, c) -> b | IF(c = '', 0, shiftleft(1, ascii(c) - ascii('{FILTERS[0]}'))))"
    rows = stepped.select("*", F.expr(bits.format("substring(filter_order, step, 1)")).alias("own"), F.expr(bits.format("substring(filter_order, 1, step - 1)")).alias("before"))

    def total(name: str, value: str, test: str):
        return F.expr(f"aggregate(m, 0L, (a, x) -> a + IF({test}, {value}, 0L))").alias(name)

    here = "(x.mask & own) <> 0 AND (x.mask & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("kept", "x.n", "(x.mask & (own | before)) = 0"),
        total("removed", "x.n", here),
        total("redundant", "x.n", "(x.mask & own) <> 0 AND (x.mask & before) <> 0"),
        total("unique_fails", "x.n", "x.mask = own"),
        total("good_lost", "x.good", here),
        total("toxic_lost", "x.toxic", here),
        total("shapley", f"x.n * CAST({len(orders)} DIV bit_count(x.mask) AS BIGINT)", "(x.mask & own) <> 0"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, ...) of ``docs``; edge cases as in ``failure_masks``."""
    return order_table(mask_counts(failure_masks(docs, id_col, text_col, part_col), labels, id_col))

