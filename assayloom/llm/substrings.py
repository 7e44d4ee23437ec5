"""Removal of word passages that occur earlier in the corpus, with suffix automata of reference shards.

A window is 20 consecutive words of one document; a word goes if a window over it also starts earlier (smaller
id, or same id and earlier start). Streaming every document through an automaton of every shard would cost the
square of the corpus, so shards hold, and documents send, only what can match:

1. Texts are cut into chunks, one compressed row each, in a stage table. All later steps read these rows, so a
   step that runs again sees the same texts in the same order.
2. Each window has an anchor, the ten-word gram with the smallest hash in it; equal windows have equal anchors.
   Chunks count their anchors by shard (the hash decides), and shards answer which ones the corpus has again.
3. Stretches of windows under one repeated anchor go to the shard of the anchor, equal ones once per chunk with
   their earliest place. Windows under an anchor of very many places go on their own, to the shard of the whole
   window's hash, so common phrases do not meet in one shard.
4. A shard builds a suffix automaton of the stretches of each anchor in the order of their places; a state knows
   where its words first ended. The stretches are streamed through it for matching statistics cut off at the
   window length, which tell the windows that start earlier elsewhere. One mask per stretch goes back.
5. Chunks put the masks on their words and drop what is covered.

No row of any step grows with the corpus, nothing is broadcast, and the driver sees one count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.rows import quoted, whole_text
from assayloom.session import stage_table

WINDOW, ANCHOR = 20, 10
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 6 << 20
#: Windows of a stretch at most (bits of a mask; the first and the last one hold all its words), and places from
#: which the windows of an anchor go on their own.
STRETCH, COMMON = WINDOW, 20_000
ALL = 0xFFFFFFFF
NO_ID = np.iinfo(np.int64).max


class _WordCodes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_CODES = _WordCodes()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class SuffixAutomaton:
    """Suffix automaton of several word sequences; every state knows the first place where its words end.

    Sequences are added in ascending order of their places, so the place that a state is made with is its first.
    """

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, words: list[bytes], place: tuple[int, int]) -> None:
        """``place``: (document, position of the first word)."""
        last, (doc, at) = 0, place
        for i, word in enumerate(words):
            last = self._extended(last, word, (doc, at + i))

    def _extended(self, last: int, word: bytes, end: tuple[int, int]) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        made = self._state({}, length[last] + 1, end)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = made
            at = link[at]
        if at < 0:
            link[made] = 0
        else:
            known = step[at][word]
            link[made] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return made

    def _state(self, step: dict[bytes, int], length: int, first: tuple[int, int] | None) -> int:
        self.next.append(step)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, known: int) -> int:
        """A state of its own for the words up to ``at`` and ``word``, which end wherever ``known`` ends, too."""
        made = self._state(dict(self.next[known]), self.length[at] + 1, self.first[known])
        self.link[made], self.link[known] = self.link[known], made
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = made
            at = self.link[at]
        return made

    def first_ends(self, words: list[bytes], least: int) -> Iterator[tuple[int, int] | None]:
        """Per word the first place where the ``least`` words that end with it end; None if they are nowhere."""
        at = matched = 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if word in self.next[at]:
                at, matched = self.next[at][word], matched + 1
            while at and self.length[self.link[at]] >= least:
                at = self.link[at]
                matched = self.length[at]
            yield self.first[at] if matched >= least else None


def earlier_masks(stretches: list[tuple[bytes, tuple[int, int]]]) -> list[int]:
    """Per distinct stretch (text, first place), given by place: bit j is set if its window j starts earlier."""
    split = [text.split(b" ") for text, _ in stretches]
    if len(split) == 1 and (len(split[0]) == WINDOW or len(set(split[0])) == len(split[0])):
        return [0]
    automaton = SuffixAutomaton()
    for words, (_, place) in zip(split, stretches):
        automaton.add(words, place)
    masks = []
    for words, (_, (doc, at)) in zip(split, stretches):
        mask = 0
        for i, end in enumerate(automaton.first_ends(words, WINDOW)):
            if end is not None and end < (doc, at + i):
                mask |= 1 << (i - WINDOW + 1)
        masks.append(mask)
    return masks


class Chunk:
    """The words of a chunk's texts, one after the other, and the stretches of their windows."""

    def __init__(self, blob: bytes):
        self.rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        texts = [t.as_py().split() for t in self.rows.column(1).cast(pa.binary())]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.words = list(chain.from_iterable(texts))
        ids = self.rows.column(0).cast(pa.int64()).fill_null(NO_ID)
        self.ids = np.repeat(ids.to_numpy(), self.lengths)
        self.places = np.arange(len(self.words)) - np.repeat(self.begins, self.lengths)
        row = np.repeat(np.arange(len(texts)), self.lengths)
        n = len(self.words) - WINDOW + 1
        if n < 1:
            self.starts, self.counts, self.anchors = (np.empty(0, k) for k in (np.int64, np.int64, np.uint64))
            return
        grams = {1: np.fromiter(map(_CODES.__getitem__, self.words), np.uint64, len(self.words))}
        for width in (1, 2, 4, 8):
            grams[2 * width] = _mixed(grams[width][:-width], grams[width][width:])
        self.windows = _mixed(grams[16][:n], grams[4][16:16 + n])
        least = self.grams = _mixed(grams[8][:len(grams[8]) - 2], grams[2][8:])  # grams of ten words
        width, wanted = 1, WINDOW - ANCHOR + 1
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[wanted - width:wanted - width + n])
        inside = row[:n] == row[WINDOW - 1:]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        at = np.flatnonzero(inside)
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))[at]
        self.starts = at[(at - heads) % STRETCH == 0]
        ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
        self.counts = np.minimum(np.r_[self.starts[1:], n], ends[np.searchsorted(ends, self.starts, "right")]) - self.starts
        self.anchors = least[self.starts]

    def anchor_counts(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, anchors, at how many places) by shard, anchors ascending in a shard.

        A stretch in which grams repeat counts twice, as a window may repeat inside of it.
        """
        anchors, inverse = np.unique(self.anchors, return_inverse=True)
        counts = np.bincount(inverse, weights=1 + self.repeating()).astype(np.int64)
        for shard, mine in _by_shard(anchors, shards):
            yield shard, anchors[mine], counts[mine]

    def repeating(self) -> np.ndarray:
        """True for each stretch with a gram that the same stretch may hold again."""
        if not len(self.starts):
            return np.empty(0, bool)
        near = np.zeros(len(self.grams) + 1, np.int64)
        for lag in range(1, STRETCH):
            near[1:-lag] |= self.grams[:-lag] == self.grams[lag:]
        before = np.cumsum(near)
        return before[self.starts + self.counts + WINDOW - ANCHOR] > before[self.starts]

    def repeated(self, shards: int, answers: dict[int, bytes]) -> Iterator[Stretches]:
        """The stretches that may match, by shard."""
        anchors = np.unique(self.anchors)
        marks = np.empty(len(anchors), np.uint8)
        for shard, mine in _by_shard(anchors, shards):
            marks[mine] = np.frombuffer(answers[shard], np.uint8)
        mark = marks[np.searchsorted(anchors, self.anchors)]
        some, common = mark == 1, np.flatnonzero(mark == 2)
        alone = np.repeat(self.starts[common], self.counts[common])
        alone += np.arange(len(alone)) - np.repeat(np.cumsum(self.counts[common]) - self.counts[common], self.counts[common])
        starts, counts = np.r_[self.starts[some], alone], np.r_[self.counts[some], np.ones(len(alone), np.int64)]
        keys = np.r_[self.anchors[some], self.windows[alone]] if len(starts) else np.empty(0, np.uint64)
        for shard, mine in _by_shard(keys, shards):
            yield Stretches(self, shard, starts[mine], counts[mine], keys[mine])

    def text(self, start: int, count: int) -> bytes:
        return b" ".join(self.words[start:start + count + WINDOW - 1])


class Stretches:
    """Stretches of a chunk for one shard: equal ones have one number, and its first place is the earliest.

    Two stretches are equal if their first and last windows have equal hashes (128 bits, of all their words).
    """

    def __init__(self, chunk: Chunk, shard: int, starts: np.ndarray, counts: np.ndarray, keys: np.ndarray):
        first, last = chunk.windows[starts], chunk.windows[starts + counts - 1]
        ids, places = chunk.ids[starts], chunk.places[starts]
        order = np.lexsort((places, ids, counts, last, first))
        new = np.ones(len(order), bool)
        new[1:] = False
        for values in (first, last, counts):
            new[1:] |= values[order[1:]] != values[order[:-1]]
        self.shard, self.starts, self.counts = shard, starts[order], counts[order]
        self.heads = np.flatnonzero(new)
        self.keys, self.ids, self.places = (v[order][self.heads] for v in (keys, ids, places))
        self.number = np.cumsum(new) - 1
        #: Whether a stretch stands at the earliest place of its equals.
        self.earliest = (ids[order] == self.ids[self.number]) & (places[order] == self.places[self.number])

    def texts(self, chunk: Chunk) -> list[bytes]:
        return [chunk.text(start, count) for start, count in zip(self.starts[self.heads].tolist(), self.counts[self.heads].tolist())]


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in their order) of every shard that has keys."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for mine in np.split(order, cuts):
        if len(mine):
            yield int(shard[mine[0]]), mine


def _chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, n_bytes, blob): the documents in compressed pieces of some MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0

        def row(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pieces[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for piece in pieces:
                    out.write_batch(piece)
            return _batch([("chunk", [(part << 32) + turn], pa.int64()), ("n_bytes", [size], pa.int64()), ("blob", [sink.getvalue().to_pybytes()], pa.binary())])

        held, size = [], 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size += n
                if size >= chunk_bytes:
                    yield row([*held, batch.slice(start, i + 1 - start)])
                    held, size, start, turn = [], 0, i + 1, turn + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield row(held)

    rows = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text"))
    return stage_table(rows.mapInArrow(run, "chunk long, n_bytes long, blob binary"), "chunks")


def _batch(columns: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for _, v, kind in columns], names=[name for name, _, _ in columns])


def _answers(table: pa.Table, common: int) -> pa.Table:
    """One shard: per chunk a byte for each of its anchors; 1: the corpus has it again, 2: at very many places."""
    blobs = [np.frombuffer(a, np.uint64) for a in table.column("anchors").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.bincount(inverse, weights=counts)[inverse]
    marks = (total > 1).astype(np.uint8) + (total > common).astype(np.uint8)
    parts = np.split(marks, np.cumsum([len(b) for b in blobs])[:-1])
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "marks": pa.array([p.tobytes() for p in parts], pa.binary())})


def _shard_masks(table: pa.Table) -> pa.Table:
    """One shard: per chunk a mask for each of its distinct stretches."""
    rows = []
    first: dict[bytes, tuple[int, int]] = {}
    by_key: dict[int, set[bytes]] = defaultdict(set)
    for keys, ids, places, blob in zip(*(table.column(c).to_pylist() for c in ("keys", "ids", "places", "blob"))):
        texts = zstandard.decompress(blob).split(b"\n")
        at = list(zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(places, np.int64).tolist()))
        for text, place, key in zip(texts, at, np.frombuffer(keys, np.uint64).tolist()):
            if text not in first or place < first[text]:
                first[text] = place
            by_key[key].add(text)
        rows.append((texts, at))
    masks: dict[bytes, int] = {}
    for group in by_key.values():
        ordered = sorted(((text, first[text]) for text in group), key=lambda s: (s[1], s[0]))
        masks.update(zip((text for text, _ in ordered), earlier_masks(ordered)))
    found = [np.array([masks[t] if p == first[t] else ALL for t, p in zip(texts, at)], np.uint32).tobytes() for texts, at in rows]
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "masks": pa.array(found, pa.binary())})


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] | None = None, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, common: int = COMMON) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row of ``docs``; words are ``[^\\x20\\x09-\\x0D]+``.

    ``kept`` is the words left, joined by one space, or ``digest`` of their UTF-8. Null and empty texts have no
    words; texts under 20 words lose nothing. Ids are integers. Null ids come last and count as one id; rows that
    share an id are ordered by the start alone, so of two equal rows neither is earlier. An empty table gives no
    rows; texts are read whole, one chunk at a time; extra columns are not read.
    """
    chunks = _chunked(docs, id_col, text_col, chunk_bytes)
    shards = 1 + (chunks.agg(F.sum("n_bytes")).first()[0] or 0) // shard_bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(Chunk(blob.as_py()).anchor_counts(shards))
                yield _batch([
                    ("shard", [s for s, _, _ in found], pa.int64()), ("chunk", [chunk] * len(found), pa.int64()),
                    ("anchors", [a.tobytes() for _, a, _ in found], pa.binary()), ("counts", [c.astype(np.uint32).tobytes() for _, _, c in found], pa.binary()),
                ])

    counted = chunks.select("chunk", "blob").mapInArrow(count, "shard long, chunk long, anchors binary, counts binary")
    answers = stage_table(counted.groupBy("shard").applyInArrow(lambda table: _answers(table, common), "chunk long, shard long, marks binary"), "anchors")
    answered = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "marks")).alias("marks"))
    whole = chunks.select("chunk", "blob").hint("merge").join(answered, "chunk", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = Chunk(blob.as_py())
                out = []
                for some in own.repeated(shards, _by_number(marks, "marks")):
                    texts = zstandard.compress(b"\n".join(some.texts(own)), 1)
                    out.append((some.shard, chunk, some.keys.tobytes(), some.ids.tobytes(), some.places.tobytes(), texts))
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                names = ("shard", "chunk", "keys", "ids", "places", "blob")
                yield _batch([(name, [r[i] for r in out], kind) for i, (name, kind) in enumerate(zip(names, kinds))])

    sent = whole.mapInArrow(send, "shard long, chunk long, keys binary, ids binary, places binary, blob binary")
    masks = sent.groupBy("shard").applyInArrow(_shard_masks, "chunk long, shard long, masks binary")
    masked = masks.groupBy("chunk").agg(F.collect_list(F.struct("shard", "masks")).alias("masks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, marks, found in zip(batch.column(1), batch.column(2), batch.column(3)):
                own, found = Chunk(blob.as_py()), _by_number(found, "masks")
                later = np.zeros(len(own.words) + WINDOW, np.int64)  # per window, behind WINDOW places without any
                for some in own.repeated(shards, _by_number(marks, "marks")):
                    mask = np.where(some.earliest, np.frombuffer(found[some.shard], np.uint32)[some.number], np.uint32(ALL))
                    for bit in range(STRETCH):
                        later[some.starts[(some.counts > bit) & (mask >> np.uint32(bit) & 1 > 0)] + bit + WINDOW] = 1
                upto = np.cumsum(later)
                out = upto[WINDOW:] > upto[:-WINDOW]
                before = np.r_[0, np.cumsum(out)]
                texts = []
                for start, n in zip(own.begins.tolist(), own.lengths.tolist()):
                    words = own.words[start:start + n]
                    if before[start + n] > before[start]:
                        words = [w for w, x in zip(words, out[start:start + n].tolist()) if not x]
                    texts.append((digest or bytes)(b" ".join(words)))
                kept = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.rows.column(0).combine_chunks(), pa.array(own.lengths), pa.array(before[own.begins + own.lengths] - before[own.begins]), kept.cast(pa.string()) if digest is None else kept],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    kind = T.StringType() if digest is None else T.BinaryType()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", kind)])
    final = whole.join(masked, "chunk", "left").mapInArrow(cut, schema)
    return final.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def _by_number(entries: pa.Scalar, name: str) -> dict[int, bytes]:
    """Shard -> its bytes, of a list of structs (null: none)."""
    return {e["shard"]: e[name] for e in entries.as_py() or []}
